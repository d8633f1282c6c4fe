"""File sources/sinks, spark.ml models with persistence, streaming scoring."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import models, split
from tessera.sources import files
from tessera.spec import IRRIGATION_SPEC


def test_csv_latin1_fallback_and_suffixes(spark):
    d = tempfile.mkdtemp(prefix="tessera-src-")
    p = os.path.join(d, "upload.csv")
    with open(p, "wb") as fh:
        fh.write("Temperature,Soil Type,Result\n20,Arcilla ñ,1\n".encode("latin-1"))
    row = files.read_table(spark, p).collect()[0]
    assert row["Soil Type"] == "Arcilla ñ" and row["Temperature"] == 20
    with pytest.raises(ValueError):
        files.read_table(spark, os.path.join(d, "upload.xlsx"))


def write(path, data):
    with open(path, "wb") as fh:
        fh.write(data)


def test_csv_cells(spark, tmp_path):
    text = 'Soil Type,n,x,ok,note\nNA,1,1.5,true,"two\nlines, ""quoted"""\nnull,NA,,False,�\nclay,3,NaN,true,1d\n'
    write(tmp_path / "t.csv", text.encode())
    df = files.read_table(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"Soil Type": "string", "n": "bigint", "x": "double", "ok": "boolean", "note": "string"}
    assert [tuple(r) for r in df.collect()] == [(None, 1, 1.5, True, 'two\nlines, "quoted"'), (None, None, None, False, "�"), ("clay", 3, None, True, "1d")]
    schema = StructType.fromDDL("a string, n double, x string, ok string, note string")
    typed = files.read_table(spark, str(tmp_path / "t.csv"), schema).first()
    assert tuple(typed) == (None, 1.0, "1.5", "true", 'two\nlines, "quoted"')


def test_each_file_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    write(folder / "a.csv", "k,v\n1,ñ€\n".encode())
    write(folder / "b.csv", "k,v\n2,ñ\n".encode("latin-1"))
    assert sorted(map(tuple, files.read_table(spark, str(folder)).collect())) == [(1, "ñ€"), (2, "ñ")]


def test_newest_file_and_report_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tessera-dir-")
    with pytest.raises(FileNotFoundError):
        files.newest_file(spark, d)
    for name in ("old.csv", "new.csv"):
        with open(os.path.join(d, name), "w") as fh:
            fh.write("a\n1\n")
        time.sleep(1.1)
    assert files.newest_file(spark, d).endswith("new.csv")
    df = spark.range(5).withColumn("v", F.col("id") * 2)
    paths = files.write_report({"t": df}, os.path.join(d, "report"))
    assert sorted(files.read_result(spark, os.path.join(d, "report"), "t").collect()) == sorted(df.collect())
    assert set(paths) == {"t"}


@pytest.fixture(scope="module")
def study(spark):
    rows = []
    for i in range(600):
        t = 15 + (i * 7) % 25
        h = (i * 13) % 100
        m = (i * 29) % 90
        soil = ["clay", "sand", "loam"][i % 3]
        stage = ["seed", "veg", "flower"][(i // 3) % 3]
        y = int(m < 45 and t > 20)
        rows.append((i, float(t), float(h), float(m), soil, stage, y))
    df = spark.createDataFrame(rows, "key long, temperature double, humidity double, moi double, soil_type string, "
                                     "crop_stage string, result int")
    return split.study_split(df, "result", "key", 0.2, 3, 42)


def test_fit_score_persist_roundtrip(spark, study):
    num, cat = list(IRRIGATION_SPEC.numeric), list(IRRIGATION_SPEC.categorical)
    m = models.fit(study.where("NOT is_test"), models.ModelConfig("MLP", max_iter=80), num, cat, "result", "key")
    s1 = m.score(study.where("is_test"), keep=["key", "result"])
    acc = s1.select(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("result")).cast("double"))).first()[0]
    assert acc > 0.7
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-model-"), "m")
    models.save(m, path, 0.5, {"model_name": "MLP"})
    loaded, thr, meta = models.load(path)
    s2 = loaded.score(study.where("is_test"), keep=["key"])
    a = {r.key: r.score for r in s1.collect()}
    b = {r.key: r.score for r in s2.collect()}
    assert thr == 0.5 and meta["model_name"] == "MLP" and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_rbf_network_and_cross_validation(spark, study):
    num, cat = list(IRRIGATION_SPEC.numeric), list(IRRIGATION_SPEC.categorical)
    rows = study.where("NOT is_test")
    preds = models.cross_validate(rows, [models.ModelConfig("RBF", max_iter=30, rbf_centers=8)], 3, num, cat,
                                  key="key")
    cv = models.cv_table(preds).collect()
    assert len(cv) == 3 and all(0 <= r.f1 <= 1 for r in cv)
    space = models.search_space(models.ModelConfig("RBF"), 500)
    assert len(space) == 100 and all(c.rbf_centers in (8, 16, 32) and 0.1 <= c.rbf_gamma <= 3 for c in space)


def test_class_weight_replication(spark):
    df = spark.range(0, 1000).select(F.col("id").alias("key"), (F.col("id") < 200).cast("int").alias("y"))
    w = models.balanced_weights(df, "y")
    assert abs(w[1] - 2.5) < 1e-12 and abs(w[0] - 0.625) < 1e-12
    rep = models.replicate_by_weight(df, "y", "key", w)
    counts = {r.y: r["count"] for r in rep.groupBy("y").count().collect()}
    assert counts[0] == 800 and counts[1] == 800


def test_streaming_scoring(spark, study):
    from tessera.streaming import scoring
    num, cat = list(IRRIGATION_SPEC.numeric), list(IRRIGATION_SPEC.categorical)
    m = models.fit(study.where("NOT is_test"), models.ModelConfig("MLP", max_iter=20), num, cat, "result", "key")
    src = tempfile.mkdtemp(prefix="tessera-stream-in-")
    out = tempfile.mkdtemp(prefix="tessera-stream-out-")
    raw = study.where("is_test").select("key", F.col("temperature").alias("Temp"), F.col("humidity").alias("Humidity"),
                                        F.col("moi").alias("MOI"), F.col("soil_type").alias("Soil Type"),
                                        F.col("crop_stage").alias("Seedling Stage"))
    raw.write.mode("overwrite").parquet(os.path.join(src, "batch1"))
    stream = scoring.read_uploads(spark, os.path.join(src, "batch1"), raw.schema, fmt="parquet")
    scored = scoring.score_rows(stream, IRRIGATION_SPEC, m, 0.5, keep=["key"],
                                rules={"humidity_out_of_range": "humidity < 0 OR humidity > 100"})
    q = scoring.start(scored, out, trigger_once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == raw.count()
    assert set(got.columns) >= {"key", "score", "predicted_class", "recommendation", "violations"}


def test_tuning_stops_the_worse_half_and_goes_on_from_its_weights(spark, study):
    num, cat = list(IRRIGATION_SPEC.numeric), list(IRRIGATION_SPEC.categorical)
    rows = study.where("NOT is_test").withColumn("is_validation", F.col("fold") == 1)
    base = models.ModelConfig("RBF", max_iter=8, rbf_centers=8, solver="gd")
    got = models.tune(rows, base, 4, num, cat, key="key", halvings=1).orderBy("trial").collect()
    settings = [models.ModelConfig(**json.loads(r.params)) for r in got]
    full = [r.rounds == s.max_iter for r, s in zip(got, settings)]
    assert len(got) == 4 and sum(full) == 2 and all(r.rounds == s.max_iter // 2 for r, s, f in zip(got, settings, full) if not f)
    assert len({s.step_size for s in settings}) == 4 and all(models.STEPS[0] <= s.step_size <= models.STEPS[1] for s in settings)
    finished = [r.value for r, f in zip(got, full) if f]
    assert [r.value for r in got if r.best] == [max(finished)] and all(f for r, f in zip(got, full) if r.best)
    # without halvings each trial is the plain fit of its setting
    plain = models.tune(rows, base, 1, num, cat, key="key").first()
    fitted = models.fit(rows.where("NOT is_validation"), models.search_space(base, 1)[0], num, cat, "result", "key")
    scored = fitted.score(rows.where("is_validation"), ["result"])
    assert plain.value == models.M.classification_metrics(scored, [], y="result").first().f1


def test_json_documents_keep_types_nulls_and_special_values(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 1.0D, double('inf'), 'x', DATE'2024-02-29', array(1, NULL)), (NULL, double('nan'), -0.5D, NULL, NULL, NULL),
                      (3, 2.0D, double('-inf'), '"q"\\n', DATE'1999-01-01', array()) AS t(`a b`, c, d, e, f, `g.h`)""")
    folder = tempfile.mkdtemp(prefix="tessera-json-")
    for _ in range(2):  # written over
        files.write_report({"odd": df, "none": df.limit(0)}, folder, "json")
    back = files.read_result(spark, folder, "odd", "json")
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    none = files.read_result(spark, folder, "none", "json")
    assert none.dtypes == df.dtypes and none.count() == 0

"""Preparation and network as pipeline stages, and validation in one evaluation."""

import os
import statistics
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import validate as V
from tessera.operators.preparation import Network, PipelineScorer, Preparation, PreparationModel, level_table
from tessera.sources import testdata as td
from tests.oracle_harness import compare, duck

SF001 = "/root/testdata/sf0.001"
SCHEMA = "k long, a double, `b c` string, empty string, nothing double"


def plain(train, rows):
    """Width, and k -> (indices, values), of columns a, 'b c', empty, nothing."""
    known = [r[1] for r in train if r[1] is not None]
    median = statistics.median(known)
    filled = [median if r[1] is None else r[1] for r in train]
    mean, sd = statistics.fmean(filled), statistics.pstdev(filled)
    names = [r[2] for r in train if r[2] is not None]
    levels = sorted(set(names), key=lambda x: x.encode())
    mode = min(levels, key=lambda x: (-names.count(x), x.encode()))
    out = {}
    for k, a, b, *_ in rows:
        x = ((median if a is None else a) - mean) / (sd or 1.0)
        b = mode if b is None else b
        entries = ([(0, x)] if x else []) + ([(2 + levels.index(b), 1.0)] if b in levels else [])
        out[k] = ([i for i, _ in entries], [v for _, v in entries])
    return 2 + len(levels), out


@pytest.fixture(scope="module")
def rows():
    # one level holds a third of the rows; others occur once
    return [(i, None if i % 7 == 0 else float(i % 10), None if i % 5 == 0 else "hot" if i % 3 == 0 else f"lev,el {i}", None, None) for i in range(1200)]


def test_sparse_rows_against_plain(spark, rows):
    train = [r for r in rows if r[0] % 4]
    fitted = Preparation(numeric=["a", "nothing"], categorical=["b c", "empty"]).fit(spark.createDataFrame(train, SCHEMA))
    width, expected = plain(train, rows)
    got = fitted.sparse(spark.createDataFrame(rows, SCHEMA), ["k"]).collect()
    assert {r["width"] for r in got} == {width} and len(got) == len(rows)
    for r in got:
        indices, values = expected[r["k"]]
        assert r["indices"] == indices and r["values"] == pytest.approx(values, abs=1e-9), r


def test_vectors_equal_sparse_rows_and_survive_saving(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    fitted = Preparation(numeric=["a", "nothing"], categorical=["b c", "empty"], outputCol="x").fit(table.where("k % 4 <> 0"))
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-model-"), "m")
    fitted.write().save(path)
    again = PreparationModel.load(path)
    assert again.uid == fitted.uid and again.width == fitted.width and again.constants == fitted.constants
    dense = {r["k"]: r["x"] for r in again.transform(table).select("k", vector_to_array("x").alias("x")).collect()}
    assert len(dense) == len(rows)
    for r in fitted.sparse(table, ["k"]).collect():
        assert {i: v for i, v in enumerate(dense[r["k"]]) if v} == dict(zip(r["indices"], r["values"])) and len(dense[r["k"]]) == r["width"]
    assert set(again.transform(table).columns) == {*table.columns, "x"}


def test_levels_are_numbered_in_value_order(spark, rows):
    got = level_table(spark.createDataFrame(rows, SCHEMA), ["b c", "empty"]).collect()
    assert {r["column"] for r in got} == {"b c"}
    by_id = sorted(got, key=lambda r: r["id"])
    assert [r["id"] for r in by_id] == list(range(len(got)))
    assert [r["value"] for r in by_id] == sorted({r[2] for r in rows if r[2]}, key=lambda x: x.encode())


def test_levels_are_joined_not_literals(spark, rows):
    fitted = Preparation(categorical=["b c"]).fit(spark.createDataFrame(rows, SCHEMA))
    plan = fitted.sparse(spark.createDataFrame(rows, SCHEMA), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" in plan and "lev,el 1," not in plan


def test_numbers_alone_and_no_features(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    only = Preparation(numeric=["a"]).fit(table)
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-model-"), "m")
    only.write().save(path)
    assert PreparationModel.load(path).transform(table).select(F.max(F.size(vector_to_array("features")))).first()[0] == 1
    none = Preparation(categorical=["empty"]).fit(table)
    assert {(r["width"], tuple(r["indices"])) for r in none.sparse(table, ["k"]).collect()} == {(0, ())}
    with pytest.raises(ValueError, match="0 features"):
        none.transform(table)


def test_pipeline_learns_and_scores_as_before_saving(spark):
    table = spark.range(400).selectExpr("id AS k", "CAST(id % 20 AS DOUBLE) AS a", "concat('g', id % 3) AS b", "CAST(id % 20 >= 10 AS INT) AS result")
    fitted = Pipeline(stages=[Preparation(numeric=["a"], categorical=["b"]), Network(hidden=[4], maxIter=40)]).fit(table)
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-model-"), "m")
    fitted.save(path)
    first, second = (PipelineScorer(m).score(table, ["k", "result"]).collect() for m in (fitted, PipelineModel.load(path)))
    assert sorted(first) == sorted(second)
    assert sum((r["score"] >= 0.5) == bool(r["result"]) for r in first) > 380


def test_observed_validation_equals_the_plain_one(spark):
    messy = td.upload_frame(spark, SF001, messy_target=True)
    one, other = V.validate(messy, td.ORDER_SPEC, "quarantine"), V.validate_observed(messy, td.ORDER_SPEC, "quarantine")
    assert one.metrics == other.metrics and one.warnings == other.warnings
    for a, b in ((one.frame, other.frame), (one.quarantine, other.quarantine)):
        assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError, match="neither 0 nor 1"):
        V.validate_observed(messy, td.ORDER_SPEC)
    with pytest.raises(ValueError, match="no rows"):
        V.validate_observed(messy.limit(0), td.ORDER_SPEC)


def test_observed_counters_that_do_not_fit_are_counted_again(spark, monkeypatch):
    upload = td.upload_frame(spark, SF001)
    right = V.validate(upload, td.ORDER_SPEC).metrics

    class Doubled(V.Observation):
        @property
        def get(self):
            return {k: 2 * v for k, v in super().get.items()}

    monkeypatch.setattr(V, "Observation", Doubled)
    assert V.validate_observed(upload, td.ORDER_SPEC).metrics == right


@pytest.mark.parametrize("name", ["clean_observed", "quarantine_observed", "onehot_sparse", "prepared_values", "pipeline_persist", "stream_model_scoring"])
def test_queries_against_sql(spark, name):
    res = compare(entry.queries()[name](spark, SF001), duck(SF001), entry.oracle_sql()[name])
    assert res["status"] == "exact", res

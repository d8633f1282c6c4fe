"""Running totals, exact quantiles, exact stratified splits, leakage-free preprocessing."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import features, metrics, prefix, split


def test_running_totals_match_window_with_split_groups(spark):
    # one group holds most rows, so it is split into buckets (rowsPerBucket=500 in tests)
    df = spark.range(0, 6000).select(F.when(F.col("id") < 5000, F.lit("big")).otherwise((F.col("id") % 7).cast("string"))
                                     .alias("k"), (F.col("id") * 7919 % 6007).alias("o"), (F.col("id") % 5).alias("v"))
    got = prefix.running_totals(df, ["k"], ["o"], {"cum": "v"}, with_totals=True)
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("cum", F.sum("v").over(w)).withColumn("cum_total", F.sum("v").over(Window.partitionBy("k")))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("keys", [[], ["k"], ["f"], ["st", "k"]])
def test_running_totals_of_odd_keys_and_values(spark, keys, inclusive):
    # null, NaN and nested keys; null values, doubles and decimals
    df = spark.range(0, 3000).selectExpr(
        "CASE WHEN id < 1500 THEN NULL WHEN id < 2500 THEN 'NaN' ELSE CAST(id % 3 AS STRING) END AS k", "id * 7919 % 6007 AS o",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE id % 5 END AS v", "CAST(id % 7 AS DOUBLE) / 4 AS d", "CAST(id % 9 AS DECIMAL(6, 2)) AS e",
        "named_struct('a', CASE WHEN id < 700 THEN NULL ELSE id % 2 END) AS st").withColumn("f", F.col("k").try_cast("double"))
    sums = {"a": F.col("v"), "b": F.col("d"), "c": F.col("e")}
    got = prefix.running_totals(df, keys, [-F.col("o")], sums, with_totals=True, inclusive=inclusive)
    w = Window.partitionBy(*keys).orderBy(-F.col("o")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = df.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(n) for n, c in sums.items()],
                     *[F.sum(c).over(Window.partitionBy(*keys)).alias(f"{n}_total") for n, c in sums.items()])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_running_totals_do_no_search_and_no_window_for_each_row(spark):
    df = spark.range(0, 6000).selectExpr("id % 3 AS k", "id * 7919 % 6007 AS o", "id % 5 AS v")
    plan = prefix.running_totals(df, ["k"], ["o"], {"cum": "v"})._jdf.queryExecution().toString()
    assert "lambda" not in plan and "Window" not in plan and "hashpartitioning" not in plan


def test_exact_quantiles_match_numpy(spark):
    vals = np.random.default_rng(1).normal(size=3001).round(3)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    q = {r.prob: r.quantile for r in prefix.exact_quantiles(df, [], "x", [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, v in q.items():
        assert abs(v - np.percentile(vals, p * 100)) < 1e-12


def test_holdout_and_folds_exact_quotas(spark):
    # class counts of the published study: 9062 / 6227 -> test 3058, folds 2447 / 2446 x 4
    df = spark.range(0, 15289).select(F.col("id").alias("key"), (F.col("id") >= 9062).cast("int").alias("y"))
    s = split.study_split(df, "y", "key", 0.2, 5, 42)
    assert s.where("is_test").count() == 3058
    sizes = sorted(r["count"] for r in s.where("NOT is_test").groupBy("fold").count().collect())
    assert sizes == [2446, 2446, 2446, 2446, 2447]
    per = {(r.y, r.is_test): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    assert per[(0, True)] + per[(1, True)] == 3058 and abs(per[(0, True)] - 0.2 * 9062) < 1
    again = split.study_split(df, "y", "key", 0.2, 5, 42)
    assert sorted(s.collect()) == sorted(again.collect())  # deterministic


def test_population_scaler_mode_and_unknown_level(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (4.0, "b"), (None, None)], "x double, c string")
    pre = features.fit_preprocessor(train, ["x"], ["c"])
    assert pre.medians["x"] == 2.0 and pre.modes["c"] == "b" and pre.levels["c"] == ["a", "b"]
    vals = np.array([1.0, 2.0, 4.0, 2.0])
    assert abs(pre.scales["x"] - vals.std()) < 1e-12 and abs(pre.means["x"] - vals.mean()) < 1e-12
    test = spark.createDataFrame([(None, "zzz")], "x double, c string")
    row = pre.transform(test).collect()[0]
    assert row["c=a"] == 0.0 and row["c=b"] == 0.0 and abs(row["x"] - (2.0 - vals.mean()) / vals.std()) < 1e-12


def test_no_leak_from_validation_rows(spark):
    base = spark.range(0, 200).select(F.col("id").alias("key"), (F.col("id") % 2).cast("int").alias("y"),
                                      (F.col("id") * 1.5).alias("x"))
    s = split.study_split(base, "y", "key", 0.2, 2, 42)
    a = features.fit_preprocessor(s.where("NOT is_test"), ["x"], [])
    changed = s.withColumn("x", F.when(F.col("is_test"), F.lit(1e9)).otherwise(F.col("x")))
    b = features.fit_preprocessor(changed.where("NOT is_test"), ["x"], [])
    assert a.to_json() == b.to_json()


def test_fold_statistics_match_per_fold_fit(spark):
    df = spark.range(0, 300).select(F.col("id").alias("key"), (F.col("id") % 3 + 1).cast("int").alias("fold"),
                                    (F.col("id") % 17 * 1.0).alias("x"), (F.col("id") % 4).cast("string").alias("c"))
    num, cat = features.fold_statistics(df, ["x"], ["c"], 3)
    got = {r.fold: r for r in num.collect()}
    for f in (1, 2, 3):
        pre = features.fit_preprocessor(df.where(F.col("fold") != f), ["x"], ["c"])
        assert abs(got[f].median - pre.medians["x"]) < 1e-12 and abs(got[f].scale - pre.scales["x"]) < 1e-9


def test_rbf_features(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0])], "id int, v array<double>")
    out = {r.id: r.rbf for r in features.rbf_features(df, "v", [[0.0, 0.0], [1.0, 1.0]], 0.5).collect()}
    assert out[1] == [1.0, np.exp(-1.0)] and abs(out[2][0] - np.exp(-2.5)) < 1e-15


def test_bracketed_quantiles_equal_sorted_ones(spark):
    pick = np.random.default_rng(3)
    values = {"wide": pick.normal(size=3000), "ties": pick.integers(0, 4, 3000).astype(float), "one": np.full(900, 7.0),
              "steps": np.repeat(np.arange(30.0), 100), "small": np.array([3.0, 1.0]), None: pick.exponential(size=2000)}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("wide", None), ("wide", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    probs = [0.0, 0.001, 0.25, 0.25, 0.5, 0.75, 0.9995, 1.0]
    for accuracy in (20, 100, 2000):  # brackets of a fifth of the rows, of a twenty-fifth, groups counted whole
        got = prefix.exact_quantiles(df, ["g"], "v", probs, accuracy).collect()
        assert len(got) == len(values) * len(probs)
        for r in got:
            assert r["quantile"] == pytest.approx(np.quantile(values[r["g"]], r["prob"]), rel=1e-12) and r["n"] == len(values[r["g"]])


def test_bracketed_quantiles_shuffle_gaps_and_brackets(spark):
    df = spark.range(200_000).select(F.col("id").cast("double").alias("v"))
    seen = []
    running = prefix.running_totals
    try:
        prefix.running_totals = lambda levels, *a, **k: seen.append(levels.count()) or running(levels, *a, **k)
        assert prefix.exact_quantiles(df, [], "v", [0.5]).first()["quantile"] == 99_999.5
    finally:
        prefix.running_totals = running
    # a bracket, with the sketch's own error at its ends, and the gaps on both sides of it
    assert seen[0] <= 200_000 * 6 / 2000 + 2


def test_inputs_are_evaluated_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    def passes(df, run):
        before = read.value
        run(df.mapInArrow(counted, df.schema))
        return (read.value - before) / df.count()

    rows = spark.range(0, 3000, 1, 4).selectExpr("id AS key", "CAST(id % 3 = 0 AS INT) AS y", "CAST(id % 977 AS DOUBLE) / 977 AS score",
                                                 "CAST(id % 5 + 1 AS INT) AS fold", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS v", "CAST(id % 4 AS STRING) AS c")
    assert passes(rows, lambda d: split.study_split(d.drop("fold"), "y", "key").collect()) == 1
    assert passes(rows, lambda d: metrics.classification_metrics(d, ["fold"]).collect()) == 1
    assert passes(rows, lambda d: metrics.roc_curve(d, ["fold"]).collect()) == 1

    def both(d):
        for table in features.fold_statistics(d, ["v", "score"], ["c"], 5):
            table.collect()

    assert passes(rows, both) == 1


def test_class_tables_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.range(0, 600).selectExpr("id AS key", "CAST(id % 3 AS INT) AS y")
    want = sorted(map(tuple, split.study_split(df, "y", "key").collect()))
    monkeypatch.setattr(split, "CLASSES", 2)
    assert sorted(map(tuple, split.study_split(df, "y", "key").collect())) == want

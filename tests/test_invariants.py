"""Invariants: Holm is monotone and bounded, folds are disjoint and cover the training rows,
exact quantiles agree with percentile_cont on random data (hypothesis-generated)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import prefix, split, stats


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=0.0, max_value=1.0, allow_nan=False), min_size=1, max_size=12))
def test_holm_monotone_and_bounded(spark, ps):
    rows = [(f"a{i:02d}", f"b{i:02d}", p) for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "model_a string, model_b string, p_value double")
    out = sorted(stats.holm(df, []).collect(), key=lambda r: (r.p_value, r.model_a))
    adj = [r.p_value_holm for r in out]
    assert all(0 <= a <= 1 for a in adj)
    assert all(x <= y + 1e-15 for x, y in zip(adj, adj[1:]))
    assert all(r.p_value_holm >= r.p_value - 1e-15 for r in out)


def test_folds_disjoint_and_covering(spark):
    df = spark.range(0, 5003).select(F.col("id").alias("key"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    s = split.study_split(df, "y", "key", 0.25, 4, 7)
    train = s.where("NOT is_test")
    assert train.where(F.col("fold").isNull()).count() == 0
    assert s.where("is_test").where(F.col("fold").isNotNull()).count() == 0
    assert train.count() + s.where("is_test").count() == 5003
    per = {(r.y, r.fold): r["count"] for r in train.groupBy("y", "fold").count().collect()}
    for y in (0, 1):
        sizes = [per.get((y, f), 0) for f in range(1, 5)]
        assert max(sizes) - min(sizes) <= 1
    totals = [sum(per.get((y, f), 0) for y in (0, 1)) for f in range(1, 5)]
    assert max(totals) - min(totals) <= 1


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=300))
def test_exact_quantiles_random(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r.prob: r.quantile for r in prefix.exact_quantiles(df, [], "x", [0.0, 0.3, 0.5, 1.0]).collect()}
    for p, v in got.items():
        assert abs(v - np.percentile(xs, p * 100)) < 1e-9

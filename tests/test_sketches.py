"""Mergeable describe: sketches stored by part and merged."""

import statistics

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import profile
from tests.oracle_harness import compare, duck

SF001 = "/root/testdata/sf0.001"


def test_parts_merge_to_the_whole(spark):
    rows = [(i % 7, None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i * i % 1009) + 1e6, 5.0 if i == 3 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "part int, x double, once double")
    parts = profile.sketch_numeric(df, ["x", "once"], ["part"])
    assert parts.where("column = 'once'").count() == 1
    # stored apart, as files arrive, then merged
    both = parts.where("part < 3").unionByName(parts.where("part >= 3"))
    got = {r["column"]: r for r in profile.describe_sketches(both).collect()}
    known = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    x = got["x"]
    assert x["count"] == len(known) and x["min"] == min(known) and x["max"] == max(known)
    assert abs(x["mean"] - statistics.fmean(known)) < 1e-6 and abs(x["std"] - statistics.stdev(known)) < 1e-6
    assert got["once"]["std"] is None and list(got["once"]["quantiles"]) == [5.0] * 3
    known.sort()
    for p, q in zip((0.25, 0.5, 0.75), x["quantiles"]):
        below, upto = sum(v < q for v in known) / len(known), sum(v <= q for v in known) / len(known)
        assert below - profile.RANK_ERROR <= p <= upto + profile.RANK_ERROR


def test_rank_errors_see_a_wrong_quantile(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    wrong = spark.createDataFrame([("x", [250.0, 600.0, 750.0])], "column string, quantiles array<double>")
    assert abs(profile.rank_errors(df, wrong, ["x"]).first()["rank_error"] - 0.1) < 1e-9
    assert profile.describe_sketches(profile.sketch_numeric(df.limit(0), ["x"], [])).count() == 0


def test_query_against_sql(spark):
    res = compare(entry.queries()["describe_sketch"](spark, SF001), duck(SF001), entry.oracle_sql()["describe_sketch"])
    assert res["status"] == "exact", res

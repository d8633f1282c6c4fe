"""Classification metrics, ROC points, bootstrap intervals."""

from pyspark.sql import functions as F

import numpy as np
import pytest

from tessera.operators import metrics, profile


def _pred(spark, ys, ss, model="m"):
    return spark.createDataFrame([(i, model, y, s) for i, (y, s) in enumerate(zip(ys, ss))],
                                 "key long, model string, y int, score double")


def test_threshold_metrics_by_hand(spark):
    ys = [1, 1, 1, 0, 0, 0, 0, 1]
    ss = [0.9, 0.8, 0.3, 0.6, 0.2, 0.1, 0.4, 0.7]
    r = metrics.classification_metrics(_pred(spark, ys, ss), ["model"]).collect()[0]
    assert (r.tn, r.fp, r.fn, r.tp) == (3, 1, 1, 3)
    assert r.accuracy == 0.75 and r.precision == 0.75 and r.recall == 0.75 and r.specificity == 0.75
    assert abs(r.mcc - 0.5) < 1e-15 and r.balanced_accuracy == 0.75 and r.n == 8
    assert abs(r.roc_auc - 14 / 16) < 1e-15  # two discordant pairs (0.3 vs 0.4 and 0.6)


def test_average_precision_step_sum(spark):
    # y = [0, 0, 1, 1], scores [0.1, 0.4, 0.35, 0.8] -> AP 0.8333 (step sum, not trapezoid)
    r = metrics.classification_metrics(_pred(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8]), ["model"]).collect()[0]
    assert abs(r.pr_auc - (1.0 * 0.5 + (2 / 3) * 0.5)) < 1e-12 and abs(r.roc_auc - 0.75) < 1e-15


def test_auc_symmetry_ties_and_single_class(spark):
    ys = [1, 0, 1, 0, 1, 1, 0]
    ss = [0.5, 0.5, 0.7, 0.2, 0.5, 0.9, 0.6]
    p = _pred(spark, ys, ss)
    a = metrics.classification_metrics(p, ["model"]).collect()[0].roc_auc
    b = metrics.classification_metrics(p.withColumn("score", 1 - F.col("score")), ["model"]).collect()[0].roc_auc
    assert abs(a + b - 1) < 1e-15
    flat = metrics.classification_metrics(_pred(spark, [0, 1, 0, 1], [0.3] * 4), ["model"]).collect()[0]
    assert flat.roc_auc == 0.5
    one = metrics.classification_metrics(_pred(spark, [1, 1, 1], [0.2, 0.6, 0.9]), ["model"]).collect()[0]
    assert one.roc_auc == 0.0 and one.specificity == 0.0 and one.balanced_accuracy == one.recall


def test_roc_curve_drops_collinear_points(spark):
    # equal increments at consecutive thresholds are collinear and dropped
    ys = [1, 1, 1, 0, 0, 0]
    ss = [0.9, 0.8, 0.7, 0.3, 0.2, 0.1]
    pts = sorted((r.fpr, r.tpr) for r in metrics.roc_curve(_pred(spark, ys, ss), ["model"]).collect())
    assert pts == [(0.0, 0.0), (0.0, 1 / 3), (0.0, 1.0), (1.0, 1.0)]


def test_bootstrap_interval_contains_estimate(spark):
    ys = [i % 2 for i in range(400)]
    ss = [0.8 if (i % 2 and i % 7) else 0.3 if i % 5 else 0.6 for i in range(400)]
    p = _pred(spark, ys, ss)
    f1 = metrics.classification_metrics(p, ["model"]).collect()[0].f1
    ci = metrics.bootstrap_ci(p, ["model"], "key", metric="f1", replicates=100).collect()[0]
    assert ci.lower <= f1 <= ci.upper and ci.replicates == 100
    auc = metrics.bootstrap_ci(p, ["model"], "key", metric="roc_auc", replicates=50).collect()[0]
    assert 0 <= auc.lower <= auc.upper <= 1


def test_single_class_groups_do_not_break_curves_or_correlations(spark):
    rows = [("a", 1, 0.9), ("a", 1, 0.2), ("b", 0, 0.4), ("b", 1, 0.6)]
    df = spark.createDataFrame(rows, "model string, y int, score double")
    got = {(r["model"], r["threshold"]): (r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, ["model"]).collect()}
    assert got[("a", 0.2)] == (None, 1.0) and got[("b", 0.4)] == (1.0, 1.0)
    table = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, 1.0)], "x double, flat double, gaps double")
    r = {(c["a"], c["b"]): c["r"] for c in profile.correlation(table, ["x", "flat", "gaps"]).collect()}
    assert r == {(a, b): 1.0 if a == b == "x" else None for a in ("x", "flat", "gaps") for b in ("x", "flat", "gaps")}


def test_bootstrap_auc_is_the_same_however_rows_are_cut(spark):
    """Many ties, ranges of a few rows: equal to ranking each replicate whole."""
    rows = [("m" if i % 2 else "k", i, (i * 7 % 11) // 4 % 2, (i * 31 % 17) // 3 / 10) for i in range(900)]
    df = spark.createDataFrame(rows, "model string, key long, y int, score double")
    got = {r["model"]: (r["lower"], r["upper"], r["replicates"]) for r in
           metrics.bootstrap_ci(df, ["model"], "key", metric="roc_auc", replicates=20, seed=3).collect()}
    reps = metrics._replicated(df, "key", 20, 3).toPandas()
    for model, own in reps.groupby("model"):
        values = []
        for _, r in own.groupby("__b"):
            p, n = r[r.y == 1], r[r.y == 0]
            u = sum(w * ((n.score < s) * n["__w"]).sum() + w * 0.5 * ((n.score == s) * n["__w"]).sum() for s, w in zip(p.score, p["__w"]))
            values.append(u / (p["__w"].sum() * n["__w"].sum()))
        low, high = np.percentile(values, [2.5, 97.5])
        assert abs(got[model][0] - low) < 1e-12 and abs(got[model][1] - high) < 1e-12 and got[model][2] == 20


def test_bootstrap_f1_equals_its_plain_form(spark):
    rows = [(f"m{i % 2}" if i % 7 else None, f"k{i // 2}" if i % 11 else "", i % 3 == 0, None if i % 13 == 0 else (i * 37 % 100) / 100) for i in range(300)]
    df = spark.createDataFrame([(m, k, int(y), s) for m, k, y, s in rows], "model string, key string, y int, score double")
    got = {r["model"]: (r["lower"], r["upper"], r["replicates"]) for r in metrics.bootstrap_ci(df, ["model"], "key", metric="f1", replicates=17, seed=5).collect()}
    reps = metrics._replicated(df, "key", 17, 5).toPandas()
    for model, own in reps.groupby("model", dropna=False):
        values = []
        for _, r in own.groupby("__b"):
            hit, miss = r.score >= 0.5, r.score < 0.5
            tp, fp, fn = (r[m]["__w"].sum() for m in ((r.y == 1) & hit, (r.y == 0) & hit, (r.y == 1) & miss))
            values.append(2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0)
        name = None if model != model else model
        assert got[name][:2] == pytest.approx((np.quantile(values, 0.025), np.quantile(values, 0.975))) and got[name][2] == 17


def test_bootstrap_weights_pack_and_chunk(spark, monkeypatch):
    from tessera.operators import bootstrap
    for n in (1, 2, 7):
        weights = bootstrap.Weights(n, 42)
        drawn = weights.drawn([str(i) for i in range(50)])
        drawn[3, 0] = 17
        cells = [weights.packed(r) for r in drawn]
        assert (weights.unpacked(cells) == drawn).all() and (weights.unpacked(cells[:3]) == drawn[:3]).all()
    df = spark.createDataFrame([("m", i, i % 2, round(i * 7 % 23 / 23, 2)) for i in range(200)], "model string, key int, y int, score double")
    whole = metrics.bootstrap_ci(df, ["model"], "key", metric="roc_auc", replicates=9).collect()
    monkeypatch.setattr(bootstrap, "CELLS", 9)  # a row at a time: levels go on from batch to batch
    assert metrics.bootstrap_ci(df, ["model"], "key", metric="roc_auc", replicates=9).collect() == whole
    assert metrics.bootstrap_ci(df.limit(0), ["model"], "key", metric="roc_auc", replicates=9).collect() == []
    assert metrics.bootstrap_ci(df, [], "key", metric="f1", replicates=9).count() == 1


def test_md5_of_arrays_is_md5():
    import hashlib
    from tessera.functions.hashing import md5_heads
    begins = [b"", b"7", b"123456", "\u00e9".encode(), b"k" * 51, b"k" * 52, b"k" * 53, b"k" * 200]
    ends = [f"|{b}|42".encode() for b in (1, 2, 10, 99, 1000)]
    want = [[int.from_bytes(hashlib.md5(a + e).digest()[:4], "big") for e in ends] for a in begins]
    assert md5_heads(begins, ends).tolist() == want


def test_weights_are_drawn_in_all_tasks(spark, monkeypatch):
    # all rows in one file, as the hold-out rows of a ranked table are; half of them have no key
    from tessera.operators import bootstrap
    written = []
    keep = bootstrap.materialize
    monkeypatch.setattr(bootstrap, "materialize", lambda df: written.append(keep(df)) or written[-1])
    pred = spark.range(0, 400, 1, 1).selectExpr("CASE WHEN id < 200 THEN id END AS k", "id % 2 AS y", "id * 7 % 401 / 401D AS score", "'m' AS model")
    bootstrap.replicate_auc(pred, ["model"], "k", "y", "score", 4, 42)
    for keyed in (True, False):
        part = written[0].where((F.col("__k") != "") == keyed)
        files = part.select(F.input_file_name().alias("f")).distinct().count()
        assert files == 4 if keyed else files > 1

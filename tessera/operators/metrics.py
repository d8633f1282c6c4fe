"""Classification metrics from (y, score) per group (E1-E13) and bootstrap intervals.

Predictions are collapsed to distinct score levels, which are written once.
Threshold metrics are one ``groupBy(by).agg`` of four counts and two sums over
them (map-side partial aggregation: the shuffle is one row per group per task).
Rank metrics (ROC-AUC, average precision, ROC points) use the distributed
running totals of the same table, so a model scored on billions of rows never
sorts them in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import poisson1_sql, uniform_sql
from tessera.operators.bootstrap import replicate_auc, replicate_f1
from tessera.operators.prefix import running_totals
from tessera.session import materialize

DOUBLE_EPS = 2.220446049250313e-16
# fixed values: the names of the study's metrics, in its order
METRIC_COLUMNS = ["accuracy", "precision", "recall", "specificity", "f1", "roc_auc", "pr_auc", "log_loss",
                  "balanced_accuracy", "mcc", "brier_score", "threshold", "n"]


def _div(a, b):
    """a / b, 0 when b is 0 (ANSI-safe: never divides by zero)."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def _join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on ``by`` (nulls equal); without ``by`` both sides are single rows and meet on a constant."""
    r = right.select(*[F.col(c).alias(f"__j_{c}") for c in by], F.lit(1).alias("__j"), *[c for c in right.columns if c not in by])
    left = left.withColumn("__l", F.lit(1))
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"__j_{c}"]) for c in by], left["__l"] == r["__j"])
    return left.join(r, cond, "left").drop("__l", "__j", *[f"__j_{c}" for c in by])


def confusion_counts(levels: DataFrame, by: list[str], threshold: float = 0.5, eps: float = DOUBLE_EPS) -> DataFrame:
    """E1 (+ sums for E10/E11) from ``score_levels``: tn, fp, fn, tp, n, log-loss sum, squared-error sum per group."""
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = s >= F.lit(threshold)
    p1 = F.greatest(F.least(s, F.lit(1.0 - eps)), F.lit(eps))
    p0 = F.greatest(F.least(1.0 - s, F.lit(1.0 - eps)), F.lit(eps))
    where = lambda cond, c: F.coalesce(F.sum(F.when(cond, c).otherwise(0)), F.lit(0))
    return levels.groupBy(*by).agg(
        where(~hit, neg).alias("tn"), where(hit, neg).alias("fp"),
        where(~hit, pos).alias("fn"), where(hit, pos).alias("tp"),
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("n"),
        F.sum(-F.log(p1) * pos - F.log(p0) * (F.col("__rows") - pos)).alias("__ll"),
        F.sum(pos * (s - 1) * (s - 1) + neg * s * s).alias("__se"))


def threshold_metrics(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """E2-E7, E10, E11 from the counts (0 on zero division, as the study defines them)."""
    tn, fp, fn, tp, n = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp", "n"))
    precision = _div(tp, tp + fp)
    recall = _div(tp, tp + fn)
    specificity = _div(tn, tn + fp)
    f1 = _div(2 * tp, 2 * tp + fp + fn)
    pos, neg = tp + fn, tn + fp
    balanced = (F.when((pos > 0) & (neg > 0), (recall + specificity) / 2)
                 .when(pos > 0, recall).otherwise(specificity))
    denom = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    mcc = F.when(denom > 0, (tp * tn - fp * fn) / F.sqrt(F.when(denom > 0, denom))).otherwise(F.lit(0.0))
    return counts.withColumns({
        "accuracy": _div(tp + tn, n), "precision": precision, "recall": recall, "specificity": specificity,
        "f1": f1, "log_loss": _div(F.col("__ll"), n), "balanced_accuracy": balanced, "mcc": mcc,
        "brier_score": _div(F.col("__se"), n), "threshold": F.lit(float(threshold))}).drop("__ll", "__se")


def score_levels(pred: DataFrame, by: list[str], y: str = "y", score: str = "score",
                 weight: str | None = None) -> DataFrame:
    """Distinct (group, score) with positive / negative (weighted) counts and the number of rows (``__rows``)."""
    w = F.col(weight) if weight else F.lit(1)
    yy = F.col(y).cast("int")
    return pred.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(yy == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(yy == 0, w).otherwise(0)).alias("neg"),
        F.count(F.lit(1)).alias("__rows"))


def rank_metrics_from_levels(levels: DataFrame, by: list[str]) -> DataFrame:
    """E8 + E9 from one descending running-totals pass over the score levels, which are a written table.

    With tps/fps = positives/negatives scoring >= s, the negatives strictly
    below s are N - fps, so AUC = sum pos * (N - fps + neg / 2) / (P N) and
    AP = sum pos * tps / (tps + fps) / P share the same scan.
    """
    run = running_totals(levels, by, [-F.col("score"), "score"], {"tps": "pos", "fps": "neg"}, with_totals=True, written=True)
    agg = run.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("fps_total") - F.col("fps") + F.col("neg") * 0.5)).alias("__u"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tps") / (F.col("tps") + F.col("fps")))
              .otherwise(F.lit(0.0))).alias("__s"),
        F.max("tps_total").alias("__p"), F.max("fps_total").alias("__n"))
    return agg.select(*by,
                      F.when((F.col("__p") > 0) & (F.col("__n") > 0), F.col("__u") / (F.col("__p") * F.col("__n")))
                       .otherwise(F.lit(0.0)).cast("double").alias("roc_auc"),
                      F.when(F.col("__p") > 0, F.col("__s") / F.col("__p")).otherwise(F.lit(0.0))
                       .cast("double").alias("pr_auc"))


def classification_metrics(pred: DataFrame, by: list[str], y: str = "y", score: str = "score",
                           threshold: float = 0.5, eps: float = DOUBLE_EPS) -> DataFrame:
    """All 13 study metrics (+ tn, fp, fn, tp) per group; the predictions are evaluated once, to write their score levels."""
    levels = materialize(score_levels(pred, by, y, score))
    counts = threshold_metrics(confusion_counts(levels, by, threshold, eps), threshold)
    out = _join(counts, rank_metrics_from_levels(levels, by), by)
    return out.select(*by, *METRIC_COLUMNS, "tn", "fp", "fn", "tp")


def roc_curve(pred: DataFrame, by: list[str], y: str = "y", score: str = "score",
              drop_intermediate: bool = True) -> DataFrame:
    """ROC points (threshold, fpr, tpr) per group, thresholds high to low.

    Starts at (inf, 0, 0); with ``drop_intermediate`` a point is dropped when
    the counts added at its threshold equal those added at the next one
    (second difference zero), first and last thresholds always kept. The next
    level is found by an equi-join on the level ordinal, not by ``lead`` over
    a whole group. A rate whose class is absent from the group is NULL.
    """
    levels = materialize(score_levels(pred, by, y, score))
    run = running_totals(levels, by, [-F.col("score"), "score"],
                         {"tps": "pos", "fps": "neg", "idx": F.lit(1)}, with_totals=True, written=True)
    run = run.select(*by, "score", "pos", "neg", "tps", "fps", "idx",
                     F.col("tps_total").alias("P"), F.col("fps_total").alias("N"), F.col("idx_total").alias("m"))
    if drop_intermediate:
        nxt = run.select(*[F.col(c).alias(f"__n_{c}") for c in by], (F.col("idx") - 1).alias("__n_idx"),
                         F.col("pos").alias("__n_pos"), F.col("neg").alias("__n_neg"))
        cond = reduce(lambda a, b: a & b, [run[c].eqNullSafe(nxt[f"__n_{c}"]) for c in by],
                      run["idx"] == nxt["__n_idx"])
        run = run.join(nxt, cond, "left").where(
            (F.col("idx") == 1) | (F.col("idx") == F.col("m")) | (F.col("m") <= 2)
            | (F.col("__n_pos") != F.col("pos")) | (F.col("__n_neg") != F.col("neg")))
    pts = run.select(*by, F.col("score").alias("threshold"),
                     F.try_divide("fps", "N").alias("fpr"), F.try_divide("tps", "P").alias("tpr"))
    start = levels.groupBy(*by).agg(F.sum("pos").alias("P")).select(
        *by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def _replicated(rows: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """The plain form of the bootstrap's weights, for small inputs: each row once for each replicate ``__b`` with its weight ``__w``.

    Zero weights stay: a filter would make Catalyst inline the md5 uniform
    into every branch of the weight's CASE.
    """
    u = uniform_sql(f"concat(CAST({key} AS STRING), '|', CAST(__b AS STRING), '|{seed}')")
    return (rows.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
                .withColumn("__u", F.expr(u)).withColumn("__w", F.expr(poisson1_sql("__u")).cast("double")).drop("__u"))


def bootstrap_ci(pred: DataFrame, by: list[str], key: str, y: str = "y", score: str = "score",
                 metric: str = "f1", replicates: int = 200, seed: int = 42, threshold: float = 0.5,
                 lower: float = 0.025, upper: float = 0.975) -> DataFrame:
    """Percentile bootstrap interval of F1 or ROC-AUC per group.

    Poisson(1) bootstrap: replicate b gives each row weight Poisson(1) drawn
    from md5(key, b, seed) -- the same weights for every model (paired), and
    identical after retries. Replicates are vectors all the way (see
    ``bootstrap``): no row is expanded. AUC replicates with a single class are
    skipped; rows without a key share one weight vector. Intervals use
    linear-interpolated percentiles over the (bounded) replicate values of
    each group.
    """
    if metric == "f1":
        values = replicate_f1(pred, by, key, y, score, threshold, replicates, seed)
    elif metric == "roc_auc":
        values = replicate_auc(pred, by, key, y, score, replicates, seed)
    else:
        raise ValueError(f"unsupported bootstrap metric {metric}")
    return values.groupBy(*by).agg(
        F.percentile("v", F.array(F.lit(lower), F.lit(upper))).alias("__q"),
        F.count(F.lit(1)).alias("replicates")).select(
        *by, F.col("__q")[0].alias("lower"), F.col("__q")[1].alias("upper"), "replicates")


HEATMAP_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "balanced_accuracy"]


def metric_heatmap(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Models x six metrics, best F1 first."""
    return metrics.select(model, *HEATMAP_METRICS).orderBy(F.col("f1").desc(), F.col(model))

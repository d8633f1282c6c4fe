"""Registered study queries over the shared tables.

Each function takes (spark, sf_dir) and returns a lazy DataFrame; the check
tool runs them next to ANSI-SQL oracles. Doubles whose last bits depend on
summation order are rounded in the query definition (and identically in
the oracle) so the comparison is about logic, not float association.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import features, metrics, profile, schema, split, stats, validate
from tessera.sources import testdata as td

R = 9  # decimals kept for order-dependent doubles


def _r(c, d: int = R):
    """Round half up by plain IEEE steps, floor(x * 10^d + 0.5) / 10^d, so any engine that
    holds the same double produces the same digits; huge or non-finite values pass unchanged."""
    x = F.col(c) if isinstance(c, str) else c
    scale = float(10 ** d)
    return F.when(F.abs(x) < F.lit(1e15 / scale), F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)).otherwise(x)


# --------------------------------------------------------------------------
# Slice 1: ingest, schema, validation, profiling
# --------------------------------------------------------------------------

def q_normalize_upload(spark: SparkSession, sf: str) -> DataFrame:
    """Messy headers -> canonical names (aliases, slugs), required columns present."""
    df, _ = schema.normalize_columns(td.upload_frame(spark, sf), td.ORDER_SPEC)
    schema.require_columns(df, td.ORDER_SPEC)
    return df


def q_coerce(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric coercion (text -> NULL), categorical to string, target vocabulary + numeric parse."""
    df, _ = schema.normalize_columns(td.upload_frame(spark, sf), td.ORDER_SPEC)
    return validate.coerce(df, td.ORDER_SPEC).withColumnRenamed("result", "result_value")


def q_validation_counters(spark: SparkSession, sf: str) -> DataFrame:
    """One-pass counters of the validation step."""
    df, _ = schema.normalize_columns(td.upload_frame(spark, sf), td.ORDER_SPEC)
    staged = validate.coerce(validate._with_raw(df, td.ORDER_SPEC), td.ORDER_SPEC)
    return validate.validation_counters(staged, td.ORDER_SPEC)


def q_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Validated study table (class 2 excluded, binary int target)."""
    return validate.validate(td.upload_frame(spark, sf), td.ORDER_SPEC).frame


def q_clean_observed(spark: SparkSession, sf: str) -> DataFrame:
    """P8-P10 in one evaluation of the upload: clean rows beside the counters observed while they were written."""
    v = validate.validate_observed(td.upload_frame(spark, sf), td.ORDER_SPEC)
    names = ["rows_in", "rows_excluded", "rows_invalid", "non_numeric_order_month", "n_classes"]
    return v.frame.withColumns({c: F.lit(v.metrics[c]).cast("long") for c in names})


def q_quarantine_observed(spark: SparkSession, sf: str) -> DataFrame:
    """P9 (quarantine mode) in one evaluation: rejected rows, as ``quarantine``."""
    v = validate.validate_observed(td.upload_frame(spark, sf, messy_target=True), td.ORDER_SPEC, invalid="quarantine")
    return v.quarantine.select("order_key", F.col("result").alias("result_value"))


def q_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """P9 (quarantine mode): rows whose target is missing or not binary."""
    v = validate.validate(td.upload_frame(spark, sf, messy_target=True), td.ORDER_SPEC, invalid="quarantine")
    return v.quarantine.select("order_key", F.col("result").alias("result_value"))


ORDER_RULES = {
    "price_not_positive": "total_price <= 0",
    "balance_negative": "account_balance < 0",
    "month_out_of_range": "order_month < 1 OR order_month > 12",
}


def q_range_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Row rules -> list of violated rule names; rows pass when the list is empty."""
    obs = td.observations(spark, sf)
    checked = validate.rule_violations(obs, ORDER_RULES, required=["account_balance", "market_segment"])
    return checked.select("order_key", F.array_join("violations", ",").alias("violations"),
                          (F.size("violations") == 0).alias("passes"))


def q_threshold_class(spark: SparkSession, sf: str) -> DataFrame:
    """Score -> class at a threshold and recommendation text."""
    obs = td.observations(spark, sf)
    s = F.expr(td.score_sql("order_key", "result", "scorer_a"))
    return obs.select("order_key", _r(s).alias("score"),
                      validate.to_class(s, 0.5).alias("predicted_class"),
                      validate.recommendation(s, 0.5).alias("recommendation"))


def q_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1: rows and columns of the clean table."""
    return profile.counts(td.observations(spark, sf))


def q_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """A2: duplicate rows of events projected to (event_type, floor(value))."""
    ev = td.table(spark, sf, "events").select("event_type", F.floor("value").alias("value_floor"))
    return profile.duplicate_rows(ev)


def q_missing(spark: SparkSession, sf: str) -> DataFrame:
    """A3: missing values per column of the coerced upload."""
    return profile.missing_by_column(q_coerce(spark, sf))


def q_class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A5: class counts of the clean table."""
    return profile.class_distribution(td.observations(spark, sf), "result")


LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount"]


def q_describe_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Describe (count, mean, std, min, quartiles, max) of lineitem numerics, exact quantiles."""
    d = profile.describe_numeric(td.table(spark, sf, "lineitem"), LINE_NUMERIC)
    return d.select("column", "count", _r("mean", 6).alias("mean"), _r("std", 6).alias("std"), "min",
                    _r("q25", 6).alias("q25"), _r("q50", 6).alias("q50"), _r("q75", 6).alias("q75"), "max")


def q_describe_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """A6 (sketch form): lineitem's sketches stored for each month of shipping, merged later; quartiles held against their exact ranks."""
    from tessera.session import materialize
    lines = td.table(spark, sf, "lineitem")
    parts = materialize(profile.sketch_numeric(lines.withColumn("month", F.date_format("l_shipdate", "yyyy-MM")), LINE_NUMERIC, ["month"]))
    d = materialize(profile.describe_sketches(parts))
    return d.join(profile.rank_errors(lines, d, LINE_NUMERIC), "column").select(
        "column", "count", _r("mean", 6).alias("mean"), _r("std", 6).alias("std"), "min", "max",
        (F.col("rank_error") <= profile.RANK_ERROR).alias("quartiles_fit"))


def q_describe_categorical(spark: SparkSession, sf: str) -> DataFrame:
    """Count, unique, top, freq of the categorical columns."""
    return profile.describe_categorical(td.observations(spark, sf),
                                        ["order_status", "order_priority", "market_segment"])


def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """24-bin histograms of the study numerics."""
    h = profile.histogram(td.observations(spark, sf), list(td.ORDER_SPEC.numeric))
    return h.select("column", "bin", _r("lower", 6).alias("lower"), _r("upper", 6).alias("upper"), "count")


def q_box_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Box-plot statistics of the study numerics."""
    b = profile.box_stats(td.observations(spark, sf), list(td.ORDER_SPEC.numeric))
    return b.select("column", _r("q1", 6).alias("q1"), _r("median", 6).alias("median"), _r("q3", 6).alias("q3"),
                    _r("iqr", 6).alias("iqr"), "whisker_low", "whisker_high", "outliers")


def q_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """A10: Pearson matrix of numerics and target."""
    c = profile.correlation(td.observations(spark, sf), [*td.ORDER_SPEC.numeric, "result"])
    return c.select("a", "b", _r("r").alias("r"))


def q_category_class(spark: SparkSession, sf: str) -> DataFrame:
    """Category x class counts."""
    return profile.category_class_counts(td.observations(spark, sf),
                                         ["order_status", "order_priority", "market_segment"], "result")


def q_class_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced class weights on the labels table (quality), applied when imbalance >= 1.5."""
    labels = td.table(spark, sf, "labels")
    w = profile.class_weights(labels, "quality")
    return w.select("class", "rows", _r("weight").alias("weight"))


# --------------------------------------------------------------------------
# Slice 2: splits and features
# --------------------------------------------------------------------------

SEED = 42
FOLDS = 5
NUMERIC = list(td.ORDER_SPEC.numeric)
CATEGORICAL = list(td.ORDER_SPEC.categorical)


def study_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows with the exact stratified hold-out flag and train folds."""
    return split.study_split(td.observations(spark, sf), "result", "order_key", 0.2, FOLDS, SEED)


def q_holdout_split(spark: SparkSession, sf: str) -> DataFrame:
    """Exact stratified 80/20 hold-out (md5-ranked within class)."""
    return study_rows(spark, sf).select("order_key", "result", "is_test")


def q_kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    """R2: stratified 5-fold assignment of the training rows."""
    return study_rows(spark, sf).where(~F.col("is_test")).select("order_key", "result", "fold")


def q_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """R1/R2 invariants: rows per (split, fold, class)."""
    return study_rows(spark, sf).groupBy("is_test", "fold", "result").agg(F.count(F.lit(1)).alias("rows"))


def q_inner_split(spark: SparkSession, sf: str) -> DataFrame:
    """Inner stratified 80/20 split of the training rows (for tuning)."""
    train = study_rows(spark, sf).where(~F.col("is_test")).drop("is_test", "fold")
    inner = split.stratified_holdout(train, "result", "order_key", 0.2, SEED, salt="tune")
    return inner.select("order_key", "result", F.col("is_test").alias("is_validation"))


def q_head_sample(spark: SparkSession, sf: str) -> DataFrame:
    """First 1000 clean rows by key (report sample)."""
    return split.head_sample(td.observations(spark, sf), "order_key", 1000)


def q_preprocess_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Fit median/scale/mode/one-hot on train rows, apply to the test rows."""
    rows = _cut(study_rows(spark, sf))
    pre = features.fit_preprocessor(rows.where(~F.col("is_test")), NUMERIC, CATEGORICAL)
    out = pre.transform(rows.where(F.col("is_test")), keep=["order_key"])
    return out.select("order_key", *[_r(c).alias(c) for c in NUMERIC],
                      *[F.col(f"`{c}`") for c in out.columns if "=" in c])


def q_onehot_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """one-hot features of a column with as many levels as rows, fitted on four fifths of the customers: indices of all."""
    from tessera.operators.preparation import Preparation
    rows = td.table(spark, sf, "customer").selectExpr("c_custkey", "c_name", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS segment")
    fitted = Preparation(categorical=["c_name", "segment"]).fit(rows.where("c_custkey % 5 <> 0"))
    return fitted.sparse(rows, ["c_custkey"]).select("c_custkey", "width", F.array_join("indices", ",").alias("indices"))


def q_prepared_values(spark: SparkSession, sf: str) -> DataFrame:
    """F1-F5 as a spark.ml stage: the hold-out rows' vectors, as ``preprocess_apply``'s columns."""
    from pyspark.ml.functions import vector_to_array
    from tessera.operators.preparation import Preparation
    rows = _cut(study_rows(spark, sf))
    fitted = Preparation(numeric=NUMERIC, categorical=CATEGORICAL).fit(rows.where(~F.col("is_test")))
    out = fitted.transform(rows.where(F.col("is_test"))).select("order_key", vector_to_array("features").alias("x"))
    return out.select("order_key", F.size("x").alias("width"), *[_r(F.col("x")[i]).alias(c) for i, c in enumerate(NUMERIC)],
                      F.aggregate(F.slice("x", len(NUMERIC) + 1, 1000), F.lit(0.0), lambda a, v: a + v).alias("levels_set"))


def q_fold_numeric_stats(spark: SparkSession, sf: str) -> DataFrame:
    """per-fold training medians, means and scales, all folds in one pass."""
    rows = study_rows(spark, sf).where(~F.col("is_test"))
    num, _ = features.fold_statistics(rows, NUMERIC, CATEGORICAL, FOLDS)
    return num.select("fold", "column", _r("median", 6).alias("median"), _r("mean", 6).alias("mean"),
                      _r("scale", 6).alias("scale"))


def q_fold_category_stats(spark: SparkSession, sf: str) -> DataFrame:
    """per-fold training modes and level counts."""
    rows = study_rows(spark, sf).where(~F.col("is_test"))
    _, cat = features.fold_statistics(rows, NUMERIC, CATEGORICAL, FOLDS)
    return cat


# --------------------------------------------------------------------------
# Slice 3: metrics over model scores
# --------------------------------------------------------------------------

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long predictions (order_key, y, model, score, is_test, fold) for the five stand-in scorers."""
    # the scorers read the key and the target alone, so the split need not write the features
    rows = split.study_split(td.observations(spark, sf).select("order_key", "result"), "result", "order_key", 0.2, FOLDS, SEED)
    return td.scored(rows, "order_key", "result", SEED, keep=["is_test", "fold"]).withColumnRenamed("result", "y")


class Evaluation:
    """What several tables of one report read, each evaluated once, when first asked for, and written to the shared folder."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def predictions(self) -> DataFrame:
        return shared_predictions(self.spark, self.sf)

    @cached_property
    def folds(self) -> DataFrame:
        """All metrics per (model, fold)."""
        return _cut(metrics.classification_metrics(self.predictions.where(~F.col("is_test")), ["model", "fold"]))

    @cached_property
    def test(self) -> DataFrame:
        """All metrics per model on the hold-out rows."""
        return _cut(metrics.classification_metrics(self.predictions.where(F.col("is_test")), ["model"]))


def _round_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, *[_r(c, 10).alias(c) if c not in ("n", "threshold") else F.col(c)
                            for c in metrics.METRIC_COLUMNS], "tn", "fp", "fn", "tp")


def q_cv_metrics(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """E1-E11 per (model, fold) on the validation folds (the fold-score table)."""
    if study:
        return _round_metrics(study.folds, ["model", "fold"])
    p = predictions(spark, sf).where(~F.col("is_test"))
    return _round_metrics(metrics.classification_metrics(p, ["model", "fold"]), ["model", "fold"])


def q_test_metrics(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """E1-E11 per model on the hold-out rows."""
    if study:
        return _round_metrics(study.test, ["model"])
    p = predictions(spark, sf).where(F.col("is_test"))
    return _round_metrics(metrics.classification_metrics(p, ["model"]), ["model"])


def q_roc_curve(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """ROC points per model on the hold-out rows (collinear interior points dropped)."""
    p = (study.predictions if study else predictions(spark, sf)).where(F.col("is_test"))
    c = metrics.roc_curve(p, ["model"])
    return c.select("model", "threshold", _r("fpr", 12).alias("fpr"), _r("tpr", 12).alias("tpr"))


def q_metric_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    """Models x six metrics, sorted by F1."""
    return metrics.metric_heatmap(q_test_metrics(spark, sf))


def q_bootstrap_f1(spark: SparkSession, sf: str) -> DataFrame:
    """200-replicate percentile interval of test F1 per model."""
    p = predictions(spark, sf).where(F.col("is_test"))
    b = metrics.bootstrap_ci(p, ["model"], "order_key", metric="f1", replicates=200, seed=SEED)
    return b.select("model", _r("lower", 10).alias("lower"), _r("upper", 10).alias("upper"), "replicates")


def q_bootstrap_auc(spark: SparkSession, sf: str) -> DataFrame:
    """200-replicate percentile interval of test ROC-AUC per model."""
    p = predictions(spark, sf).where(F.col("is_test"))
    b = metrics.bootstrap_ci(p, ["model"], "order_key", metric="roc_auc", replicates=200, seed=SEED)
    return b.select("model", _r("lower", 10).alias("lower"), _r("upper", 10).alias("upper"), "replicates")


def q_bootstrap_auc_1000(spark: SparkSession, sf: str) -> DataFrame:
    """R5 at the study's full number of replicates."""
    p = predictions(spark, sf).where(F.col("is_test"))
    b = metrics.bootstrap_ci(p, ["model"], "order_key", metric="roc_auc", replicates=1000, seed=SEED)
    return b.select("model", _r("lower", 10).alias("lower"), _r("upper", 10).alias("upper"), "replicates")


# --------------------------------------------------------------------------
# Slice 4: paired statistical tests
# --------------------------------------------------------------------------

T_ROUND = {"mean_difference": 6, "sd_difference": 6, "ci95_low": 6, "ci95_high": 6, "cohen_d_paired": 9,
           "t_statistic": 9, "p_value": 10, "p_value_holm": 10, "statistic": 6, "positive_rank_sum": 6,
           "negative_rank_sum": 6, "effect": 9, "kendall_w": 9}


def _round_cols(df: DataFrame, table: dict = T_ROUND) -> DataFrame:
    return df.select(*[_r(c, table[c]).alias(c) if c in table else F.col(c) for c in df.columns])


def _orders_tables(spark, sf, by_status=False):
    fam = ["family"] if by_status else []
    raw = td.fold_scores(spark, sf, by_status)
    comp = stats.complete_blocks(raw, fam, "block", "treatment", "value")
    return fam, raw, comp


def q_complete_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Complete-case (block x treatment) table of the order fold scores."""
    _, _, comp = _orders_tables(spark, sf)
    return comp.select("block", "treatment", _r("value", 6).alias("value"))


def q_applicability(spark: SparkSession, sf: str) -> DataFrame:
    """Treatments, complete blocks and Friedman availability per family."""
    fam, raw, comp = _orders_tables(spark, sf, by_status=True)
    return stats.applicability(raw, fam, "block", "treatment", "value", comp)


def q_friedman(spark: SparkSession, sf: str) -> DataFrame:
    """Friedman test + Kendall W over order months (blocks) x priorities (treatments)."""
    fam, _, comp = _orders_tables(spark, sf)
    return _round_cols(stats.friedman(comp, fam, "block", "treatment", "value").drop("interpretation"))


def q_friedman_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """T9/T10 for several independent families at once (family = order status)."""
    fam, _, comp = _orders_tables(spark, sf, by_status=True)
    return _round_cols(stats.friedman(comp, fam, "block", "treatment", "value").drop("interpretation"))


def q_paired_t(spark: SparkSession, sf: str) -> DataFrame:
    """Paired t per priority pair with CI, Cohen d, direction and Holm."""
    fam, _, comp = _orders_tables(spark, sf)
    d = stats.paired_differences(comp, fam, "block", "treatment", "value")
    return _round_cols(stats.paired_t(d, fam).drop("interpretation"))


def q_paired_t_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """T1-T5, T11, T12 with one Holm family per order status."""
    fam, _, comp = _orders_tables(spark, sf, by_status=True)
    d = stats.paired_differences(comp, fam, "block", "treatment", "value")
    return _round_cols(stats.paired_t(d, fam).drop("interpretation"))


def q_wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    """Signed-rank test per priority pair (normal approximation at this size)."""
    fam, _, comp = _orders_tables(spark, sf)
    d = stats.paired_differences(comp, fam, "block", "treatment", "value")
    return _round_cols(stats.wilcoxon(d, fam).drop("interpretation"))


def _cut(df: DataFrame) -> DataFrame:
    """Write a small intermediate result once (shared checkpoint folder); its consumers re-read it."""
    from tessera.session import materialize
    return materialize(df)


def cv_scores(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """Fold-score table (model, fold, f1, roc_auc, recall) from the cross-validation metrics."""
    if study:
        folds = study.folds
    else:
        folds = metrics.classification_metrics(predictions(spark, sf).where(~F.col("is_test")), ["model", "fold"])
    return folds.select("model", "fold", "f1", "roc_auc", "recall")


def q_cv_tests(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """T1-T8, T11, T12, T14 on the model x fold F1 table: paired t and signed-rank (exact) side by side."""
    cv = cv_scores(spark, sf, study) if study else _cut(cv_scores(spark, sf))
    comp = stats.complete_blocks(cv, [], "fold", "model", "f1")
    d = stats.paired_differences(comp, [], "fold", "model", "f1")
    t = stats.paired_t(d, []).select("model_a", "model_b", "n", "mean_difference", "t_statistic",
                                     F.col("p_value").alias("t_p_value"), F.col("p_value_holm").alias("t_p_holm"),
                                     F.col("significant").alias("t_significant"),
                                     F.col("interpretation").alias("t_interpretation"))
    w = stats.wilcoxon(d, []).select("model_a", "model_b", F.col("statistic").alias("w_statistic"),
                                     F.col("p_value").alias("w_p_value"), F.col("p_value_holm").alias("w_p_holm"),
                                     F.col("method").alias("w_method"))
    out = t.join(w, ["model_a", "model_b"])
    return out.select("model_a", "model_b", "n", _r("mean_difference", 10).alias("mean_difference"),
                      _r("t_statistic", 6).alias("t_statistic"), _r("t_p_value", 10).alias("t_p_value"),
                      _r("t_p_holm", 10).alias("t_p_holm"), "t_significant", "t_interpretation",
                      _r("w_statistic", 6).alias("w_statistic"), _r("w_p_value", 10).alias("w_p_value"),
                      _r("w_p_holm", 10).alias("w_p_holm"), "w_method")


def q_cv_friedman(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """T9/T10/T14 on the model x fold F1 table."""
    cv = cv_scores(spark, sf, study) if study else _cut(cv_scores(spark, sf))
    comp = stats.complete_blocks(cv, [], "fold", "model", "f1")
    return _round_cols(stats.friedman(comp, [], "fold", "model", "f1"))


def shared_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written once to the shared checkpoint folder, for queries that read them several times."""
    from tessera.session import materialize
    return materialize(predictions(spark, sf))


def model_comparison(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """A13 + J4: test metrics per model with the CV summary attached."""
    study = study or Evaluation(spark, sf)
    cv = cv_scores(spark, sf, study)
    summary = cv.groupBy("model").agg(
        F.avg("f1").alias("cv_f1_mean"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("cv_f1_std"),
        F.avg("roc_auc").alias("cv_roc_auc_mean"), F.avg("recall").alias("cv_recall_mean"))
    return study.test.join(summary, "model")


def ranking():
    """Selection order: cv F1, AUC, recall descending, F1 std ascending, then name."""
    return [F.col("cv_f1_mean").desc(), F.col("cv_roc_auc_mean").desc(), F.col("cv_recall_mean").desc(),
            F.col("cv_f1_std").asc(), F.col("model").asc()]


def q_model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """M8 + A13 + J4: comparison table with the selection rank (cv F1, AUC, recall desc; F1 std asc)."""
    comp = model_comparison(spark, sf)
    ranked = comp.withColumn("rank", F.row_number().over(Window.orderBy(*ranking())))
    return ranked.select("model", "rank", *[_r(c, 10).alias(c) for c in
                                            ["f1", "roc_auc", "recall", "cv_f1_mean", "cv_f1_std",
                                             "cv_roc_auc_mean", "cv_recall_mean"]])


def q_model_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean F1 per model over complete folds, best first."""
    comp = stats.complete_blocks(_cut(cv_scores(spark, sf)), [], "fold", "model", "f1")
    return comp.groupBy("model").agg(_r(F.avg("f1"), 10).alias("mean_f1")).orderBy(F.col("mean_f1").desc())


def q_cv_page_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Overall mean and sample std of fold F1, number of distinct folds."""
    cv = cv_scores(spark, sf)
    return cv.agg(_r(F.avg("f1"), 10).alias("mean_f1"), _r(F.stddev_samp("f1"), 10).alias("std_f1"),
                  F.count_distinct("fold").alias("folds"))


def best_model(spark: SparkSession, sf: str, study: Evaluation | None = None) -> str:
    """Name of the first model of the ranking (one row to the driver)."""
    return model_comparison(spark, sf, study).orderBy(*ranking()).select("model").first()["model"]


def q_mcnemar(spark: SparkSession, sf: str, study: Evaluation | None = None) -> DataFrame:
    """T13 + J2 + J5: best model vs each competitor on the hold-out rows."""
    study = study or Evaluation(spark, sf)
    best = best_model(spark, sf, study)
    p = study.predictions.where(F.col("is_test"))
    m = stats.mcnemar(p, best, "order_key")
    return m.select("best", "competitor", "both_correct", "best_only_correct", "competitor_only_correct",
                    "both_wrong", _r("statistic", 9).alias("statistic"), _r("p_value", 12).alias("p_value"))


def q_significance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Significant comparisons per family (paired t over order statuses) and positive predictions."""
    fam, _, comp = _orders_tables(spark, sf, by_status=True)
    t = stats.paired_t(stats.paired_differences(comp, fam, "block", "treatment", "value"), fam)
    return stats.significance_counts(t, fam)


def q_positive_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Positive predictions per model on the hold-out rows."""
    p = predictions(spark, sf).where(F.col("is_test"))
    return p.groupBy("model").agg(F.count_if(F.col("score") >= 0.5).alias("positive_predictions"),
                                  F.count(F.lit(1)).alias("rows"))


# --------------------------------------------------------------------------
# Slice 5: models (spark.ml) -- fits are not SQL-expressible; what they must satisfy is
# --------------------------------------------------------------------------

# The study table's target is unrelated to its features, so a network can learn
# nothing from it. These queries learn on which side of a plane an embedding
# lies, from four of its components, and return what any right implementation must: the same
# rows, sums that add up, and quality above a floor that a constant misses.
EMBEDDING_NUMERIC = [f"x{i}" for i in range(4)]
AUC_FLOOR, F1_FLOOR = 0.75, 0.6


def embedding_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, x0..x3, side, result, is_test, fold): the embedding study, split like the other."""
    e = td.table(spark, sf, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMBEDDING_NUMERIC)],
        F.when(F.col("embedding")[4] > 0, "up").otherwise("down").alias("side"),
        (F.col("embedding")[0] + F.col("embedding")[1] > F.col("embedding")[2]).cast("int").alias("result"))
    return split.study_split(e, "result", "vec_id", 0.2, FOLDS, SEED)


def _embedding_rows_cut(spark: SparkSession, sf: str) -> DataFrame:
    """Study rows written once to the shared checkpoint folder: every fit re-reads them."""
    from tessera.session import materialize
    return materialize(embedding_rows(spark, sf))


def _fit(rows: DataFrame, name: str, max_iter: int = 40):
    from tessera.operators import models
    return models.fit(rows.where(~F.col("is_test")), models.ModelConfig(name, max_iter=max_iter, rbf_gamma=0.2), EMBEDDING_NUMERIC, ["side"], "result", "vec_id")


def _checked(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows of each class, and whether scores, counts and quality are as they must be."""
    m = metrics.classification_metrics(scored, by)
    sane = scored.groupBy(*by).agg(F.bool_and(F.col("score").between(0, 1)).alias("scores_valid"))
    return m.join(sane, by).select(
        *by, F.col("n").alias("rows"), (F.col("tp") + F.col("fn")).alias("positives"), "scores_valid",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp") == F.col("n")).alias("counts_add_up"),
        (F.col("roc_auc") >= AUC_FLOOR).alias("auc_above_floor"), (F.col("f1") >= F1_FLOOR).alias("f1_above_floor"))


def _fit_score(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = _embedding_rows_cut(spark, sf)
    scored = _fit(rows, name).score(rows.where(F.col("is_test")), keep=["vec_id", "result"])
    return _checked(scored.withColumnRenamed("result", "y").withColumn("model", F.lit(name)), ["model"])


def q_mlp_fit_score(spark: SparkSession, sf: str) -> DataFrame:
    """M1 + M10: MLP 64-32 fitted on the training rows, hold-out rows scored in bulk."""
    return _fit_score(spark, sf, "MLP")


def q_dnn_fit_score(spark: SparkSession, sf: str) -> DataFrame:
    """M2 + M10: deep MLP 128-64-32-16."""
    return _fit_score(spark, sf, "DNN")


def q_rbf_fit_score(spark: SparkSession, sf: str) -> DataFrame:
    """M3 + M4 + M10: k-means centres -> Gaussian kernel features -> MLP 32."""
    return _fit_score(spark, sf, "RBF")


def q_cross_validate(spark: SparkSession, sf: str) -> DataFrame:
    """M5: 5-fold cross-validation of the three networks; one line for each model and fold."""
    from tessera.operators import models
    from tessera.session import materialize
    rows = _embedding_rows_cut(spark, sf).where(~F.col("is_test"))
    configs = [models.ModelConfig(n, max_iter=30, rbf_gamma=0.2) for n in models.BUILT]
    preds = materialize(models.cross_validate(rows, configs, FOLDS, EMBEDDING_NUMERIC, ["side"], key="vec_id"))
    # single folds are small: their floor is that of a scorer that knows something
    return _checked(preds, ["model", "fold"]).drop("auc_above_floor", "f1_above_floor").join(
        _checked(preds, ["model"]).select("model", "auc_above_floor", "f1_above_floor"), "model")


def q_tune(spark: SparkSession, sf: str) -> DataFrame:
    """M6: four seeded trials of the MLP scored on an inner validation split (never test)."""
    from tessera.operators import models
    rows = _embedding_rows_cut(spark, sf).where(~F.col("is_test")).drop("is_test", "fold")
    inner = split.stratified_holdout(rows, "result", "vec_id", 0.2, SEED, salt="tune").withColumnRenamed("is_test", "is_validation")
    trials = models.tune(inner, models.ModelConfig("MLP", max_iter=30), 4, EMBEDDING_NUMERIC, ["side"], key="vec_id")
    return trials.agg(F.count(F.lit(1)).alias("trials"), F.count_distinct("params").alias("settings"), F.count_if("best").alias("best"),
                      (F.max(F.when(F.col("best"), F.col("value"))) == F.max("value")).alias("best_is_highest"),
                      (F.max("value") >= F1_FLOOR).alias("f1_above_floor"), (F.count_distinct("value") > 1).alias("settings_matter"))


def q_tune_step_size(spark: SparkSession, sf: str) -> DataFrame:
    """M6 with learning rates: eight trials of gradient descent, the worse half stopped twice; preparation fitted once."""
    from tessera.operators import models
    rows = _embedding_rows_cut(spark, sf).where(~F.col("is_test")).drop("is_test", "fold")
    inner = split.stratified_holdout(rows, "result", "vec_id", 0.2, SEED, salt="tune").withColumnRenamed("is_test", "is_validation")
    base = models.ModelConfig("MLP", max_iter=40, solver="gd")
    trials = models.tune(inner, base, 8, EMBEDDING_NUMERIC, ["side"], key="vec_id", metric="roc_auc", halvings=2)
    setting = lambda name: F.get_json_object("params", f"$.{name}").cast("double")
    step, full = setting("step_size"), F.col("rounds") == setting("max_iter").cast("int")
    return trials.agg(F.count(F.lit(1)).alias("trials"), F.count_distinct(step).alias("step_sizes"), F.bool_and(step.between(*models.STEPS)).alias("steps_in_range"),
                      F.count_if(full).alias("trained_to_the_end"), F.count_if("best").alias("best"),
                      (F.max(F.when(F.col("best"), F.col("value"))) == F.max(F.when(full, F.col("value")))).alias("best_is_highest"),
                      (F.max(F.when(F.col("best"), F.col("value"))) >= AUC_FLOOR).alias("auc_above_floor"),
                      (F.count_distinct("value") > 1).alias("settings_matter"))


def q_persist_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + S10 + M10: save the fitted network and preprocessing, load them back: every hold-out score is the same."""
    import uuid
    from tessera.operators import models
    from tessera.session import ensure_checkpoint_dir
    rows = _embedding_rows_cut(spark, sf)
    m = _fit(rows, "MLP", 30)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    models.save(m, path, 0.5, {"model_name": "MLP"})
    loaded, threshold, meta = models.load(path)
    test = rows.where(F.col("is_test"))
    both = m.score(test, ["vec_id"]).join(loaded.score(test, ["vec_id"], "again"), "vec_id")
    return both.select("vec_id", (F.col("score") == F.col("again")).alias("same_score"), F.lit(threshold).alias("threshold"),
                       F.lit(meta.get("model_name")).alias("model"))


def _fitted_pipeline(rows: DataFrame):
    """Preparation and network in one pipeline, fitted on the training rows, saved and loaded: (fitted, loaded, path)."""
    import uuid
    from pyspark.ml import Pipeline, PipelineModel
    from tessera.operators.preparation import Network, Preparation
    from tessera.session import ensure_checkpoint_dir
    stages = [Preparation(numeric=NUMERIC, categorical=CATEGORICAL), Network(target="result", hidden=[16, 8], maxIter=15)]
    fitted = Pipeline(stages=stages).fit(rows.where(~F.col("is_test")))
    path = f"{ensure_checkpoint_dir(rows.sparkSession)}/models/{uuid.uuid4().hex}"
    fitted.write().overwrite().save(path)
    return fitted, PipelineModel.load(path), path


def q_pipeline_persist(spark: SparkSession, sf: str) -> DataFrame:
    """F5 + S7 + M10: preparation and network as one saved and loaded PipelineModel: every hold-out score is the same."""
    from tessera.operators.preparation import PipelineScorer
    rows = _cut(study_rows(spark, sf))
    fitted, loaded, _ = _fitted_pipeline(rows)
    test = rows.where(F.col("is_test"))
    both = PipelineScorer(fitted).score(test, ["order_key"]).join(PipelineScorer(loaded).score(test, ["order_key"], "again"), "order_key")
    return both.select("order_key", (F.col("score") == F.col("again")).alias("same_score"), F.col("score").between(0, 1).alias("score_valid"))


def q_stream_model_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """M10 + P5-P7 + F1-F5 on a stream: the loaded pipeline scores the first upload; a query of a new session goes on from its
    checkpoint with the second. Each row beside its batch score."""
    import uuid
    from pyspark.ml import PipelineModel
    from tessera.operators.preparation import PipelineScorer
    from tessera.session import ensure_checkpoint_dir
    from tessera.streaming import scoring
    _, loaded, path = _fitted_pipeline(_cut(study_rows(spark, sf)))
    name = uuid.uuid4().hex
    base = f"{ensure_checkpoint_dir(spark)}/stream-check/{name}"
    upload = td.upload_frame(spark, sf)

    def arrive(session: SparkSession, model, part: int) -> None:
        upload.where(F.col("Order Key") % 2 == part).write.mode("append").parquet(f"{base}/in")
        stream = scoring.read_uploads(session, f"{base}/in", upload.schema, fmt="parquet")
        scored = scoring.score_rows(stream, td.ORDER_SPEC, PipelineScorer(model), 0.5, keep=["order_key"], rules=ORDER_RULES)
        scoring.start(scored.select("order_key", "score", "predicted_class"), f"{base}/out", name=name, trigger_once=True).awaitTermination()

    arrive(spark, loaded, 0)
    again = spark.newSession()
    ensure_checkpoint_dir(again)
    arrive(again, PipelineModel.load(path), 1)
    batch = scoring.score_rows(upload, td.ORDER_SPEC, PipelineScorer(loaded), 0.5, keep=["order_key"]).select("order_key", F.col("score").alias("batch_score"))
    return spark.read.parquet(f"{base}/out").join(batch, "order_key").select(
        "order_key", (F.col("score") == F.col("batch_score")).alias("same_score"), ((F.col("score") >= 0.5).cast("int") == F.col("predicted_class")).alias("class_fits"))


RBF_GAMMA = 0.05


def q_rbf_kernel_features(spark: SparkSession, sf: str) -> DataFrame:
    """M4: Gaussian kernel features of every embedding against the per-label mean embeddings."""
    emb = td.table(spark, sf, "embeddings")
    dim = emb.select(F.max(F.size("embedding"))).first()[0]
    cents = emb.groupBy("label").agg(*[F.avg(F.col("embedding")[i]).alias(f"c{i}") for i in range(dim)]).orderBy(
        "label").collect()
    labels = [r["label"] for r in cents]
    centers = [[r[f"c{i}"] for i in range(dim)] for r in cents]
    out = features.rbf_features(emb.select("vec_id", "embedding"), "embedding", centers, RBF_GAMMA)
    pairs = F.arrays_zip(F.array(*[F.lit(x) for x in labels]).alias("center"), F.col("rbf").alias("value"))
    return out.select("vec_id", F.explode(pairs).alias("p")).select(
        "vec_id", F.col("p.center").alias("center"), _r(F.col("p.value"), 10).alias("value"))


# --------------------------------------------------------------------------
# Slice 6: sources and sinks
# --------------------------------------------------------------------------

def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S4: the upload written as CSV, read back (header, inferred types, encoding probe), validated."""
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    path = f"{ensure_checkpoint_dir(spark)}/uploads/{uuid.uuid4().hex}.csv"
    files.write_table(td.upload_frame(spark, sf), path, "csv")
    back = files.read_table(spark, path)
    v = validate.validate(back, td.ORDER_SPEC)
    return v.frame.withColumn("order_key", F.col("order_key").cast("bigint"))


def _csv_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cells of a CSV: missing-value words, quotes and line breaks."""
    return td.table(spark, sf, "customer").selectExpr(
        "c_custkey AS k", "CASE c_custkey % 5 WHEN 0 THEN 'NA' WHEN 1 THEN 'null' WHEN 2 THEN 'N/A' ELSE c_mktsegment END AS segment",
        "CASE WHEN c_custkey % 7 = 0 THEN 'NaN' ELSE CAST(c_custkey % 100 AS STRING) END AS units",
        "concat('line one of ', c_mktsegment, '\n', 'said \"two\", and 3') AS note")


def _reread(df: DataFrame) -> DataFrame:
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/uploads/{uuid.uuid4().hex}.csv"
    files.write_table(df, path, "csv")
    return files.read_table(df.sparkSession, path)


def q_csv_missing_words(spark: SparkSession, sf: str) -> DataFrame:
    """Missing-value words are NULL, and a column of numbers and such words is numeric."""
    return _reread(_csv_cells(spark, sf).select("k", "segment", "units")).groupBy("segment").agg(
        F.count(F.lit(1)).alias("rows"), F.count("units").alias("known"), F.sum("units").alias("total"))


def q_csv_multiline(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S4: quoted cells with line breaks, quotes and separators come back whole."""
    return _reread(_csv_cells(spark, sf).select("k", "note"))


def q_csv_multiline_split(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of many line breaks, from files that may be read in several splits each."""
    said = F.lit('\nsaid "it", then 3')
    lines = F.expr("CAST(pmod(o_orderkey, 5) AS INT)")
    return _reread(td.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("k"), F.concat("o_orderpriority", F.repeat(said, lines)).alias("note"), F.col("o_orderstatus").alias("status")))


def q_newest_file(spark: SparkSession, sf: str) -> DataFrame:
    """S3: of several files the one written last is found and read."""
    import time
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    folder = f"{ensure_checkpoint_dir(spark)}/uploads/{uuid.uuid4().hex}"
    nations = td.table(spark, sf, "nation").select("n_nationkey", "n_name")
    for upload in (1, 2):
        nations.withColumn("upload", F.lit(upload)).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # file times may have whole seconds
    return files.read_table(spark, files.newest_file(spark, folder))


def q_report_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison table written to a report folder and read back."""
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    folder = f"{ensure_checkpoint_dir(spark)}/reports/{uuid.uuid4().hex}"
    files.write_report({"model_comparison": q_model_comparison(spark, sf)}, folder)
    return files.read_result(spark, folder, "model_comparison")


#: The tables of a whole report and the queries that make them.
REPORT_TABLES = {"quality": "quality_report", "describe_categories": "describe_categorical", "histograms": "histogram", "box_stats": "box_stats",
                 "correlation": "correlation", "categories": "category_class", "cv_results": "cv_metrics", "test_metrics": "test_metrics",
                 "friedman": "cv_friedman", "paired_tests": "cv_tests", "mcnemar": "mcnemar", "roc_curves": "roc_curve"}
#: Those on the models' predictions, which a report evaluates once.
OF_MODELS = ("cv_metrics", "test_metrics", "cv_friedman", "cv_tests", "mcnemar", "roc_curve")


def q_report_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A whole report as JSON documents with their schemas, read back: what each column of each table holds."""
    import uuid
    from functools import reduce
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    folder = f"{ensure_checkpoint_dir(spark)}/reports/{uuid.uuid4().hex}"
    study = Evaluation(spark, sf)
    files.write_report({name: REGISTRY[query](spark, sf, *[study] * (query in OF_MODELS)) for name, query in REPORT_TABLES.items()}, folder, "json")

    def cells(name: str) -> DataFrame:
        table = files.read_result(spark, folder, name, "json")
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text"),
                                  (F.col(f"`{c}`").cast("string") if t == "boolean" else F.col(f"`{c}`")).try_cast("double").alias("number"))
                         for c, t in table.dtypes])
        return table.select(F.lit(name).alias("report_table"), F.explode(each).alias("cell")).select("report_table", "cell.*")

    known, words = F.col("text").isNotNull(), F.when(F.col("number").isNull(), F.col("text"))
    return reduce(DataFrame.unionByName, map(cells, REPORT_TABLES)).groupBy("report_table", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(known).alias("filled"), F.count_distinct("number").alias("numbers"),
        F.min("number").alias("least"), F.max("number").alias("greatest"),
        F.count_distinct(words).alias("words"), F.min(words).alias("first_word"), F.max(words).alias("last_word"))


def q_quality_report(spark: SparkSession, sf: str) -> DataFrame:
    """A1-A6 + P1/P2 renames + P5/P8 warnings: the data-quality document of the validated upload, long form."""
    v = validate.validate(td.upload_frame(spark, sf), td.ORDER_SPEC)
    report = profile.quality_report(v.frame, "result", v.excluded_rows, v.warnings, td.ORDER_SPEC.numeric,
                                    list(zip(v.original_columns, v.normalized_columns)))
    return report.withColumn("value", _r("value", 6))


def q_feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    """P11 + P12: features of rows that came without a target, beside the placeholder target."""
    untargeted = td.observations(spark, sf).drop("result")
    scoring = schema.with_default(untargeted, "result", 0)
    features_, target = schema.split_features(scoring, td.ORDER_SPEC)
    return scoring.select("order_key", *features_.columns, *target.columns)


def q_batch_export(spark: SparkSession, sf: str) -> DataFrame:
    """Scored rows exported as CSV with a header and read back with an explicit schema."""
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import files
    scored = q_threshold_class(spark, sf)
    path = f"{ensure_checkpoint_dir(spark)}/exports/{uuid.uuid4().hex}"
    files.write_table(scored, path, "csv")
    return spark.read.schema(scored.schema).option("header", True).csv(path)


def q_overall_interpretation(spark: SparkSession, sf: str) -> DataFrame:
    """One summary sentence per family from Friedman and the counts of significant pairs."""
    from tessera.plans.report import overall_interpretation
    fam, _, comp = _orders_tables(spark, sf, by_status=True)
    d = stats.paired_differences(comp, fam, "block", "treatment", "value")
    return overall_interpretation(stats.friedman(comp, fam, "block", "treatment", "value"),
                                  stats.paired_t(d, fam), stats.wilcoxon(d, fam), fam)


def q_labelled_join_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled join (documents x labels on doc_id) profiled as a study table: category x class
    counts of lang and source against the quality label, with the mean document length per cell."""
    docs = td.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = td.table(spark, sf, "labels").select("doc_id", "quality")
    joined = docs.join(labels, "doc_id")
    long = joined.select("quality", "n_chars", F.explode(F.array(
        F.struct(F.lit("lang").alias("column"), F.col("lang").alias("category")),
        F.struct(F.lit("source").alias("column"), F.col("source").alias("category")))).alias("u"))
    return long.groupBy(F.col("u.column").alias("column"), F.col("u.category").alias("category"),
                        F.col("quality").alias("class")).agg(
        F.count(F.lit(1)).alias("rows"), _r(F.avg("n_chars"), 6).alias("mean_chars"))


class _HashScore:
    """Stand-in scorer for the streaming check: P(class 1) = md5 uniform of the order key."""

    def score(self, df: DataFrame, keep: list[str], output: str = "score") -> DataFrame:
        from tessera.functions.hashing import uniform_sql
        return df.select(*keep, F.expr(uniform_sql("concat(CAST(order_key AS STRING), '|stream')")).alias(output))


def q_stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """P5-P7, P13, P15 on a stream: upload files scored as they arrive (availableNow trigger), read back."""
    import uuid
    from tessera.session import ensure_checkpoint_dir
    from tessera.streaming import scoring
    base = f"{ensure_checkpoint_dir(spark)}/stream-check/{uuid.uuid4().hex}"
    upload = td.upload_frame(spark, sf)
    upload.write.mode("overwrite").parquet(f"{base}/in")
    stream = scoring.read_uploads(spark, f"{base}/in", upload.schema, fmt="parquet")
    scored = scoring.score_rows(stream, td.ORDER_SPEC, _HashScore(), 0.5, keep=["order_key"], rules=ORDER_RULES)
    q = scoring.start(scored.select("order_key", F.array_join("violations", ",").alias("violations"),
                                    _r("score", 10).alias("score"), "predicted_class", "recommendation"),
                      f"{base}/out", trigger_once=True)
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


REGISTRY = {
    "normalize_upload": q_normalize_upload,
    "coerce": q_coerce,
    "validation_counters": q_validation_counters,
    "clean": q_clean,
    "clean_observed": q_clean_observed,
    "quarantine": q_quarantine,
    "quarantine_observed": q_quarantine_observed,
    "range_rules": q_range_rules,
    "threshold_class": q_threshold_class,
    "counts": q_counts,
    "duplicates": q_duplicates,
    "missing": q_missing,
    "class_distribution": q_class_distribution,
    "describe_lineitem": q_describe_lineitem,
    "describe_sketch": q_describe_sketch,
    "describe_categorical": q_describe_categorical,
    "histogram": q_histogram,
    "box_stats": q_box_stats,
    "correlation": q_correlation,
    "category_class": q_category_class,
    "class_weights": q_class_weights,
    "holdout_split": q_holdout_split,
    "kfold_assign": q_kfold_assign,
    "fold_sizes": q_fold_sizes,
    "inner_split": q_inner_split,
    "head_sample": q_head_sample,
    "preprocess_apply": q_preprocess_apply,
    "prepared_values": q_prepared_values,
    "onehot_sparse": q_onehot_sparse,
    "fold_numeric_stats": q_fold_numeric_stats,
    "fold_category_stats": q_fold_category_stats,
    "cv_metrics": q_cv_metrics,
    "test_metrics": q_test_metrics,
    "roc_curve": q_roc_curve,
    "metric_heatmap": q_metric_heatmap,
    "bootstrap_f1": q_bootstrap_f1,
    "bootstrap_auc": q_bootstrap_auc,
    "bootstrap_auc_1000": q_bootstrap_auc_1000,
    "complete_blocks": q_complete_blocks,
    "applicability": q_applicability,
    "friedman": q_friedman,
    "friedman_by_status": q_friedman_by_status,
    "paired_t": q_paired_t,
    "paired_t_by_status": q_paired_t_by_status,
    "wilcoxon": q_wilcoxon,
    "cv_tests": q_cv_tests,
    "cv_friedman": q_cv_friedman,
    "model_comparison": q_model_comparison,
    "model_means": q_model_means,
    "cv_page_summary": q_cv_page_summary,
    "mcnemar": q_mcnemar,
    "significance_counts": q_significance_counts,
    "positive_predictions": q_positive_predictions,
    "mlp_fit_score": q_mlp_fit_score,
    "dnn_fit_score": q_dnn_fit_score,
    "rbf_fit_score": q_rbf_fit_score,
    "cross_validate": q_cross_validate,
    "tune": q_tune,
    "tune_step_size": q_tune_step_size,
    "persist_roundtrip": q_persist_roundtrip,
    "pipeline_persist": q_pipeline_persist,
    "rbf_kernel_features": q_rbf_kernel_features,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_missing_words": q_csv_missing_words,
    "csv_multiline": q_csv_multiline,
    "csv_multiline_split": q_csv_multiline_split,
    "newest_file": q_newest_file,
    "report_roundtrip": q_report_roundtrip,
    "report_json_roundtrip": q_report_json_roundtrip,
    "quality_report": q_quality_report,
    "feature_columns": q_feature_columns,
    "batch_export": q_batch_export,
    "overall_interpretation": q_overall_interpretation,
    "labelled_join_profile": q_labelled_join_profile,
    "stream_scoring": q_stream_scoring,
    "stream_model_scoring": q_stream_model_scoring,
}

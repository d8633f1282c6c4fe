"""End-to-end study: validate -> profile -> split -> cross-validate -> final fits -> rank ->
paired tests -> report tables (query lifecycles A, B and D of the survey).

Each stage is a set of Spark jobs over DataFrames; the fold-tagged rows are
written once to the shared checkpoint folder because every fit re-reads them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.operators import metrics, models, profile, split, stats, validate
from tessera.plans.report import overall_interpretation
from tessera.session import materialize
from tessera.sources import files
from tessera.spec import TableSpec


@dataclass
class StudyResult:
    best_model: str
    tables: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    excluded_rows: int = 0


def _ranking():
    return [F.col("cv_f1_mean").desc(), F.col("cv_roc_auc_mean").desc(), F.col("cv_recall_mean").desc(),
            F.col("cv_f1_std").asc(), F.col("inference_seconds_per_row").asc(), F.col("model").asc()]


def run_study(df: DataFrame, spec: TableSpec, key: str, folds: int = 5, seed: int = 42,
              model_names=("MLP", "DNN", "RBF"), max_iter: int = 60, test_fraction: float = 0.2,
              bootstrap: int = 200, tuning_trials: int = 0, out_dir: str | None = None,
              threshold: float = 0.5) -> StudyResult:
    """Run the whole comparison study on a raw table; optionally write every report table."""
    if folds < 2:
        raise ValueError("folds must be at least 2")
    v = validate.validate(df, spec)
    if v.metrics["n_classes"] < 2:
        raise ValueError("The table must contain both classes 0 and 1.")
    frame = v.frame
    num, cat = list(spec.numeric), spec.categorical_features(frame.columns)
    rows = materialize(split.study_split(frame, spec.target, key, test_fraction, folds, seed))
    train, test = rows.where(~F.col("is_test")), rows.where(F.col("is_test"))

    configs = [models.ModelConfig(n, max_iter=max_iter, seed=seed) for n in model_names]
    tuning = []
    if tuning_trials:
        inner = split.stratified_holdout(train.drop("is_test", "fold"), spec.target, key, 0.2, seed, "tune")
        inner = inner.withColumnRenamed("is_test", "is_validation")
        tuned = []
        for cfg in configs:
            trials = models.tune(inner, cfg, tuning_trials, num, cat, spec.target, key)
            tuning.append(trials)
            tuned.append(models.ModelConfig(**json.loads(trials.where("best").first()["params"])))
        configs = tuned

    cv_pred = models.cross_validate(train, configs, folds, num, cat, spec.target, key)
    cv = materialize(models.cv_table(cv_pred))

    finals, parts = {}, []
    for cfg in configs:
        m = models.fit(train, cfg, num, cat, spec.target, key)
        finals[cfg.name] = m
        parts.append(m.score(test, keep=[key, spec.target]).select(
            key, F.col(spec.target).alias("y"), "score").withColumn("model", F.lit(cfg.name)))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    preds = materialize(preds)

    test_metrics = metrics.classification_metrics(preds, ["model"], threshold=threshold)
    f1_ci = metrics.bootstrap_ci(preds, ["model"], key, metric="f1", replicates=bootstrap, seed=seed,
                                 threshold=threshold).select("model", F.struct("lower", "upper").alias("bootstrap_f1"))
    auc_ci = metrics.bootstrap_ci(preds, ["model"], key, metric="roc_auc", replicates=bootstrap, seed=seed).select(
        "model", F.struct("lower", "upper").alias("bootstrap_roc_auc"))
    summary = cv.groupBy("model").agg(
        F.avg("f1").alias("cv_f1_mean"), F.coalesce(F.stddev_samp("f1"), F.lit(0.0)).alias("cv_f1_std"),
        F.avg("roc_auc").alias("cv_roc_auc_mean"), F.avg("recall").alias("cv_recall_mean"))
    seconds = preds.sparkSession.createDataFrame(
        [(n, m.train_seconds, m.seconds_per_row(test)) for n, m in finals.items()],
        "model string, training_seconds double, inference_seconds_per_row double")
    comparison = (test_metrics.join(summary, "model").join(seconds, "model")
                  .join(f1_ci, "model", "left").join(auc_ci, "model", "left"))
    comparison = comparison.withColumn("rank", F.row_number().over(Window.orderBy(*_ranking())))
    best = comparison.where(F.col("rank") == 1).select("model").first()["model"]

    comp = stats.complete_blocks(cv, [], "fold", "model", "f1")
    diffs = stats.paired_differences(comp, [], "fold", "model", "f1")
    fr = stats.friedman(comp, [], "fold", "model", "f1")
    pt = stats.paired_t(diffs, [])
    wx = stats.wilcoxon(diffs, [])
    tables = {
        "sample": split.head_sample(frame, key, 1000),
        "quality": profile.quality_report(frame, spec.target, v.excluded_rows, v.warnings, num, list(zip(v.original_columns, v.normalized_columns))),
        "describe": profile.describe_numeric(frame, num),
        "describe_categories": profile.describe_categorical(frame, cat),
        "histograms": profile.histogram(frame, num),
        "box_stats": profile.box_stats(frame, num),
        "correlation": profile.correlation(frame, [*num, spec.target]),
        "categories": profile.category_class_counts(frame, cat, spec.target),
        "cv_results": cv,
        "model_comparison": comparison,
        "friedman": fr,
        "paired_t": pt,
        "wilcoxon": wx,
        "mcnemar": stats.mcnemar(preds, best, key, threshold=threshold),
        "interpretation": overall_interpretation(fr, pt, wx),
        "roc_curves": metrics.roc_curve(preds, ["model"]),
        "test_predictions": preds,
    }
    if tuning:
        tables["hyper_parameters"] = reduce(DataFrame.unionByName, tuning)
    if out_dir:
        files.write_report(tables, f"{out_dir}/tables")
        models.save(finals[best], f"{out_dir}/model", threshold, {"model_name": best, "folds": folds, "seed": seed})
    return StudyResult(best, tables, v.warnings, v.excluded_rows)

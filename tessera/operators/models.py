"""Model fitting, cross-validation, tuning, persistence and batch scoring (M1-M10, S7) on spark.ml.

The study's Keras networks are re-aimed at ``MultilayerPerceptronClassifier``
(distributed L-BFGS over partitions): MLP 64-32, DNN 128-64-32-16, and an RBF
network = KMeans centres -> Gaussian kernel features (native expressions) ->
MLP 32. CNN/LSTM variants have no spark.ml counterpart and are not built.
Scoring is a projection plus the model's ``transform``: row-parallel, no shuffle.
"""

from __future__ import annotations

import json
import math
import os
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform_sql
from tessera.operators import metrics as M
from tessera.operators.features import Preprocessor, fit_preprocessor, rbf_features
from tessera.session import materialize

HIDDEN = {"MLP": [64, 32], "DNN": [128, 64, 32, 16], "RBF": [32]}
BUILT = ("MLP", "DNN", "RBF")


@dataclass
class ModelConfig:
    name: str
    max_iter: int = 60
    hidden: list | None = None  # widths of the hidden layers; None: the study's own for this name
    block_size: int = 1024  # rows stacked per matrix product (L-BFGS gradients are full-batch)
    rbf_centers: int = 16
    rbf_gamma: float = 1.0
    seed: int = 42
    solver: str = "l-bfgs"  # or "gd", gradient descent
    step_size: float = 0.03  # of gradient descent alone

    def as_dict(self) -> dict:
        return dict(self.__dict__)


@dataclass
class FittedModel:
    config: ModelConfig
    preprocessor: Preprocessor
    mlp: MultilayerPerceptronClassificationModel
    centers: list = field(default_factory=list)
    train_seconds: float = 0.0

    def seconds_per_row(self, df: DataFrame) -> float:
        """Measured time of scoring ``df`` in bulk, by row (0 for no rows)."""
        seen = Observation()
        started = time.perf_counter()
        self.score(df, keep=[]).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        return (time.perf_counter() - started) / seen.get["n"] if seen.get["n"] else 0.0

    def score(self, df: DataFrame, keep: list[str], output: str = "score") -> DataFrame:
        """Keep columns + P(class 1). Works on batch and streaming frames."""
        return self.score_features(_features(df, self.preprocessor, list(keep)), keep, output)

    def score_features(self, x: DataFrame, keep: list[str], output: str = "score") -> DataFrame:
        """``score`` of rows that are prepared already (keep columns + ``__x``)."""
        if self.config.name == "RBF":
            x = rbf_features(x, "__x", self.centers, self.config.rbf_gamma, "__x")
        x = x.select(*keep, array_to_vector("__x").alias("features"))
        out = self.mlp.transform(x)
        return out.select(*keep, vector_to_array("probability")[1].alias(output))


def replicate_by_weight(df: DataFrame, target: str, key: str, weights: dict, seed: int = 42) -> DataFrame:
    """Class weights for learners without a weight column: each row of class c is repeated
    floor(r_c) or floor(r_c) + 1 times (md5-decided), r_c = w_c / min(w)."""
    if not weights:
        return df
    base = min(weights.values())
    ratio = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(w / base))])
    r = F.element_at(ratio, F.col(target))
    u = F.expr(uniform_sql(f"concat(CAST({key} AS STRING), '|weight|{seed}')"))
    copies = F.floor(r) + F.when(u < r - F.floor(r), 1).otherwise(0)
    return df.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("__copy")


def balanced_weights(df: DataFrame, target: str, min_ratio: float = 1.5) -> dict:
    """A17 as a dict (two rows to the driver): {} when classes are balanced enough."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}
    if len(counts) < 2 or min(counts.values()) == 0:
        return {}
    if max(counts.values()) / min(counts.values()) < min_ratio:
        return {}
    total = sum(counts.values())
    return {c: total / (2.0 * n) for c, n in counts.items()}


def _features(rows: DataFrame, pre: Preprocessor, keep: list[str]) -> DataFrame:
    """Keep columns + the feature array ``__x``."""
    feats = F.array(*[F.col(f"`{c}`") for c in pre.feature_names()])
    return pre.transform(rows, keep=keep).select(*keep, feats.alias("__x"))


def _network(x: DataFrame, config: ModelConfig, pre: Preprocessor, target: str, started: float,
             rounds: int | None = None, before: FittedModel | None = None) -> FittedModel:
    """Fit the network on rows of (target, __x), by ``rounds`` (default: the setting's) from the weights and centres of ``before``."""
    centers = before.centers if before else []
    if config.name == "RBF":
        if not before:
            km = KMeans(k=int(config.rbf_centers), seed=config.seed, maxIter=30).fit(x.select(array_to_vector("__x").alias("features")))
            centers = [list(map(float, c)) for c in km.clusterCenters()]
        x = rbf_features(x, "__x", centers, config.rbf_gamma, "__x")
    dim = len(centers) if centers else len(pre.feature_names())
    x = x.select(F.col(target).cast("double").alias("label"), array_to_vector("__x").alias("features"))
    network = MultilayerPerceptronClassifier(layers=[dim, *(config.hidden or HIDDEN[config.name]), 2], maxIter=rounds or config.max_iter,
                                             blockSize=config.block_size, seed=config.seed, solver=config.solver, stepSize=config.step_size)
    if before:
        network = network.setInitialWeights(before.mlp.weights)
    seconds = before.train_seconds if before else 0.0
    return FittedModel(config, pre, network.fit(x), centers, seconds + time.perf_counter() - started)


def fit(train: DataFrame, config: ModelConfig, numeric: list[str], categorical: list[str],
        target: str = "result", key: str | None = None, class_weight: bool = True) -> FittedModel:
    """Fit preprocessing and the network on ``train`` only (no leakage)."""
    started = time.perf_counter()
    pre = fit_preprocessor(train, numeric, categorical)
    if class_weight and key:
        train = replicate_by_weight(train, target, key, balanced_weights(train, target), config.seed)
    return _network(_features(train, pre, [target]), config, pre, target, started)


def cross_validate(rows: DataFrame, configs: list[ModelConfig], folds: int, numeric: list[str],
                   categorical: list[str], target: str = "result", key: str = "order_key",
                   fold_col: str = "fold", parallel: int = 4) -> DataFrame:
    """M5: for each model and fold, fit on the other folds, score the fold; one long prediction
    table (key, model, fold, y, score) whose metrics are one grouped job.

    Preprocessing is fitted once per fold and shared by the fold's models, whose
    features are a table in the shared folder. ``parallel`` fits are submitted
    at a time, so that short jobs do not wait for one another.
    """
    seed = configs[0].seed

    def prepared(fold: int) -> tuple[Preprocessor, DataFrame]:
        train = rows.where(F.col(fold_col) != fold)
        pre = fit_preprocessor(train, numeric, categorical)
        weighted = replicate_by_weight(train, target, key, balanced_weights(train, target), seed)
        return pre, materialize(_features(weighted, pre, [target]))

    with ThreadPoolExecutor(parallel) as pool:
        ready = list(pool.map(prepared, range(1, folds + 1)))

        def fitted(task: tuple[ModelConfig, int]) -> FittedModel:
            pre, x = ready[task[1] - 1]
            return _network(x, task[0], pre, target, time.perf_counter())

        tasks = [(cfg, fold) for cfg in configs for fold in range(1, folds + 1)]
        models = list(pool.map(fitted, tasks))
    parts = []
    for (cfg, fold), model in zip(tasks, models, strict=True):
        scored = model.score(rows.where(F.col(fold_col) == fold), keep=[key, target])
        parts.append(scored.select(key, F.col(target).alias("y"), "score").withColumns(
            {"model": F.lit(cfg.name), "fold": F.lit(fold), "train_seconds": F.lit(model.train_seconds)}))
    return reduce(DataFrame.unionByName, parts)


def cv_table(preds: DataFrame) -> DataFrame:
    """Fold-score table: the 13 metrics per (model, fold)."""
    return M.classification_metrics(preds, ["model", "fold"])


#: Range of the step sizes that are tried; rounds divide them by the root of their number.
STEPS = (0.05, 5.0)


def search_space(base: ModelConfig, trials: int, seed: int = 42) -> list[ModelConfig]:
    """M6: seeded random search over what changes a spark.ml network's fit.

    Widths of the hidden layers (the study's, halved or doubled) and rounds of
    the solver for all networks; centres in {8, 16, 32} and gamma log-uniform
    in [0.1, 3.0] for the RBF network; step sizes log-uniform in ``STEPS`` where
    the solver is gradient descent (L-BFGS has none). Trials that repeat
    one before are drawn again while new ones remain; the trial count is
    clamped to 1..100.
    """
    rng = random.Random(f"{base.name}|{seed}")
    out: list[ModelConfig] = []
    for _ in range(50 * max(1, min(100, int(trials)))):
        scale = rng.choice([0.5, 1, 2])
        trial = ModelConfig(base.name, rng.choice([base.max_iter // 2 or 1, base.max_iter, 2 * base.max_iter]),
                            hidden=[max(2, int(w * scale)) for w in HIDDEN[base.name]], block_size=base.block_size,
                            rbf_centers=rng.choice([8, 16, 32]) if base.name == "RBF" else base.rbf_centers,
                            rbf_gamma=math.exp(rng.uniform(math.log(0.1), math.log(3.0))) if base.name == "RBF" else base.rbf_gamma,
                            seed=base.seed, solver=base.solver,
                            step_size=math.exp(rng.uniform(*map(math.log, STEPS))) if base.solver == "gd" else base.step_size)
        if trial not in out:
            out.append(trial)
        if len(out) == max(1, min(100, int(trials))):
            break
    return out


def tune(train: DataFrame, base: ModelConfig, trials: int, numeric: list[str], categorical: list[str],
         target: str = "result", key: str = "order_key", valid_col: str = "is_validation",
         metric: str = "f1", halvings: int = 0, parallel: int = 4) -> DataFrame:
    """M6: evaluate each trial on an inner validation split of the training rows (never the test rows).

    Preprocessing is fitted once, inside the inner training part; both parts'
    features are tables that all trials read, ``parallel`` of them at a time.
    With ``halvings`` trials train in stages, each stage twice as long in all
    as the one before and from the weights it left; after each but the last the better
    half (rounded up; of equal values the first) goes on. The trials of a
    stage are measured in one grouped job. Returns one row per trial with its
    rounds and last value; ``best`` marks the first of the highest value
    among those that trained to the end.
    """
    fit_part, val_part = train.where(~F.col(valid_col)), train.where(F.col(valid_col))
    pre = fit_preprocessor(fit_part, numeric, categorical)
    weighted = replicate_by_weight(fit_part, target, key, balanced_weights(fit_part, target), base.seed)
    x_fit = materialize(_features(weighted, pre, [target]))
    x_val = materialize(_features(val_part, pre, [target]))
    configs = search_space(base, trials)
    going, models, rounds, values = list(range(len(configs))), {}, [0] * len(configs), [0.0] * len(configs)
    with ThreadPoolExecutor(parallel) as pool:
        for stage in range(halvings + 1):
            def trained(i: int, stage: int = stage) -> FittedModel:
                upto = max(1, configs[i].max_iter >> (halvings - stage))
                more, rounds[i] = max(1, upto - rounds[i]), upto
                return _network(x_fit, configs[i], pre, target, time.perf_counter(), more, models.get(i))

            models |= dict(zip(going, pool.map(trained, going), strict=True))
            scored = [models[i].score_features(x_val, [target]).withColumn("trial", F.lit(i)) for i in going]
            for row in M.classification_metrics(reduce(DataFrame.unionByName, scored), ["trial"], y=target).collect():
                values[row["trial"]] = float(row[metric])
            if stage < halvings:
                going = sorted(sorted(going, key=lambda i: (-values[i], i))[:-(-len(going) // 2)])
    top = min(going, key=lambda i: (-values[i], i))
    rows = [(base.name, i, json.dumps(c.as_dict(), sort_keys=True), values[i], models[i].train_seconds, rounds[i], i == top) for i, c in enumerate(configs)]
    return train.sparkSession.createDataFrame(
        rows, "model string, trial int, params string, value double, train_seconds double, rounds int, best boolean")


def save(model: FittedModel, path: str, threshold: float = 0.5, metadata: dict | None = None) -> None:
    """Persist network (spark.ml format), preprocessing, RBF centres, threshold and metadata."""
    spark = model.mlp.sparkSession if hasattr(model.mlp, "sparkSession") else None
    model.mlp.write().overwrite().save(os.path.join(path, "network"))
    doc = {"config": model.config.as_dict(), "preprocessor": model.preprocessor.to_json(),
           "centers": model.centers, "threshold": threshold, "metadata": metadata or {}}
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(
        os.path.join(path, "study.json"))


def load(path: str) -> tuple[FittedModel, float, dict]:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    doc = json.loads(spark.read.text(os.path.join(path, "study.json")).first()[0])
    mlp = MultilayerPerceptronClassificationModel.load(os.path.join(path, "network"))
    fm = FittedModel(ModelConfig(**doc["config"]), Preprocessor.from_json(doc["preprocessor"]), mlp, doc["centers"])
    return fm, float(doc["threshold"]), doc["metadata"]

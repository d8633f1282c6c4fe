"""Leakage-free feature preparation (F1-F6) and RBF kernel features (M4).

Fitting reads only the training rows and produces a handful of numbers per
column (median, mean, scale, mode, sorted levels); applying is a pure
projection with those numbers as literals -- no join, no shuffle -- so it
runs row-parallel on batch and streaming frames alike.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import exact_quantiles
from tessera.session import materialize


def _long(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in cols])).alias("__u")
    ).select("__u.column", "__u.value")


@dataclass
class Preprocessor:
    """Fitted preprocessing: median impute + population scaling, mode impute + one-hot."""

    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    levels: dict = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={lv}" for c in self.categorical for lv in self.levels.get(c, [])]]

    def feature_columns(self) -> list[Column]:
        cols = []
        for c in self.numeric:
            med = self.medians.get(c)
            x = F.coalesce(F.col(c).cast("double"), F.lit(med).cast("double")) if med is not None \
                else F.col(c).cast("double")
            cols.append(((x - F.lit(self.means.get(c, 0.0))) / F.lit(self.scales.get(c, 1.0))).alias(c))
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)).cast("string"))
            for lv in self.levels.get(c, []):
                cols.append(F.coalesce((v == F.lit(lv)).cast("double"), F.lit(0.0)).alias(f"{c}={lv}"))
        return cols

    def transform(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Keep columns + one column per feature (numeric block, then one-hot block)."""
        return df.select(*[F.col(k) for k in keep], *self.feature_columns())

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Preprocessor":
        return Preprocessor(**json.loads(text))


def fit_preprocessor(train: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
    """F1-F5 fitted on ``train`` only.

    F1 exact median (distributed selection), F2 mean and population std of the
    imputed values (zero std -> scale 1), F3 most frequent value (ties ->
    smallest), F4 sorted levels for one-hot (unknown -> all zeros).
    """
    pre = Preprocessor(list(numeric), list(categorical))
    if numeric:
        med = exact_quantiles(_long(train, numeric, "double"), ["column"], "value", [0.5])
        pre.medians = {r["column"]: r["quantile"] for r in med.collect()}
        imputed = [F.coalesce(F.col(c).cast("double"), F.lit(pre.medians.get(c)).cast("double")) for c in numeric]
        row = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(imputed)],
                        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(imputed)]).collect()[0]
        for i, c in enumerate(numeric):
            pre.means[c] = row[f"m{i}"] if row[f"m{i}"] is not None else 0.0
            s = row[f"s{i}"]
            pre.scales[c] = 1.0 if s is None or s < 10 * 2.220446049250313e-16 else s
    if categorical:
        counts = (_long(train, categorical, "string").where(F.col("value").isNotNull())
                  .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
        per_col = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k"),
                                               F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
        stats = {r["column"]: (r["k"], r["mode"]) for r in per_col.collect()}
        levels = counts.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("levels")).collect()
        pre.levels = {r["column"]: list(r["levels"]) for r in levels}
        pre.modes = {c: stats[c][1] for c in stats}
    return pre


def fold_statistics(df: DataFrame, numeric: list[str], categorical: list[str], folds: int,
                    fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """preprocessing statistics of every fold's training part in one pass.

    The input is written once, narrow. Medians are exact over the training
    parts (each row counts for the k - 1 folds it does not belong to). Means,
    scales and level counts are taken once for each fold and merged into the
    training parts, which is a table of folds x columns (or x levels).
    Returns (numeric stats: fold, column, median, mean, scale;
             categorical stats: fold, column, mode, levels).
    """
    rows = materialize(df.select(F.col(fold_col).alias("__fold"), *dict.fromkeys([*numeric, *categorical])))

    def long(columns: list[str], cast: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(cast).alias("value")) for c in columns])
        return rows.select("__fold", F.explode(cells).alias("__u")).select("__fold", "__u.column", "__u.value")

    def for_training(parts: DataFrame) -> DataFrame:
        """Each line once for each fold it trains."""
        others = F.filter(F.sequence(F.lit(1), F.lit(folds)), lambda f: f != F.col("__fold"))
        return parts.withColumn("fold", F.explode(others)).drop("__fold")

    num_long = long(numeric, "double")
    med = exact_quantiles(for_training(num_long), ["fold", "column"], "value", [0.5]).select(
        F.col("fold").alias("__f"), F.col("column").alias("__c"), F.col("quantile").alias("median"))
    moments = num_long.groupBy("__fold", "column").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("nulls"),
        F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    # a fold's known values, and its missing ones, which all become the median; folds x columns lines
    lines = for_training(moments)
    lines = lines.join(F.broadcast(med), (F.col("fold") == F.col("__f")) & (F.col("column") == F.col("__c")), "left")
    known, filled = F.struct("n", "m", "v"), F.struct(F.col("nulls").alias("n"), F.col("median").alias("m"), F.lit(0.0).alias("v"))
    pieces = lines.select("fold", "column", "median", F.explode(F.array(known, filled)).alias("p")).select("fold", "column", "median", "p.*")
    pieces = pieces.withColumn("n", F.when(F.col("m").isNotNull() & (F.col("n") > 0), F.col("n")))
    part = Window.partitionBy("fold", "column")
    pieces = pieces.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(part) / F.sum("n").over(part))
    num_stats = pieces.groupBy("fold", "column", "median", "mean").agg(
        F.sqrt(F.sum(F.col("n") * (F.col("v") + (F.col("m") - F.col("mean")) ** 2)) / F.sum("n")).alias("__s")).select(
        "fold", "column", "median", "mean",
        F.when(F.col("__s").isNull() | (F.col("__s") < 10 * 2.220446049250313e-16), F.lit(1.0))
         .otherwise(F.col("__s")).alias("scale"))
    levels = long(categorical, "string").where(F.col("value").isNotNull()).groupBy("__fold", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    cat_stats = (for_training(levels).groupBy("fold", "column", "value").agg(F.sum("n").alias("n"))
                 .groupBy("fold", "column").agg(
                     F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
                     F.count(F.lit(1)).alias("levels")))
    return num_stats, cat_stats


def rbf_features(df: DataFrame, vector_col: str, centers: list[list[float]], gamma: float,
                 output: str = "rbf") -> DataFrame:
    """M4: exp(-gamma * ||x - c||^2) for each centre, as ARRAY<DOUBLE>.

    Centres are a fitted, bounded set (k x d numbers) and enter the plan as
    literals: a projection, no join with the data.
    """
    x = F.col(vector_col)
    feats = []
    for c in centers:
        lit = F.array(*[F.lit(float(v)) for v in c])
        sq = F.aggregate(F.zip_with(x, lit, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                         F.lit(0.0), lambda acc, v: acc + v)
        feats.append(F.exp(F.lit(-float(gamma)) * sq))
    return df.withColumn(output, F.array(*feats))

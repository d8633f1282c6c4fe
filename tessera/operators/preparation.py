"""Feature preparation and the network as spark.ml stages.

``Preparation`` is an Estimator: median and scale of numeric columns, mode and
numbered levels of categorical ones, all from the training rows. Its model
keeps the levels as a *table* (column, value, id), so a column may have as many
levels as rows: nothing is collected but one line for each column. Rows meet
their levels by a join for each categorical column, which Spark broadcasts
where the levels are few and shuffles (splitting hot values) where not.

``PreparationModel.sparse`` gives rows as (width, indices, values);
``transform`` gives a spark.ml vector, sparse where that is shorter. With
``Network`` behind it in one ``Pipeline`` the whole study model is one object
to save and load, and scores batches and streams alike (a stream is joined to
the static levels, without state).
"""

from __future__ import annotations

import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader,
                             MLWritable, MLWriter)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.features import _long, fit_preprocessor
from tessera.operators.prefix import running_totals
from tessera.session import materialize

#: Indices of a spark.ml vector are 32-bit.
MOST_FEATURES = 2 ** 31 - 1


def level_table(train: DataFrame, categorical: list[str]) -> DataFrame:
    """(column, value, n, id): the levels of each column numbered from 0 in value order, and their rows; written once.

    NULL is no level. Numbers come from running totals over ranges of
    (column, value), so a column with as many levels as rows has no task of its own.
    """
    counts = (_long(train, categorical, "string").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return materialize(running_totals(counts, ["column"], ["value"], {"id": F.lit(1)}, inclusive=False))


class _Columns(Params):
    numeric = Param(Params._dummy(), "numeric", "numeric columns", TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categorical columns", TypeConverters.toListString)
    outputCol = Param(Params._dummy(), "outputCol", "column of the feature vector", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(numeric=[], categorical=[], outputCol="features")


class Preparation(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """F1-F5 as an Estimator.

    A numeric column without any training value becomes 0; a categorical one
    has no features. Missing numbers become the median, missing categories the
    most frequent level (ties: the smallest); unknown levels are all zeros.
    """

    @keyword_only
    def __init__(self, *, numeric: list[str] | None = None, categorical: list[str] | None = None, outputCol: str = "features") -> None:
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "PreparationModel":
        numeric, categorical = self.getOrDefault(self.numeric), self.getOrDefault(self.categorical)
        pre = fit_preprocessor(dataset, numeric, [])
        constants = {c: [pre.medians.get(c), pre.means.get(c, 0.0), pre.scales.get(c, 1.0)] for c in numeric}
        levels, about = None, {}
        if categorical:
            levels = level_table(dataset, categorical)
            # one line for each column
            about = {r["column"]: [r["k"], r["mode"]] for r in levels.groupBy("column").agg(
                F.count(F.lit(1)).alias("k"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")).collect()}
        return self._copyValues(PreparationModel(constants, about, levels))


class PreparationModel(Model, _Columns, MLReadable, MLWritable):
    """Fitted preparation: ``constants`` (column -> median, mean, scale), ``about`` (column -> number of levels, mode), ``levels``."""

    def __init__(self, constants: dict | None = None, about: dict | None = None, levels: DataFrame | None = None) -> None:
        super().__init__()
        self.constants, self.about, self.levels = constants or {}, about or {}, levels

    def _coded(self) -> list[str]:
        """Categorical columns that have levels."""
        return [c for c in self.getOrDefault(self.categorical) if c in self.about]

    @property
    def width(self) -> int:
        return len(self.getOrDefault(self.numeric)) + sum(self.about[c][0] for c in self._coded())

    def _scaled(self) -> list[Column]:
        out = []
        for c in self.getOrDefault(self.numeric):
            median, mean, scale = self.constants[c]
            x = F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(median).cast("double"))
            out.append(F.coalesce((x - F.lit(mean)) / F.lit(scale), F.lit(0.0)))
        return out

    def _with_ids(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``__id<i>``, the number of the level in the i-th coded column (NULL: unknown)."""
        for i, c in enumerate(self._coded()):
            value = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(self.about[c][1]))
            own = self.levels.where(F.col("column") == c).select(F.col("value").alias(f"__level{i}"), F.col("id").alias(f"__id{i}"))
            rows = rows.withColumn(f"__value{i}", value).join(own, F.col(f"__value{i}") == F.col(f"__level{i}"), "left").drop(f"__value{i}", f"__level{i}")
        return rows

    def sparse(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Keep columns + ``width`` long, ``indices`` array<long> (rising) and ``values`` array<double> (none is 0)."""
        scaled = self._scaled()
        entries = [F.when(x != 0, F.struct(F.lit(i).cast("long").alias("i"), x.alias("x"))) for i, x in enumerate(scaled)]
        at = len(scaled)
        for i, c in enumerate(self._coded()):
            entries.append(F.when(F.col(f"__id{i}").isNotNull(), F.struct((F.col(f"__id{i}") + at).alias("i"), F.lit(1.0).alias("x"))))
            at += self.about[c][0]
        found = F.array_compact(F.array(*entries)) if entries else F.expr("CAST(array() AS ARRAY<STRUCT<i: BIGINT, x: DOUBLE>>)")
        return (self._with_ids(rows).select(*[F.col(f"`{k}`") for k in keep], found.alias("__entries"))
                .select(*[F.col(f"`{k}`") for k in keep], F.lit(self.width).cast("long").alias("width"),
                        F.col("__entries.i").alias("indices"), F.col("__entries.x").alias("values")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """All columns + the feature vector, whose width must fit 32 bits."""
        if not 0 < self.width <= MOST_FEATURES:
            raise ValueError(f"{self.width} features; a vector has 1 to {MOST_FEATURES} (use sparse())")
        coded, scaled = self._coded(), self._scaled()
        parts = [f"__x{i}" for i in range(len(scaled))]
        ids, hot = [f"__code{i}" for i in range(len(coded))], [f"__hot{i}" for i in range(len(coded))]
        # the number after the last level stands for unknown ones and is encoded as zeros
        rows = self._with_ids(dataset).withColumns(
            dict(zip(parts, scaled, strict=True)) | {d: F.coalesce(F.col(f"__id{i}"), F.lit(self.about[c][0])).cast("double") for i, (d, c) in enumerate(zip(ids, coded, strict=True))})
        if coded:
            largest = dataset.sparkSession.createDataFrame([tuple(float(self.about[c][0] - 1) for c in coded)], ", ".join(f"{d} double" for d in ids))
            rows = OneHotEncoder(inputCols=ids, outputCols=hot, handleInvalid="keep", dropLast=True).fit(largest).transform(rows)
        out = VectorAssembler(inputCols=parts + hot, outputCol=self.getOrDefault(self.outputCol)).transform(rows)
        return out.drop(*parts, *ids, *hot, *[f"__id{i}" for i in range(len(coded))])

    def write(self) -> MLWriter:
        return _PreparationWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _PreparationReader()


class _PreparationWriter(MLWriter):
    """Numbers in the metadata, levels as a Parquet table beside it."""

    def __init__(self, instance: PreparationModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        own = self.instance
        DefaultParamsWriter.saveMetadata(own, path, self.sparkSession, extraMetadata={"constants": own.constants, "about": own.about})
        if own.levels is not None:
            own.levels.write.parquet(os.path.join(path, "levels"))


class _PreparationReader(MLReader):
    def load(self, path: str) -> PreparationModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        levels = None
        if meta["paramMap"].get("categorical"):
            levels = spark.read.schema("column string, value string, n long, id long").parquet(os.path.join(path, "levels"))
        out = PreparationModel(meta["constants"], meta["about"], levels)
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out


class Network(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """A multilayer perceptron that takes its input width from the features before it; fits to spark.ml's own model."""

    target = Param(Params._dummy(), "target", "column of the class, 0 or 1", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "widths of the hidden layers", TypeConverters.toListInt)
    maxIter = Param(Params._dummy(), "maxIter", "rounds of L-BFGS", TypeConverters.toInt)
    blockSize = Param(Params._dummy(), "blockSize", "rows stacked for each matrix product", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the first weights", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "column of the feature vector", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, target: str = "result", hidden: list[int] | None = None, maxIter: int = 60, blockSize: int = 1024, seed: int = 42,
                 featuresCol: str = "features") -> None:
        super().__init__()
        self._setDefault(target="result", hidden=[64, 32], maxIter=60, blockSize=1024, seed=42, featuresCol="features")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame):
        given = {p.name: self.getOrDefault(p) for p in self.params}
        features = given["featuresCol"]
        width = dataset.schema[features].metadata["ml_attr"]["num_attrs"]
        rows = dataset.select(F.col(given["target"]).cast("double").alias("label"), F.col(features))
        return MultilayerPerceptronClassifier(layers=[width, *given["hidden"], 2], maxIter=given["maxIter"], blockSize=given["blockSize"],
                                              seed=given["seed"], featuresCol=features).fit(rows)


class PipelineScorer:
    """A fitted pipeline with the ``score`` of the study's models, for batches and streams."""

    def __init__(self, pipeline: PipelineModel) -> None:
        self.pipeline = pipeline

    def score(self, df: DataFrame, keep: list[str], output: str = "score") -> DataFrame:
        return self.pipeline.transform(df).select(*[F.col(f"`{k}`") for k in keep], vector_to_array("probability")[1].alias(output))

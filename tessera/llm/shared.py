"""Tables written to the folder that all executors share, and small readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


#: Arrow batches to Python workers: so many bytes and rows at most. Spark's own limits (64 MB, 10 000 rows) hold for
#: each buffer on both sides of every running task, which texts of some KB fill.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to the above where they are higher; results don't depend on them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, each row is computed once.

    The table outlives any executor. It is left to the cluster's clean-up of
    its checkpoint folder, since the returned rows are read from it lazily.
    """
    small_batches(df.sparkSession)
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text) -> F.Column:
    """``text`` with A-Z (and no other letter) in lower case; null is empty."""
    return F.coalesce(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))

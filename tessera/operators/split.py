"""Exact stratified splitting.

``sampleBy`` is Bernoulli, so class quotas would only hold on average. We
rank rows inside their class by md5(key, salt, seed) -- deterministic under
re-partitioning and task retries -- with the distributed running totals of
:mod:`tessera.operators.prefix` (a class holding most rows is spread over
many tasks), and cut at exact per-class quotas:

* hold-out: n_test = ceil(f * N); train quotas by largest remainder of
  n_c / N * n_train (the stratified-shuffle-split rule), test = the rest;
* k-fold on the train rows: fold = (offset_c + rank - 1) mod k + 1, where
  offset_c is the number of train rows of the classes before c, so every
  fold differs from any other by at most one row overall and per class.

One ranking pass serves both the hold-out and the folds: the test rows are
the first quota of each class in hash order, the train rows follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_order_sql
from tessera.operators.prefix import running_totals
from tessera.session import materialize

#: Class tables of up to so many lines are broadcast.
CLASSES = 10_000


def hash_key(key: str, salt: str, seed: int) -> str:
    return hash_order_sql(f"concat(CAST({key} AS STRING), '|{salt}|{seed}')")


def largest_remainder_quotas(counts: DataFrame, target: str, n_col: str, draws: F.Column) -> DataFrame:
    """Per-class quota of ``draws`` proportional to class size, leftovers by largest remainder.

    ``counts`` is the small (class, n) table; ties in remainder go to the smaller class value.
    """
    w = Window.partitionBy()
    total = F.sum(n_col).over(w)
    continuous = F.col(n_col) / total * draws
    staged = counts.withColumn("__cont", continuous).withColumn("__floor", F.floor("__cont"))
    staged = staged.withColumn("__left", draws - F.sum("__floor").over(w)).withColumn(
        "__rem", F.col("__cont") - F.col("__floor"))
    order = Window.partitionBy().orderBy(F.col("__rem").desc(), F.col(target))
    return staged.withColumn("quota", (F.col("__floor") + F.when(F.row_number().over(order) <= F.col("__left"), 1)
                                       .otherwise(0)).cast("bigint")).drop("__cont", "__floor", "__left", "__rem")


def _with_class(rows: DataFrame, classes: DataFrame, target: str) -> DataFrame:
    """Each row with its class's line of the (class, ...) table.

    The rows of a class may be a large part of the table, so they are not
    dealt by class: the table of classes goes to the rows if it is small
    (``CLASSES`` lines, far fewer than the labels of a classifier), and
    beyond that Spark joins by class, where no class is large.
    """
    lines = classes.limit(CLASSES + 1).collect()
    few = len(lines) <= CLASSES
    line = rows.sparkSession.createDataFrame(lines, classes.schema) if few else classes
    line = line.withColumnRenamed(target, "__class")
    line = F.broadcast(line) if few else line
    return rows.join(line, F.col(target).eqNullSafe(F.col("__class"))).drop("__class")


def study_split(df: DataFrame, target: str, key: str, test_fraction: float = 0.2, folds: int = 5,
                seed: int = 42, salt: str = "split") -> DataFrame:
    """Add ``is_test`` (exact stratified hold-out) and ``fold`` (1..k for train rows, NULL for test).

    Rows are ranked inside their class in md5(key, salt, seed) order, ties by
    key. The input is evaluated once: class sizes and ranks read the table
    that it is written to.
    """
    if folds < 2:
        raise ValueError("folds must be at least 2")
    rows = materialize(df.withColumn("__h", F.expr(hash_key(key, salt, seed))))
    counts = rows.groupBy(target).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    n = F.sum("n_c").over(w)
    n_train = n - F.ceil(F.lit(float(test_fraction)) * n)
    train_q = largest_remainder_quotas(counts, target, "n_c", n_train).withColumnRenamed("quota", "train_c")
    cls = train_q.select(
        target, "n_c", "train_c", (F.col("n_c") - F.col("train_c")).alias("test_c"),
        F.coalesce(F.sum("train_c").over(Window.partitionBy().orderBy(target)
                                         .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset_c"))
    ranked = running_totals(rows, [target], ["__h", key], {"rank_in_class": F.lit(1)}, written=True).drop("__h")
    joined = _with_class(ranked, cls, target)
    is_test = F.col("rank_in_class") <= F.col("test_c")
    fold = F.when(~is_test, F.pmod(F.col("offset_c") + F.col("rank_in_class") - F.col("test_c") - 1, F.lit(folds)) + 1)
    return joined.withColumns({"is_test": is_test, "fold": fold.cast("int")}).drop(
        "n_c", "train_c", "test_c", "offset_c", "rank_in_class")


def stratified_holdout(df: DataFrame, target: str, key: str, test_fraction: float = 0.2,
                       seed: int = 42, salt: str = "split") -> DataFrame:
    """``is_test`` flag with exact per-class quotas."""
    return study_split(df, target, key, test_fraction, 2, seed, salt).drop("fold")


def head_sample(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """The first ``n`` rows in key order (a top-k, planned as TakeOrderedAndProject)."""
    return df.orderBy(key).limit(n)

"""Exact top-k inner products by pivot-table elimination (operator 5).

Vectors are integers (floor(1024 x) of each component). Distances to a set of
pivots are computed once for every vector. For a query q, vector x and pivot p
the triangle inequality gives |q - x| >= |d(q, p) - d(x, p)|; the largest of
these lower bounds L over the pivots turns into an upper bound of the score:
<q, x> <= (|q|^2 + |x|^2 - L^2) / 2.

Vectors are laid in blocks of ``BLOCK`` rows along (nearest pivot, distance to
it), queries in blocks of ``QUERIES`` rows in the same order. A first round
compares each query block with the vector block that promises most and leaves
every query with a k-th score to beat. The second round visits the pairs of
blocks in which some query's bound reaches its k-th score; within a pair,
candidates are taken in order of their bounds until no bound reaches the k-th
score. Nothing is dropped without a bound, so results are exact.

Both rounds deal pairs of blocks to tasks, so a task holds one block of each
side. Of equal vectors only the rows that can be among some query's k best are
compared (``candidates``), so copies of one vector cost no more than 2k rows of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.shared import cut

SCALE = 1024
K, EVERY = 10, 100
PIVOTS, PIVOT_SAMPLE = 16, 2048
BLOCK, QUERIES = 4096, 512
#: Candidates evaluated between two looks at the k-th score.
STEP = 256
#: Added to bounds for the rounding of distances.
SLACK = 1e-6


def _matrix(column) -> np.ndarray:
    """Rows of integers; shorter vectors end in zeros."""
    rows = [np.frombuffer(x, dtype="<i8") for x in column]
    width = max((len(r) for r in rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    grow = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return grow(a), grow(b)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers; through doubles where these are exact."""
    a, b = _wide(a, b)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = _wide(a, b)
    x, y = a.astype(np.float64), b.astype(np.float64)
    squares = (x ** 2).sum(axis=1)[:, None] + (y ** 2).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(squares, 0))


def integer_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector): 64-bit integers floor(1024 x); rows with a null id, vector or component or a component that isn't finite are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1)
            lengths, values = rows.value_lengths().to_numpy(zero_copy_only=False), rows.flatten()
            numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            good = np.isfinite(numbers)  # nulls read as NaN
            scaled = np.floor(SCALE * np.where(good, numbers, 0))
            good &= np.abs(scaled) < 2.0 ** 62
            edges = np.concatenate(([0], np.cumsum(np.nan_to_num(lengths).astype(np.int64))))
            whole = scaled.astype("<i8")
            ids, vectors = [], []
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                a, b = edges[i], edges[i + 1]
                if vec_id is not None and rows[i].is_valid and good[a:b].all():
                    ids.append(vec_id)
                    vectors.append(whole[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "vector"])

    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .filter("vec_id IS NOT NULL AND embedding IS NOT NULL").mapInArrow(run, "vec_id long, vector binary")


def candidates(vectors: DataFrame, k: int) -> DataFrame:
    """The rows that can be an answer: of each vector and id k rows, and of these the 2k of each vector with the smallest ids.

    Equal vectors score alike, so the smaller ids come first. A query passes
    over rows of its own id, at most k of them, so behind 2k rows of a vector
    none can be among its k best. Both cuts are made before the exchanges too,
    so a vector that a third of all rows share sends 2k rows from each task.
    """
    first = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("vec_id"))
    once = vectors.withColumn("n", first("vector", "vec_id")).filter(F.col("n") <= k)
    return once.withColumn("n", first("vector")).filter(F.col("n") <= 2 * k).drop("n")


def choose_pivots(vectors: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Up to ``n`` different vectors of a bounded sample, each farthest from those before it."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    have = _matrix(rows["vector"])
    if not len(have):
        return have
    chosen, nearest = [0], _distances(have, have[:1])[:, 0]
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(have, have[chosen[-1:]])[:, 0])
    return have[chosen]


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, vector, norm, to_pivots, cell, near): squared length, distances to all pivots, the nearest and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = _matrix(batch.column(1).to_pylist())
            to = _distances(have, pivots) if len(have) else np.zeros((0, len(pivots)))
            norm = (have.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(norm), pa.array(list(to), pa.list_(pa.float64())),
                 pa.array(to.argmin(axis=1).astype(np.int32) if len(to) else np.zeros(0, np.int32)),
                 pa.array(to.min(axis=1) if len(to) else np.zeros(0))], names=["vec_id", "vector", "norm", "to_pivots", "cell", "near"])

    return vectors.mapInArrow(run, "vec_id long, vector binary, norm double, to_pivots array<double>, cell int, near double")


def blocked(rows: DataFrame, size: int, name: str) -> DataFrame:
    """``rows`` as a table with ``block``, ranges of (cell, near, vec_id) of about ``size`` rows, and ``row``, a number of each row's own."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.repartitionByRange(n, "cell", "near", "vec_id")
    return cut(dealt.withColumns({"block": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), name)


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each block: the range of distances to each pivot, the largest norm and the number of rows."""
    at = lambda f, i: f(F.col("to_pivots")[i])
    n = len(rows.select("to_pivots").first()[0])
    return rows.groupBy("block").agg(F.array(*[at(F.min, i) for i in range(n)]).alias("low"), F.array(*[at(F.max, i) for i in range(n)]).alias("high"),
                                     F.max("norm").alias("norm"), F.count("*").alias("rows"))


def _upper(q_norm: np.ndarray, x_norm: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Upper bounds of scores from lower bounds of distances, rounded up."""
    top = (q_norm + x_norm - gap ** 2) / 2
    return top + SLACK * (q_norm + x_norm) + 1


class Best:
    """The k best (score, vec_id) of some queries so far; of equal scores the smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def least(self, i: int) -> float:
        """A candidate whose score is below this can't be among the k best."""
        own = self.rows[i]
        return max(self.floor[i], own[-1][0] if len(own) == self.k else -np.inf)

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores >= self.least(i)
        if keep.any():
            scores, ids = scores[keep], ids[keep]
            first = np.lexsort((ids, -scores))[:self.k]
            merged = self.rows[i] + list(zip(scores[first].tolist(), ids[first].tolist(), strict=True))
            self.rows[i] = sorted(merged, key=lambda x: (-x[0], x[1]))[:self.k]


def compare(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_row, query_id, vec_id, score): a block of queries against a block of vectors, in order of bounds."""
    q, x = _matrix(queries["vector"]), _matrix(vectors["vector"])
    q_to, x_to = np.stack(queries["to_pivots"].to_numpy()), np.stack(vectors["to_pivots"].to_numpy())
    q_norm, x_norm = queries["norm"].to_numpy(), vectors["norm"].to_numpy()
    q_ids, ids = queries["vec_id"].to_numpy(), vectors["vec_id"].to_numpy()
    best = Best(len(q), k, queries["least"].to_numpy(dtype=np.float64))
    for i in range(len(q)):
        gap = np.abs(x_to - q_to[i]).max(axis=1)
        bound = _upper(q_norm[i], x_norm, gap)
        alive = np.flatnonzero(bound >= best.least(i))
        order = alive[np.argsort(-bound[alive], kind="stable")]
        for at in range(0, len(order), STEP):
            if bound[order[at]] < best.least(i):
                break
            some = order[at:at + STEP]
            some = some[ids[some] != q_ids[i]]
            if len(some):
                best.add(i, _products(q[i:i + 1], x[some])[0], ids[some])
    own = queries["row"].to_numpy()
    rows = [(int(own[i]), int(q_ids[i]), vec_id, score) for i in range(len(q)) for score, vec_id in best.rows[i]]
    return pd.DataFrame(rows, columns=["query_row", "query_id", "vec_id", "score"])


def _evaluate(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best of each query within each pair (query_block, block); a task holds one pair."""
    left = pairs.join(queries.withColumnRenamed("block", "query_block"), "query_block") \
        .select("query_block", "block", "row", "vec_id", "vector", "norm", "to_pivots", "least")
    right = pairs.join(vectors, "block").select(F.col("query_block").alias("with_query_block"), F.col("block").alias("of_block"), "vec_id", "vector", "norm", "to_pivots")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return compare(a, b, k) if len(a) and len(b) else pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return left.groupBy("query_block", "block").cogroup(right.groupBy("with_query_block", "of_block")).applyInPandas(run, "query_row long, query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(table: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, queries_block: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each row whose vec_id is divisible by ``every``.

    ``table`` has vec_id and embedding; other columns are ignored. Vectors of
    different lengths are compared as if the shorter ended in zeros. Ties go to
    the smaller vec_id. Rows that repeat an id are candidates each, but not of
    queries of that id; each query row has an answer of its own, so an id that
    is asked twice has each rank twice. Fewer than k candidates are all returned; an empty table gives an
    empty result.
    """
    spark = table.sparkSession
    ints = cut(integer_vectors(table), "vectors")
    pivots = choose_pivots(ints)
    if not len(pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = blocked(with_pivots(cut(candidates(ints, k), "candidates"), pivots), block, "vector-blocks")
    asked = blocked(with_pivots(ints.filter(F.col("vec_id") % every == 0), pivots), queries_block, "query-blocks")
    if not asked.head(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    about, about_queries = cut(summaries(rows), "block-sums"), cut(summaries(asked), "query-sums")

    # a row for each pair of a query block and a block: the stated queries, in blocks, against all rows, in blocks
    blocks = about.agg(F.max("block")).first()[0]
    gaps = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("q_low", "q_high"),
                      lambda x, q: F.greatest(F.lit(0.0), x["low"] - q["q_high"], q["q_low"] - x["high"]))
    pairs = about_queries.select(F.col("block").alias("query_block"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("norm").alias("q_norm"),
                                 F.explode(F.sequence(F.lit(0), F.lit(blocks))).alias("block")).join(about, "block") \
        .select("query_block", "block", F.array_max(gaps).alias("gap"), (F.col("q_norm") + F.col("norm")).alias("norms"))
    pairs = cut(pairs.withColumn("bound", (F.col("norms") - F.col("gap") * F.col("gap")) / 2 * (1 + SLACK) + 1 + SLACK * F.col("norms")), "pairs")

    promise = W.partitionBy("query_block").orderBy(F.desc("bound"), "block")
    home = pairs.withColumn("n", F.row_number().over(promise)).filter("n = 1").select("query_block", "block")
    unknown = asked.withColumn("least", F.lit(float("-inf")))
    first = cut(_evaluate(home, unknown, rows, k), "first-round")
    reached = _top(first, k).filter(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("least"))
    known = cut(asked.join(reached, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "queries")
    to_beat = known.groupBy(F.col("block").alias("query_block")).agg(F.min("least").alias("worst"))
    rest = pairs.join(home, ["query_block", "block"], "left_anti").join(to_beat, "query_block").filter("bound >= worst").select("query_block", "block")
    second = _evaluate(rest, known, rows, k)
    return _top(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")

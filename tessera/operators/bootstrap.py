"""Poisson bootstrap (R5) with the replicates as vectors.

Replicate b gives a row the weight Poisson(1) drawn from md5(key, b, seed).
A row's weights are one vector of length B, drawn once for a key, whichever
models scored it, as long as its rows come in one batch. No row is ever
expanded by the number of replicates:

* F1: each task keeps 3 x B sums for every group it meets (true positives,
  false positives, false negatives); only those vectors leave it.
* ROC-AUC: rows travel once, with their packed weights (half a byte each),
  to ranges of (group, score, key). A range is read in order and keeps, for
  each replicate, the sum of its own pairs, its positives and negatives, and
  its first and last score level. Pairs across ranges follow from those.

What is shuffled is rows x B / 2 bytes for AUC, and groups x tasks x B values
else. Batches of any size and ranges with one score use bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import TWO_32, md5_heads, poisson1_cdf
from tessera.session import materialize

#: Weights of so many values are held at a time.
CELLS = 1 << 21
#: And so many while pairs are counted; with so few rows that their products fit 32 bits.
COUNTED, COUNTED_ROWS = 1 << 18, 1024
VECTOR = "array<double>"


class Weights:
    """The weight vectors of keys, for one number of replicates and seed."""

    def __init__(self, replicates: int, seed: int) -> None:
        self.replicates = replicates
        self.ends = [f"|{b}|{seed}".encode() for b in range(1, replicates + 1)]
        # u <= F(k), u being a word / 2**32: the word is at most F(k) * 2**32 (a product that is exact)
        self.borders = [np.uint32(min(int(c * TWO_32), 2**32 - 1)) for c in poisson1_cdf()]

    def drawn(self, keys: list[str]) -> np.ndarray:
        """One row of ``replicates`` weights (0 to 20) for each key."""
        words = md5_heads([key.encode() for key in keys], self.ends)
        out = np.zeros(words.shape, dtype=np.uint8)
        for border in self.borders:  # the least k with u <= F(k)
            out += words > border
        return out

    def packed(self, row: np.ndarray) -> bytes:
        """Two weights a byte; a row with one above 15 (about one in 10**13) has a byte for each."""
        if len(row) < 2 or row.max() > 15:
            return row.tobytes()
        even = np.append(row, np.uint8(0)) if len(row) % 2 else row
        return (even[::2] << 4 | even[1::2]).tobytes()

    def unpacked(self, cells: list[bytes]) -> np.ndarray:
        half = (self.replicates + 1) // 2
        if self.replicates > 1 and all(len(c) == half for c in cells):
            both = np.frombuffer(b"".join(cells), dtype=np.uint8).reshape(len(cells), half)
            return np.stack([both >> 4, both & 15], axis=2).reshape(len(cells), -1)[:, :self.replicates]
        return np.concatenate([np.frombuffer(c, dtype=np.uint8)[None] if len(c) == self.replicates else self.unpacked([c]) for c in cells])


def _vectors(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Rows of (group, numbers and vectors) as a batch."""
    columns = []
    for values in zip(*rows, strict=True):
        if isinstance(values[0], np.ndarray):
            ends = np.cumsum([0] + [len(v) for v in values])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).astype(np.float64))))
        else:
            columns.append(pa.array(values))
    return pa.RecordBatch.from_arrays(columns, names=names)


def _keyed(pred: DataFrame, by: list[str], key: str) -> tuple[DataFrame, str]:
    """``pred`` with its group and key as texts, and the group's schema to read it back with."""
    group = F.to_json(F.struct(*[F.col(f"`{c}`") for c in by])) if by else F.lit("{}")
    return pred.withColumns({"__g": group, "__k": F.coalesce(F.col(key).cast("string"), F.lit(""))}), pred.select(*by).schema.simpleString()


def _unfolded(df: DataFrame, by: list[str], schema: str, vectors: list[str], scalars: list[str] | None = None) -> DataFrame:
    """One row for each replicate ``__b`` of a row of vectors, with the group's columns again."""
    at = F.posexplode(F.arrays_zip(*vectors)).alias("__b", "__v")
    out = df.withColumn("__by", F.from_json("__g", schema)) if by else df
    return out.select(*[F.col(f"__by.`{c}`").alias(c) for c in by], "__g", *(scalars or []), at) \
        .select(*by, "__g", *(scalars or []), "__b", *[F.col(f"__v.{v}").alias(v) for v in vectors])


def replicate_f1(pred: DataFrame, by: list[str], key: str, y: str, score: str, threshold: float, replicates: int, seed: int) -> DataFrame:
    """(by..., __b, v): F1 of each replicate."""
    keyed, schema = _keyed(pred, by, key)
    weights = Weights(replicates, seed)
    step = max(1, CELLS // replicates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                group, keys, positive, hit = (c.slice(at, step) for c in batch.columns)
                names, own = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)
                drawn = weights.drawn(names.tolist())[own]
                groups, of = np.unique(group.to_numpy(zero_copy_only=False), return_inverse=True)
                yes, hits = positive.to_numpy(zero_copy_only=False), hit.to_numpy(zero_copy_only=False)
                for i, name in enumerate(groups.tolist()):
                    cell = sums.setdefault(name, np.zeros((3, replicates)))
                    for j, (a, b) in enumerate(((1, 1), (0, 1), (1, 0))):
                        cell[j] += drawn[(of == i) & (yes == a) & (hits == b)].sum(axis=0, dtype=np.int64)
        if sums:
            yield _vectors([(g, *cell) for g, cell in sums.items()], ["__g", "tp", "fp", "fn"])

    hit = (F.col(score) >= F.lit(threshold)).cast("double")
    cells = keyed.select("__g", "__k", F.col(y).cast("double").alias("y"), hit.alias("hit")) \
        .mapInArrow(run, f"__g string, tp {VECTOR}, fp {VECTOR}, fn {VECTOR}")
    per = _unfolded(cells, by, schema, ["tp", "fp", "fn"]).groupBy(*by, "__b").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return per.select(*by, "__b", F.when(whole != 0, 2 * F.col("tp") / F.when(whole != 0, whole)).otherwise(F.lit(0.0)).alias("v"))


class _Range:
    """Sums of one group's rows in one range, which come in order of their score."""

    def __init__(self, replicates: int) -> None:
        self.u, self.p, self.n = (np.zeros(replicates) for _ in range(3))
        self.first: tuple | None = None
        self.level: tuple | None = None  # (score, positives, negatives) of the level that may go on

    def close(self) -> None:
        """Count the open level's pairs."""
        _, pos, neg = self.level
        self.u += pos * (self.n + neg / 2)
        self.p += pos
        self.n += neg
        self.first = self.first or self.level

    def add(self, scores: np.ndarray, yes: np.ndarray, drawn: np.ndarray) -> None:
        new = np.flatnonzero(np.append(True, (scores[1:] != scores[:-1]) & ~(np.isnan(scores[1:]) & np.isnan(scores[:-1]))))
        begin, end = 0, new[-1]
        if self.level is not None:
            if self.level[0] == scores[0] or (np.isnan(self.level[0]) and np.isnan(scores[0])):
                begin = new[1] if len(new) > 1 else len(scores)
                _, pos, neg = self._level(scores, yes, drawn, 0, begin)
                self.level = self.level[0], self.level[1] + pos, self.level[2] + neg
                if len(new) == 1:
                    return
            self.close()
        if begin < end:
            if self.first is None:
                self.first = self._level(scores, yes, drawn, 0, new[1])
            of = np.cumsum(np.isin(np.arange(begin, end), new, assume_unique=True)) - 1  # number of the row's level
            self._count(of, yes[begin:end], drawn[begin:end])
        self.level = self._level(scores, yes, drawn, end, len(scores))

    @staticmethod
    def _level(scores: np.ndarray, yes: np.ndarray, drawn: np.ndarray, a: int, b: int) -> tuple:
        rows, of = drawn[a:b], yes[a:b]
        return float(scores[a]), *(rows[of == k].sum(axis=0, dtype=np.int64).astype(np.float64) for k in (1, 0))

    def _count(self, of: np.ndarray, yes: np.ndarray, drawn: np.ndarray) -> None:
        """Count the pairs of whole levels: a positive has the negatives below its level, and half of those in it."""
        pos, neg = np.flatnonzero(yes == 1), np.flatnonzero(yes == 0)
        below = np.zeros((len(neg) + 1, drawn.shape[1]), dtype=np.int32)
        np.cumsum(drawn[neg], axis=0, dtype=np.int32, out=below[1:])
        low, high = (np.searchsorted(of[neg], of[pos], side) for side in ("left", "right"))
        near = below[low]
        near += below[high]
        weights = drawn[pos].astype(np.int32)
        positives = weights.sum(axis=0, dtype=np.int64)
        near *= weights
        self.u += near.sum(axis=0, dtype=np.int64) / 2 + positives * self.n
        self.p += positives
        self.n += below[-1]

    def row(self) -> tuple:
        self.close()
        return self.u, self.p, self.n, *self.first, *self.level


def replicate_auc(pred: DataFrame, by: list[str], key: str, y: str, score: str, replicates: int, seed: int) -> DataFrame:
    """(by..., __b, v): ROC-AUC of each replicate that has both classes. Rows without a score come first, NaN last.

    A range gives, for each replicate, its positives P, its negatives N and
    the sum of its own pairs; P times the negatives of the ranges before adds
    the pairs across ranges. Ranges may share a score (many ties do not make
    one large range): such pairs count a half, which is put right from the
    first and last level of each range.
    """
    keyed, schema = _keyed(pred, by, key)
    weights = Weights(replicates, seed)
    step, few = max(1, CELLS // replicates), max(1, min(COUNTED_ROWS, COUNTED // replicates))
    parts = int(pred.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                names, own = np.unique(part.column(1).to_numpy(zero_copy_only=False), return_inverse=True)
                cells = [weights.packed(row) for row in weights.drawn(names.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.binary()).take(pa.array(own))], names=["__g", "__k", "y", "score", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["__g", "__range", "u", "p", "n", "first_score", "first_pos", "first_neg", "last_score", "last_pos", "last_neg"]
        name, kept, number = None, None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                group, yes, number = part.column(0), part.column(1).to_numpy(zero_copy_only=False), part.column(4)[0].as_py()
                # no score is below every score
                scores = part.column(2).fill_null(float("-inf")).to_numpy(zero_copy_only=False)
                drawn = weights.unpacked(part.column(3).to_pylist())
                group = group.to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() + [len(group)]
                for a, b in zip(edges[:-1], edges[1:]):
                    if group[a] != name:
                        if kept is not None:
                            yield _vectors([(name, number, *kept.row())], names)
                        name, kept = group[a], _Range(replicates)
                    for i in range(a, b, few):
                        j = min(b, i + few)
                        kept.add(scores[i:j], yes[i:j], drawn[i:j])
        if kept is not None:
            yield _vectors([(name, number, *kept.row())], names)

    # a key's rows come together, for weights drawn once, and as many to each task: hold-out rows may all lie in a few files.
    # Rows without a key need one vector in all, so any task takes some of them
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(score, y), F.lit(parts))).otherwise(F.lit(0))
    even = keyed.select("__g", "__k", F.col(y).cast("double").alias("y"), F.col(score).cast("double").alias("score"), spread.alias("__s")) \
        .repartition(parts, "__k", "__s").drop("__s")
    # written, since dealing by ranges reads its input twice and weights should be drawn once
    weighed = materialize(even.mapInArrow(weigh, "__g string, __k string, y double, score double, w binary"))
    # the count is stated: few bytes, but much work for each, must not be joined to one task
    dealt = weighed.repartitionByRange(parts, "__g", "score", F.xxhash64("__k")).sortWithinPartitions("__g", "score") \
        .select("__g", "y", "score", "w", F.spark_partition_id().cast("long").alias("__range"))
    vectors = ["u", "p", "n", "first_pos", "first_neg", "last_pos", "last_neg"]
    ranges = materialize(dealt.mapInArrow(run, f"__g string, __range long, u {VECTOR}, p {VECTOR}, n {VECTOR}, first_score double, first_pos {VECTOR}, "
                                               f"first_neg {VECTOR}, last_score double, last_pos {VECTOR}, last_neg {VECTOR}"))
    rows = _unfolded(ranges, by, schema, vectors, ["__range", "first_score", "last_score"])
    line = Window.partitionBy("__g", "__b").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(line), F.lit(0.0))
    pairs = rows.select(*by, "__b", (F.col("u") + F.col("p") * before).alias("u"), "p", "n")
    level = lambda side: F.struct(F.col(f"{side}_score").alias("score"), F.col(f"{side}_pos").alias("pos"), F.col(f"{side}_neg").alias("neg"))
    edges = rows.select(*by, "__g", "__range", "__b", F.explode(F.array_distinct(F.array(level("first"), level("last")))).alias("e")) \
        .select(*by, "__g", "__range", "__b", "e.*")
    tied = Window.partitionBy("__g", "__b", "score").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("neg").over(tied), F.lit(0.0))
    ties = edges.withColumn("__counted", F.col("pos") * F.col("neg") * 0.5 + F.col("pos") * earlier).groupBy(*by, "__b", "score").agg(
        (F.sum("pos") * F.sum("neg") * 0.5 - F.sum("__counted")).alias("u"))
    zero = F.lit(0.0)
    total = pairs.unionByName(ties.select(*by, "__b", "u", zero.alias("p"), zero.alias("n"))).groupBy(*by, "__b").agg(
        F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.where((F.col("p") > 0) & (F.col("n") > 0)).select(*by, "__b", (F.col("u") / (F.col("p") * F.col("n"))).alias("v"))

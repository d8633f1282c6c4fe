"""Benchmark decontamination by winnowing (operator 3).

A window is ``window`` consecutive words of a benchmark item (the whole item if
it has fewer words). Document words inside any occurrence of a window are hit.

For windows of n words the k-gram length is k = (n + 1) // 2 and each run of
w = n - k + 1 k-grams keeps its leftmost smallest hash, so k + w - 1 = n: two
texts that share n consecutive words keep the same k-gram of them, at the same
place. Kept k-grams of documents are joined to those of the items in Spark. A
benchmark fingerprint carries the 64-bit hashes of the words around it, as far
as a window that keeps it can reach; a candidate is extended to both sides by
comparing them to the document's words, and runs of n words or more are hits.
Items shorter than ``window`` form classes of their own length, each with its
own k and w, so short items are found by the same join.

The join key of the second pass is a hash of the text: documents with equal
text have equal candidates, which are looked for and kept once. Should two
texts ever share that hash, the extension tells them apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.shared import cut

WINDOW = 10
#: Benchmark fingerprints are broadcast up to so many rows (about 200 bytes each); beyond, Spark shuffles both sides.
BROADCAST_ROWS = 50_000


def _k_w(n: int) -> tuple[int, int]:
    k = (n + 1) // 2
    return k, n - k + 1


def _text_key(text) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _classes(lengths: np.ndarray, window: int) -> np.ndarray:
    return np.minimum(lengths, window)


def item_lengths(items: DataFrame, window: int) -> list[int]:
    """The window lengths that occur among the items (at most ``window`` different ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, found in W.chunks(batch.column(0)):
                seen |= set(_classes(found.counts, window).tolist()) - {0}
        yield pa.RecordBatch.from_pydict({"n": pa.array(sorted(seen), type=pa.int64())})

    rows = items.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long").distinct().collect()
    return sorted(r["n"] for r in rows)


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """(hash, n, context, at, items): kept k-grams of the items with the words around them.

    ``context`` holds the word hashes of every window that can keep the
    k-gram, ``at`` the k-gram's place in it. Equal rows of several items are
    one row with the sorted item ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: dict[str, list] = {"item_id": [], "hash": [], "n": [], "context": [], "at": []}
            for row, _, found in W.chunks(batch.column(1)):
                hashes = found.hashes()
                for d in range(found.n):
                    a, b = int(found.first[d]), int(found.first[d + 1])
                    if a == b:
                        continue
                    n = int(min(b - a, window))
                    k, w = _k_w(n)
                    own = W.Words(found.data, np.array([0, 1]), found.start[a:b], found.end[a:b], np.array([0, b - a]))
                    for at, h in zip(*W.winnow(own, hashes[a:b], k, w, n), strict=True):
                        left = max(0, int(at) - (w - 1))
                        right = min(b - a, int(at) + n)
                        rows["item_id"].append(ids[row + d])
                        rows["hash"].append(int(h.view(np.int64)))
                        rows["n"].append(n)
                        rows["context"].append(hashes[a + left:a + right].tobytes())
                        rows["at"].append(int(at) - left)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
                [("item_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int32()), ("context", pa.binary()), ("at", pa.int32())]))

    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "item_id long, hash long, n int, context binary, at int")
    return found.groupBy("hash", "n", "context", "at").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def document_fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, n, at, hash): the k-grams that winnowing keeps from each text, for every window length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for row, stop, found in W.chunks(batch.column(1)):
                hashes, text = found.hashes(), found.text_of_word()
                for n in lengths:
                    at, h = W.winnow(found, hashes, *_k_w(n), n)
                    of = text[at]
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(keys[row:stop][of]), "n": pa.array(np.full(len(at), n, dtype=np.int32)),
                        "at": pa.array((at - found.first[of]).astype(np.int32)), "hash": pa.array(h.view(np.int64))})

    texts = docs.select(_text_key(F.col("text")).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "key long, n int, at int, hash long")


def _extend(hashes: np.ndarray, candidates: list[dict], covered: np.ndarray) -> set[int]:
    """Mark the words of ``hashes`` that the candidates' windows cover; the ids of the items that occur."""
    items: set[int] = set()
    for c in candidates:
        context = np.frombuffer(c["context"], dtype=np.uint64)
        low = max(0, c["place"] - c["at"])
        high = min(len(hashes), c["place"] - c["at"] + len(context))
        skip = low - (c["place"] - c["at"])
        same = hashes[low:high] == context[skip:skip + high - low]
        anchor = c["place"] - low
        if not 0 <= anchor < len(same) or not same[anchor]:
            continue
        breaks = np.flatnonzero(~same)
        cut_at = int(np.searchsorted(breaks, anchor))
        begin = low + (int(breaks[cut_at - 1]) + 1 if cut_at else 0)
        end = low + (int(breaks[cut_at]) if cut_at < len(breaks) else len(same))
        if end - begin >= c["n"]:
            covered[begin:end] = True
            items.update(i for i in c["items"] if i is not None)
    return items


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans and item_ids added in a struct ``__found``.

    ``docs`` needs a string column ``text`` (null: no words), ``benchmark``
    columns item_id (long) and text; further columns of docs pass through
    (names that begin with two underscores are this package's own). hit_spans holds [first word, word after the last]
    of each maximal run of hit words. An empty benchmark hits nothing; rows
    that repeat are each reported; items without id count as hits but are not
    listed.
    """
    kind = "n_words long, n_hit long, hit_spans array<array<long>>, item_ids array<long>"
    lengths = item_lengths(benchmark, window)
    marks = cut(item_fingerprints(benchmark, window), "item-fingerprints")
    if marks.count() <= BROADCAST_ROWS:
        marks = F.broadcast(marks)
    # equal texts meet here: their candidates are counted once
    met = document_fingerprints(docs, lengths).join(marks.withColumnRenamed("at", "in_context"), ["hash", "n"]) \
        .groupBy("key", "n", F.col("at").alias("place"), F.col("in_context").alias("at"), "context").agg(F.first("items").alias("items"))
    candidates = met.groupBy("key").agg(F.collect_list(F.struct("n", "place", "at", "context", "items")).alias("candidates"))
    # a table, so that Spark can split the documents of a text with many copies in the join
    candidates = cut(candidates.select(F.col("key").alias("__key"), F.col("candidates").alias("__candidates")), "candidates")

    @F.arrow_udf(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")
    def extend(texts: pa.Array, found: pa.Array) -> pa.Array:
        out: dict[str, list] = {"n_words": [], "n_hit": [], "hit_spans": [], "item_ids": []}
        for row, _, split in W.chunks(texts):
            hashes = split.hashes()
            for d in range(split.n):
                own = hashes[split.first[d]:split.first[d + 1]]
                wanted = found[row + d].as_py()
                out["n_words"].append(len(own))
                if not wanted:
                    out["n_hit"].append(0)
                    out["hit_spans"].append([])
                    out["item_ids"].append([])
                    continue
                covered = np.zeros(len(own) + 2, dtype=bool)
                items = _extend(own, wanted, covered[1:-1])
                edges = np.flatnonzero(covered[1:] != covered[:-1])
                out["n_hit"].append(int(covered.sum()))
                out["hit_spans"].append(edges.reshape(-1, 2).tolist())
                out["item_ids"].append(sorted(items))
        spans = pa.list_(pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["hit_spans"], spans),
             pa.array(out["item_ids"], pa.list_(pa.int64()))], names=list(out))

    # the same join at every size: the candidates grow with the documents
    return docs.withColumn("__key", _text_key(F.col("text"))).join(candidates.hint("merge"), "__key", "left") \
        .withColumn("__found", extend("text", "__candidates")).drop("__key", "__candidates")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns as they were."""
    return scan(docs, benchmark, window).filter("__found.n_hit = 0").drop("__found")

"""Packing documents into training sequences along a Hilbert curve (operator 2).

Each document's token ids are hashed to vectors of ``DIMS`` numbers whose mean
is the document's place; the places are ordered along a Hilbert curve, so
documents with similar tokens follow one another and copies lie side by side.
Documents are laid end to end in that order and the line is cut every
``SEQUENCE`` tokens; what is left at its end is cut into powers of two, so
nothing needs padding.

Texts are tokenised once, into a table in the shared folder. Only (curve key,
row, length) is sorted by range; running sums within ranges and a small table
of range totals give every document its offset, which is joined back to its
ids. Documents with equal keys are told apart by row, so ranges stay even.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.shared import cut
from tessera.llm.words import mix

SEQUENCE = 1024
END_ID = 0
DIMS, BITS = 4, 12
#: Spread of the mean token vectors before they are squeezed into the unit cube.
GAIN = 8.0
#: Texts are tokenised in groups of so many at most.
GROUP = 256
#: Letters for which both tokeniser libraries split words alike (checked by tests); other texts use the slower one.
PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")


class Encoder:
    """Ids of a byte-level BPE vocabulary file of the tokenizers library, special tokens not added.

    The file's merges are in order of their ids, so tiktoken gives the same ids
    about five times as fast; it takes the texts of plain letters, and the
    tokenizers library all others and those that spell a special token.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # bytes that print stand for themselves, the others for the characters from 256 on
        prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        # the split of byte-level BPE vocabularies
        split = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("file", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.vocabulary = 1 + max(*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))

    def __call__(self, text: str) -> list[int]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def projection(vocabulary: int) -> np.ndarray:
    """A fixed pseudo-random vector in [-1, 1) for each id."""
    cells = mix(np.arange(1, vocabulary * DIMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (cells.astype(np.float64) / 2.0 ** 63 - 1).astype(np.float32).reshape(vocabulary, DIMS)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n x dims, each below 2**bits).

    From the highest bit down, the cube's orientation is undone by exchanging
    or reflecting the lower bits of the first axis and another; Gray decoding
    then orders the cells and the axes' bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            high = (x[i] >> b) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(means: np.ndarray) -> np.ndarray:
    """Hilbert keys of mean token vectors."""
    unit = np.arctan(GAIN * means) / np.pi + 0.5
    return hilbert(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(row, doc_id, key, n, ids): a row for each document, its ids (and END_ID) as unsigned 16- or 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        table, kind = projection(encode.vocabulary), np.dtype("<u2" if encode.vocabulary <= 1 << 16 else "<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, GROUP):
                batch = whole.slice(at, GROUP)
                ids, means, counts = [], [], []
                for text in batch.column("text"):
                    got = np.array(encode(text.as_py() or ""), dtype=kind)
                    means.append(table[got].mean(axis=0, dtype=np.float64) if len(got) else np.zeros(DIMS))
                    got = np.append(got, kind.type(END_ID))
                    counts.append(len(got))
                    ids.append(got.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id"), pa.array(curve_keys(np.array(means))), pa.array(counts, pa.int64()),
                     pa.array(ids, pa.binary())], names=["row", "doc_id", "key", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, key long, n long, ids binary")


def offsets(rows: DataFrame) -> tuple[DataFrame, int]:
    """(row, begin): where each row (row, key, n) starts on the line in order of (key, row), and the line's length."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.select("key", "row", "n").repartitionByRange(parts, "key", "row").withColumn("part", F.spark_partition_id()), "curve")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("total"))  # one row for each range
    before = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("part").orderBy("key", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    begin = ranged.withColumn("inside", inside).join(F.broadcast(before), "part").select("row", (F.col("before") + F.col("inside")).alias("begin"))
    return begin, totals.agg(F.sum("total")).first()[0] or 0


def tail_cuts(total: int, sequence: int) -> np.ndarray:
    """Starts of the sequences after the last full one: powers of two, largest first, and the line's end."""
    at, cuts = total - total % sequence, []
    for b in range(sequence.bit_length() - 1, -1, -1):
        if total % sequence >> b & 1:
            cuts.append(at)
            at += 1 << b
    return np.array([*cuts, total], dtype=np.int64)


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``docs`` needs doc_id and text (null text: empty, so only END_ID; repeated
    rows are packed each; other columns are ignored; an empty table gives no
    rows); ``sequence`` is a power of two and ``tokenizer`` the path of a
    byte-level BPE file, at the same place on every machine. Returns doc_id, start (ids of its document before it), length,
    ids_crc32, doc_tokens, sequence_id, offset, sequence_length and, with
    ``with_ids``, the ids as little-endian unsigned 32-bit integers.
    """
    if sequence & (sequence - 1):
        raise ValueError("the sequence length must be a power of two")
    rows = cut(tokenised(docs, tokenizer), "tokens")
    begin, total = offsets(rows)
    full, tail = total // sequence, tail_cuts(total, sequence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length"]
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names} | ({"ids": []} if with_ids else {})
            for doc_id, n, at, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "begin", "ids")), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                stop = at + n
                edges = [at, *range((at // sequence + 1) * sequence, min(stop, full * sequence + 1), sequence),
                         *(int(t) for t in tail if at < t < stop and t % sequence), stop]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a < full * sequence:
                        number, origin, size = a // sequence, a - a % sequence, sequence
                    else:
                        k = int(np.searchsorted(tail, a, side="right")) - 1
                        number, origin, size = full + k, int(tail[k]), int(tail[k + 1] - tail[k])
                    own = ids[a - at:b - at].tobytes()
                    for name, value in zip(names, (doc_id, a - at, b - a, zlib.crc32(own), n, number, a - origin, size), strict=True):
                        out[name].append(value)
                    if with_ids:
                        out["ids"].append(own)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    return rows.select("row", "doc_id", "n", "ids").join(begin, "row").select("doc_id", "n", "begin", "ids") \
        .mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def sequences(found: DataFrame) -> DataFrame:
    """(sequence_id, sequence_length, ids): the sequences that ``pieces`` with ids make up, each of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return found.groupBy("sequence_id", "sequence_length").agg(parts.alias("parts")) \
        .select("sequence_id", "sequence_length", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"))

"""Collocations by sorted count streams (operator 12).

Phrases are counted level by level: words first, then the pairs of frequent
words, then the triples of frequent pairs, as a phrase is no more frequent than
its parts. What a level found frequent goes to the next as a bit filter of
fixed size (``FILTER_BITS``): it may let a rare phrase through to be counted,
never stops a frequent one, and counts alone decide.

The frequent phrases of all lengths then form one stream, laid out twice on
the shared disk: in prefix order (sorted by first word, second, ...) and in
suffix order (by last word, the one before, ...). A stream is cut into ranges
of about equal size, each sorted. In prefix order a phrase stands behind its
first word, its first two words and so on, and before its extensions, so one
pass in lockstep over the lengths finds the count of each beginning and the
most frequent extension to the right; in suffix order the same pass finds the
counts of the endings and the extensions to the left. What crosses the border
of ranges is put right from a table of one row for each range. The two results
are merge-joined phrase by phrase. No group of a word is ever gathered, so a
word that begins a third of all phrases is only a longer part of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import words as T
from tessera.llm.shared import cut

MAX_WORDS, LEAST_COUNT, LEAST_SHARE, TOP = 3, 10, 50, 2000
#: Size of the filter between levels (16 MB). More phrases than that make it let more through, which costs time and disk, not results.
FILTER_BITS = 1 << 27
#: About as many words (of six bytes) a task counts together before it hands on the sums.
COUNTED_WORDS = 1 << 20

#: A-Z in lower case; the bytes [.,;:!?\x0A-\x0D] that end a piece become full stops. Only \x20 and \x09 are left for split() to cut at.
_TABLE = T.LOWER.copy()
_TABLE[list(b".,;:!?\n\x0b\x0c\r")] = ord(".")
TABLE = _TABLE.tobytes()


def _slots(hashes: np.ndarray, places: list[np.ndarray], salt: int) -> np.ndarray:
    """Filter bit of each phrase, from the hashes of its words by place."""
    total = np.full(len(places[0]), salt, dtype=np.uint64)
    for k, ids in enumerate(places):
        total += hashes[ids] * T.PLACE[k]
    return (T.mix(total) % np.uint64(FILTER_BITS)).astype(np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _count(lang: str, text: bytes, size: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """Sums of the phrases of ``size`` words in pieces that full stops separate; ``bits`` filters their parts of one word less."""
    tokens = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter(map(known.setdefault, tokens, count()), dtype=np.int64, count=len(tokens))
    del tokens
    # numbers in order of the words, so that the sums come out sorted; full stops are -1
    stop = known.pop(b".", None)
    names = sorted(known)
    rank = np.full(len(ids) + 1, -1, dtype=np.int64)
    rank[np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))] = np.arange(len(names))
    if stop is not None:
        rank[stop] = -1
    ids = rank[ids]
    n = len(ids) - size + 1
    begins = np.arange(max(n, 0))
    if bits is not None and n > 0:
        hashes, salt = _hashes(names + [b"."]), xxhash.xxh64_intdigest(lang)
        part = size - 1
        fits = _passes(bits, _slots(hashes, [ids[k:len(ids) - part + 1 + k] for k in range(part)], salt))
        begins = np.flatnonzero(fits[:-1] & fits[1:])
    for k in range(size):
        begins = begins[ids[begins + k] >= 0]
    width = max(1, (len(names) - 1).bit_length())
    if width * size <= 63:
        code = np.zeros(len(begins), dtype=np.int64)
        for k in range(size):
            code = (code << width) | ids[begins + k]
        code, sums = np.unique(code, return_counts=True)
        places = [(code >> (width * (size - 1 - k))) & ((1 << width) - 1) for k in range(size)]
    else:
        rows, sums = np.unique(np.stack([ids[begins + k] for k in range(size)], axis=1), axis=0, return_counts=True)
        places = [rows[:, k] for k in range(size)]
    listed = pa.array(names, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), *[listed.take(pa.array(p)) for p in places], pa.array(sums, pa.int64())],
                                      names=["lang", *[f"w{k + 1}" for k in range(size)], "f"])


def counts(docs: DataFrame, size: int, kept=None) -> DataFrame:
    """(lang, w1 .. w<size>, f): how often each phrase of ``size`` words occurs within pieces, by language.

    ``kept`` is a broadcast bit filter (see ``_filter``): phrases with a part that it doesn't know may be left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if kept is None else np.frombuffer(kept.value, dtype=np.uint8)
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        held = 0

        def counted(lang: str) -> Iterator[pa.RecordBatch]:
            found = _count(lang, b" . ".join(waiting.pop(lang)), size, bits)
            for at in range(0, found.num_rows, 1 << 16):
                yield found.slice(at, 1 << 16)

        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                text = data[offsets[i]:offsets[i + 1]].tobytes().translate(TABLE).replace(b".", b" . ")
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                held += len(text)
                if sizes[lang] > 6 * COUNTED_WORDS or held > 12 * COUNTED_WORDS:
                    most = max(sizes, key=sizes.get)
                    held -= sizes.pop(most)
                    yield from counted(most)
        for lang in list(waiting):
            yield from counted(lang)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = [f"w{k + 1}" for k in range(size)]
    sums = texts.mapInArrow(run, f"lang string, {', '.join(w + ' string' for w in words)}, f long")
    return sums.repartition("lang", *words).groupBy("lang", *words).agg(F.sum("f").alias("f"))


def _filter(frequent: DataFrame, size: int):
    """A broadcast bit filter of ``FILTER_BITS`` bits with the phrases of a table (lang, w1 .. w<size>)."""
    words = [f"w{k + 1}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = {lang: xxhash.xxh64_intdigest(lang) for lang in batch.column(0).unique().to_pylist()}
            total = np.array([salts[lang] for lang in batch.column(0).to_pylist()], dtype=np.uint64)
            for k in range(size):
                total += _hashes(batch.column(1 + k).cast(pa.binary()).to_pylist()) * T.PLACE[k]
            yield pa.RecordBatch.from_arrays([pa.array((T.mix(total) % np.uint64(FILTER_BITS)).astype(np.int64))], names=["slot"])

    slots = frequent.select("lang", *words).mapInArrow(run, "slot long")
    number = F.col("slot") + 1  # the bitmap functions count from 1
    pages = slots.groupBy(F.bitmap_bucket_number(number).alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in pages.toLocalIterator():  # at most FILTER_BITS / 32768 pages of 4 KB
        at = (row["page"] - 1) * 4096
        out[at:at + 4096] = row["bits"]
    return frequent.sparkSession.sparkContext.broadcast(bytes(out))


def _stream(grams: DataFrame, words: list[Column], name: str) -> DataFrame:
    """The phrases sorted by ``words``, with ``before_j`` (count of their first j words) and ``most`` (of their most frequent extension by a word).

    ``words`` has MAX_WORDS columns, null beyond a phrase's length. Each phrase's beginnings must be in ``grams`` too.
    """
    depth_, n = F.col("depth"), len(words)
    keys = [f"k{i + 1}" for i in range(n)]
    parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = grams.select("lang", "depth", "f", "phrase", *[w.alias(k) for w, k in zip(words, keys, strict=True)])
    # no two rows have equal keys, so ranges hold about as many rows each, whatever word recurs
    laid = cut(laid.repartitionByRange(parts, "lang", *keys).withColumn("part", F.spark_partition_id()), name)
    order = W.partitionBy("part").orderBy("lang", *keys)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    inner = range(1, n)  # windows within a range; the rows of a range are one task's
    # the last row of j words at or before a longer phrase is its first j words
    seen = laid.withColumns({f"before_{j}": F.last(F.when(depth_ == j, F.col("f")), ignorenulls=True).over(upto) for j in inner}
                            | {f"group_{j}": F.sum((depth_ <= j).cast("int")).over(upto) for j in inner})
    most = {f"most_{j}": F.max(F.when(depth_ == j + 1, F.col("f"))).over(W.partitionBy("part", f"group_{j}")) for j in inner}
    # one row for each range: the count that stands open at its end, and the extensions at its begin of a phrase before it
    fences = cut(seen.groupBy("part").agg(
        *[F.max_by(F.when(depth_ == j, F.col("f")), F.when(depth_ == j, F.struct("lang", *keys))).alias(f"end_{j}") for j in inner],
        *[F.max(f"group_{j}").alias(f"last_{j}") for j in inner],
        *[F.max(F.when((depth_ == j + 1) & (F.col(f"group_{j}") == 0), F.col("f"))).alias(f"head_{j}") for j in inner]), f"{name}-fences")
    line = W.orderBy("part")
    fences = fences.withColumns(
        {f"open_{j}": F.last(f"end_{j}", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)) for j in inner}
        | {f"owner_{j}": F.sum((F.col(f"last_{j}") > 0).cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)) for j in inner})
    # extensions at a range's begin belong to the last phrase of the nearest range before it that has one
    after = line.rowsBetween(1, W.unboundedFollowing)
    fences = fences.withColumns({f"rest_{j}": F.max(F.struct(
        (-F.when(F.col(f"last_{j}") > 0, F.col(f"owner_{j}") - 1).otherwise(F.col(f"owner_{j}"))).alias("owner"), F.col(f"head_{j}").alias("head"))).over(after)
        for j in inner})
    fences = fences.withColumns({f"rest_{j}": F.when(-F.col(f"rest_{j}.owner") == F.col(f"owner_{j}"), F.col(f"rest_{j}.head")) for j in inner})
    tail = F.broadcast(fences.select("part", *[f"{c}_{j}" for j in inner for c in ("open", "last", "rest")]))  # one row for each range
    whole = seen.withColumns(most).join(tail, "part")
    own = F.lit(None).cast("long")
    for j in inner:
        reach = F.greatest(F.col(f"most_{j}"), F.when(F.col(f"group_{j}") == F.col(f"last_{j}"), F.col(f"rest_{j}")))
        own = F.when(depth_ == j, reach).otherwise(own)
    return whole.select("lang", "phrase", "depth", "f", own.alias("most"), *[F.when(depth_ > j, F.coalesce(f"before_{j}", f"open_{j}")).alias(f"before_{j}") for j in inner])


def _scored(docs: DataFrame, max_words: int, least_count: int, least_share: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``collocations``, and (lang, n): the words of each language."""
    kept, grams, total = None, None, None
    names = [f"w{k + 1}" for k in range(max_words)]
    for size in range(1, max_words + 1):
        found = counts(docs, size, kept)
        if size == 1:
            found = cut(found, "words")
            total = found.groupBy("lang").agg(F.sum("f").alias("n"))
        found = cut(found.filter(F.col("f") >= least_count), f"phrases-{size}")
        if kept is not None:
            kept.unpersist()
        kept = _filter(found, size) if size < max_words else None
        have, none = [F.col(w) for w in names[:size]], [F.lit(None).cast("string")] * (max_words - size)
        rows = found.select("lang", "f", F.lit(size).alias("depth"), F.concat_ws(" ", *have).alias("phrase"),
                            *[c.alias(f"p{i}") for i, c in enumerate(have + none)], *[c.alias(f"s{i}") for i, c in enumerate(have[::-1] + none)])
        grams = rows if grams is None else grams.unionByName(rows)
    inner = range(1, max_words)
    left = _stream(grams, [F.col(f"p{i}") for i in range(max_words)], "prefix-order").filter("depth > 1") \
        .select("lang", "phrase", F.col("depth").alias("words"), F.col("f").alias("a"), F.col("most").alias("right_most"), *[F.col(f"before_{j}").alias(f"first_{j}") for j in inner])
    right = _stream(grams, [F.col(f"s{i}") for i in range(max_words)], "suffix-order").filter("depth > 1") \
        .select("lang", "phrase", F.col("most").alias("left_most"), *[F.col(f"before_{j}").alias(f"last_{j}") for j in inner])
    both = left.hint("merge").join(right, ["lang", "phrase"])
    cuts = []
    for words in range(2, max_words + 1):
        for k in range(1, words):
            share = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) "
                           f"div (cast(first_{k} as decimal(19,0)) * cast(last_{words - k} as decimal(19,0)))")
            cuts.append(F.when(F.col("words") == words, F.struct(
                share.alias("score"), F.lit(k).alias("k"), F.col(f"first_{k}").alias("l"), F.col(f"last_{words - k}").alias("r"))))
    lowest = F.array_min(F.filter(F.array(*cuts), lambda c: c.isNotNull()))
    longer = F.coalesce(F.greatest("left_most", "right_most"), F.lit(0))
    found = both.filter(longer * 100 < F.col("a") * least_share).withColumn("lowest", lowest) \
        .select("lang", "phrase", "words", "a", "lowest.l", "lowest.r", "lowest.score")
    return found, total


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT, least_share: int = LEAST_SHARE) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of 2 to ``max_words`` words with ``least_count`` occurrences or more.

    ``docs`` needs lang and text; other columns are ignored. A-Z count as a-z; null texts are empty, a null lang is ``und``; each row counts,
    repeated or not. ``score`` is floor(1000000 * a * a / (l * r)) for the cut of a phrase into two parts that gives the lowest one (ties: the
    shortest first part), where a, l and r are the counts of the phrase, the first part and the rest. A phrase is left out if one of a word
    more that contains it has at least ``least_share`` percent of its occurrences. Texts without such phrases and empty tables give no rows.
    Counts are exact up to 10**15; a task's memory follows ``COUNTED_WORDS`` or the longest text.
    """
    return _scored(docs, max_words, least_count, least_share)[0]


def ranked(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, least_count: int = LEAST_COUNT, least_share: int = LEAST_SHARE) -> DataFrame:
    """Each language's first ``top`` collocations: lang, rank (from 1), phrase, a, l, r, n (words of the language), score.

    They come by score, then a, both descending, then phrase in the order of its bytes; so ranks have no ties.
    """
    found, total = _scored(docs, max_words, least_count, least_share)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

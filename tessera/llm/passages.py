"""Fuzzy repeated passages by collinear chaining (operator 4).

Seeds are the k-grams of words that winnowing keeps (any run of k + w - 1
words that two documents share has a common seed): short ones, which survive
between the edits of a fuzzy passage, and a sparse layer of long ones, which
tell passages apart that are made of the same few words. Pairs of neighbouring
short seeds are seeds too: they survive edits, and are rare enough that a fuzzy
passage meets an earlier holder though each of its short seeds was first seen
in some other document. Each seed is joined to its first occurrence in the order of documents, so a seed that n documents share
makes n - 1 matches and not n * n. The matches of a document with another are
chained: a Fenwick tree over the other document's places finds for each match
the best chain that ends before it in both documents, where a chain's score is
the words of its seeds less a cost for gaps. Chains are then aligned word by
word: seeds grow while words agree, gaps are aligned by their longest common
subsequence, the ends go on across edits as long as that raises the score, and an alignment of too little similarity is split at its worst
gap. What is left of a document's alignments with all its partners is merged
where it touches, so a passage whose parts were first seen in different
documents is whole; merged passages of ``LEAST_WORDS`` or more are reported
with the documents they were first seen in.

Word hashes for the alignment travel in blocks of fixed size, and only blocks
that a chain needs are joined, so neither a popular document nor a long one is
sent whole to each of its partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm import words as T
from tessera.llm.shared import cut

K, WINDOW = 5, 8
#: A second, sparse layer of long seeds: any run of LEAST_WORDS common words has one, however often its single words recur.
LONG_K, LONG_WINDOW = 24, 27
#: Each short seed makes a pair with so many of the next ones: pairs meet the first document that holds both, wherever either was first seen.
PAIRED = 2
LEAST_WORDS, SIMILARITY = 50, 0.8
#: Alignments with one document count from so many words (from K + 2 * WINDOW - 1 equal words on, winnowing guarantees a chain).
LEAST_PART = 20
#: Cost of each word of a gap, and the longest gap in a chain.
GAP_COST, LONGEST_GAP = 0.1, 32
#: Words beyond a chain's outer seeds that the alignment may reach: there, seeds may have been first seen elsewhere, or edits left none.
REACH = 64
#: How far the score of equal words less edits may fall beyond a chain's ends before the alignment stops.
DROP = 6
BLOCK = 256
#: Parts of one document that lie so close are one passage.
TOUCH = 2
#: An island made of parts from more documents than this is a passage only if LEAST_WORDS of it are from one of them.
MOST_SOURCES = 2
#: Seeds that at least this share of a sample of documents hold are dealt to several tasks.
HOT_SAMPLE, HOT_SHARE, HOT_SEEDS = 2000, 0.01, 1000
#: A seed's place is one long: the document's handle above the word's number.
PLACE_BITS = 26


def with_handles(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``__handle`` below 2**37 for each different (doc_id, text), and in ``__rows`` how many rows share it; null for rows without doc_id.

    The doc_id itself if every row has its own of fitting size; else distinct
    pairs are numbered in order of their ids.
    """
    have = docs.filter("doc_id IS NOT NULL")
    ids = have.groupBy("doc_id").count().agg(F.max("count"), F.min("doc_id"), F.max("doc_id")).first()
    if ids[0] is None or (ids[0] == 1 and 0 <= ids[1] and ids[2] < 1 << 37):
        return docs.withColumns({"__handle": F.col("doc_id").cast("long"), "__rows": F.lit(1).cast("long")})
    text = F.coalesce("text", F.lit(""))
    keyed = docs.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(F.lit("second"), text)})
    distinct = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id", "__k1", "__k2").agg(F.count(F.lit(1)).alias("__rows"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(distinct.repartitionByRange(parts, "doc_id", "__k1", "__k2").withColumn("part", F.spark_partition_id()), "handles")
    totals = ranged.groupBy("part").count()
    before = totals.select("part", (F.sum("count").over(W.orderBy("part")) - F.col("count")).alias("before"))
    order = W.partitionBy("part").orderBy("doc_id", "__k1", "__k2")
    numbers = ranged.withColumn("k", F.row_number().over(order) - 1).join(F.broadcast(before), "part") \
        .select("doc_id", "__k1", "__k2", "__rows", (F.col("before") + F.col("k")).alias("__handle"))
    return keyed.join(numbers, ["doc_id", "__k1", "__k2"], "left").drop("__k1", "__k2")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, text): one row for each handle; only rows that repeat are grouped."""
    texts = docs.filter("__handle IS NOT NULL").select(F.col("__handle").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "__rows")
    again = texts.filter("__rows > 1").groupBy("doc").agg(F.any_value("text").alias("text"))
    return texts.filter("__rows = 1").select("doc", "text").unionByName(again)


def repetition(words: np.ndarray, start: int, second: int, last: int) -> tuple[int, int]:
    """(place, length) of a repetition, from the first two and the last place of the k-gram that winnowing kept of it.

    The repetition reaches as far as each word equals the one a period before
    it. ``place`` is its first k-gram of this kind, so that repetitions of
    other texts that begin elsewhere in their period meet at the same phase.
    """
    period, end = second - start, last + K
    before = words[:start] == words[period:start + period]
    low = start - int(np.argmin(np.append(before[::-1], False)))
    after = words[end:] == words[end - period:len(words) - period]
    high = end + int(np.argmin(np.append(after, False)))
    return start - (start - low) // period * period, high - low


def fresh(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Places at which a hash differs from the one before it in the same text."""
    return np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1]))[:len(hashes)])


def seeds(docs: DataFrame) -> DataFrame:
    """(place, hash, extent): the k-grams that winnowing keeps, of both lengths, and pairs of neighbouring short ones.

    In a word or phrase that repeats itself, winnowing keeps one k-gram over
    and over. Only its first place is a seed; a repetition of
    ``LEAST_WORDS`` words or more adds seeds of the same place that stand for
    its length, one for each doubling, so that it meets the first document
    with a repetition as long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_ = batch.column(0).to_numpy()
            for row, stop, found in T.chunks(batch.column(1)):
                if len(found.start) and found.counts.max() >= 1 << PLACE_BITS:
                    raise ValueError(f"a text has {found.counts.max()} words; {1 << PLACE_BITS} are supported")
                hashes, text_of = found.hashes(), found.text_of_word()
                at, h = T.winnow(found, hashes, K, WINDOW)
                if not len(at):
                    continue
                of = text_of[at]
                first = fresh(h, of)
                last = np.append(first[1:], len(at)) - 1
                base = docs_[row:stop][of] << PLACE_BITS
                own, key = base[first] | (at[first] - found.first[of[first]]), h[first]
                columns = [(own, key, np.full(len(first), K))]
                long_at, long_h = T.winnow(found, hashes, LONG_K, LONG_WINDOW, LONG_K)
                kept = fresh(long_h, text_of[long_at])
                long_at, long_of = long_at[kept], text_of[long_at[kept]]
                columns.append(((docs_[row:stop][long_of] << PLACE_BITS) | (long_at - found.first[long_of]), long_h[kept], np.full(len(kept), LONG_K)))
                for step in range(1, PAIRED + 1):
                    near = np.flatnonzero((of[first[step:]] == of[first[:-step]]) & (at[first[step:]] - at[first[:-step]] <= LONGEST_GAP))
                    pair = T.mix(key[near] * T.PLACE[0] + key[near + step] * T.PLACE[1])
                    columns.append((own[near], pair, at[first[near + step]] - at[first[near]] + K))
                for i in np.flatnonzero((last > first) & (at[last] + 2 * WINDOW + K - at[first] >= LEAST_WORDS)):
                    text = found.first[of[first[i]]], found.first[of[first[i]] + 1]
                    place, length = repetition(hashes[text[0]:text[1]], at[first[i]] - text[0], at[first[i] + 1] - text[0], at[last[i]] - text[0])
                    sizes = LEAST_WORDS << np.arange(max(0, int(length // LEAST_WORDS).bit_length()))
                    columns.append((base[first[i]] | np.full(len(sizes), place), T.mix(h[first[i]] + sizes.astype(np.uint64)), 2 * sizes))
                place, key, extent = (np.concatenate(c) for c in zip(*columns, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(key.view(np.int64)), pa.array(extent.astype(np.int32))],
                                                 names=["place", "hash", "extent"])

    return _texts(docs).mapInArrow(run, "place long, hash long, extent int")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc, block, words): 32-bit hashes of each text's words in blocks of ``BLOCK`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_ = batch.column(0).to_pylist()
            for row, _, found in T.chunks(batch.column(1)):
                raw = (found.hashes() >> np.uint64(32)).astype("<u4")
                out: tuple[list, list, list] = [], [], []
                for d in range(found.n):
                    own = raw[found.first[d]:found.first[d + 1]]
                    for b in range(-(-len(own) // BLOCK)):
                        out[0].append(docs_[row + d])
                        out[1].append(b)
                        out[2].append(own[b * BLOCK:(b + 1) * BLOCK].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                                                 names=["doc", "block", "words"])

    return _texts(docs).mapInArrow(run, "doc long, block int, words binary")


def frequent(docs: DataFrame) -> list[int]:
    """Hashes of the seeds that many documents share: ``HOT_SEEDS`` at most, from a sample of about ``HOT_SAMPLE`` documents.

    They only say which seeds are dealt to several tasks; no result depends on them.
    """
    every = max(1, docs.count() // HOT_SAMPLE)
    some = docs.filter(F.pmod(F.xxhash64("__handle"), F.lit(every)) == 0)
    found = seeds(some).groupBy("hash").count().filter(F.col("count") >= HOT_SHARE * HOT_SAMPLE).orderBy(F.desc("count"), "hash").limit(HOT_SEEDS)
    return [row["hash"] for row in found.collect()]


def matches(found: DataFrame, hot: list[int]) -> DataFrame:
    """(doc, other, at, other_at, extent): each seed with its first occurrence, if that is in another document.

    All seeds go through one exchange: dealt by hash, sorted by hash and place and read in order, so the first row of a hash is its first
    occurrence. Only matches leave that pass. Seeds in ``hot`` are dealt by document as well and pass through unmatched; the first
    occurrence of each is then looked up in a table of at most ``HOT_SEEDS`` rows.
    """
    mask = (1 << PLACE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_hash, last_first = None, 0
        listed = np.array(sorted(hot), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, place, extent = (batch.column(i).to_numpy() for i in range(3))
            new = np.append(last_hash is None or key[0] != last_hash, key[1:] != key[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(at >= 0, place[at], last_first)
            last_hash, last_first = key[-1], first[-1]
            free = np.isin(key, listed)
            out = np.flatnonzero(free | (first >> PLACE_BITS != place >> PLACE_BITS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(place[out]), pa.array(np.where(free, 0, first)[out], mask=free[out]), pa.array(key[out], mask=~free[out]), pa.array(extent[out])],
                names=["place", "first", "hash", "extent"])

    spread = F.when(F.col("hash").isin(hot), F.pmod(F.xxhash64("place"), F.lit(1024))).otherwise(0) if hot else F.lit(0)
    dealt = found.select("hash", "place", "extent").repartition("hash", spread).sortWithinPartitions("hash", "place")
    met = cut(dealt.mapInArrow(run, "place long, first long, hash long, extent int"), "matches")
    shared = met.filter("first IS NULL").groupBy("hash").agg(F.min("place").alias("first"))
    firsts = {row["hash"]: row["first"] for row in shared.collect()} if hot else {}  # HOT_SEEDS rows at most
    keys = np.array(sorted(firsts), dtype=np.int64)
    places = np.array([firsts[k] for k in keys.tolist()], dtype=np.int64)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, key = batch.column(1).fill_null(-1).to_numpy().copy(), batch.column(2).fill_null(0).to_numpy()
            open_ = first < 0
            first[open_] = places[np.searchsorted(keys, key[open_])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first), batch.column(3)], names=["place", "first", "extent"])

    known = met.mapInArrow(look_up, "place long, first long, extent int") if hot else met
    return known.select(
        F.shiftright("place", PLACE_BITS).alias("doc"), F.shiftright("first", PLACE_BITS).alias("other"),
        F.col("place").bitwiseAND(F.lit(mask)).cast("int").alias("at"), F.col("first").bitwiseAND(F.lit(mask)).cast("int").alias("other_at"),
        "extent").filter("doc <> other")


def chain(at: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Chains (index arrays) of matches sorted by ``at``: both places grow and gaps are short.

    score(i) = K + max(0, score(j) - gap cost) over the matches j before i in
    both texts. The cost is linear in the places, so a Fenwick tree of prefix
    maxima of score + cost-to-here, indexed by the other text's places, finds
    the best j in logarithmic time. Best chains are taken first; each match is
    in one chain, which is cut at gaps beyond ``LONGEST_GAP``.
    """
    n = len(at)
    ranks = np.searchsorted(np.unique(other), other) + 1
    size = int(ranks.max())
    best, arg = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    here = (GAP_COST / 2 * (at + other)).tolist()
    ranks_, ats = ranks.tolist(), at.tolist()
    waiting: list[int] = []  # matches at the present place: they can't precede each other
    for i in range(n):
        if waiting and ats[waiting[0]] != ats[i]:
            for j in waiting:
                value, r = score[j] + here[j], ranks_[j]
                while r <= size:
                    if value > best[r]:
                        best[r], arg[r] = value, j
                    r += r & -r
            waiting = []
        r, top, j = ranks_[i] - 1, float("-inf"), -1
        while r > 0:
            if best[r] > top:
                top, j = best[r], arg[r]
            r -= r & -r
        gain = top - here[i]
        if j >= 0 and gain > 0:
            score[i], back[i] = K + gain, j
        else:
            score[i] = K
        waiting.append(i)
    used, chains = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            line = np.array(path[::-1])
            gaps = np.flatnonzero((np.diff(at[line]) > LONGEST_GAP) | (np.diff(other[line]) > LONGEST_GAP))
            chains += np.split(line, gaps + 1)
    return chains


def chains(found: DataFrame) -> DataFrame:
    """(doc, other, at, other_at, extent): the seeds of each chain, as arrays, and the longest extent of them.

    Chains have two seeds or more, as any run of K + 2 * WINDOW - 1 common
    words has, or one that is long, a pair or stands for a long repetition.

    A pair's matches are no more than one document's seeds. Rows are dealt by
    document and read in order, one pair at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: np.ndarray | None = None
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            rows = rows if kept is None else np.concatenate([kept, rows], axis=1)
            change = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            last = int(change[-1]) if len(change) else 0
            kept = rows[:, last:]
            yield _chained(rows[:, :last])
        if kept is not None:
            yield _chained(kept)

    names = "doc", "other", "at", "other_at", "extent"
    dealt = found.repartition("doc").sortWithinPartitions(*names)
    return dealt.select(*names).mapInArrow(run, "doc long, other long, at array<int>, other_at array<int>, extent int")


def _chained(rows: np.ndarray) -> pa.RecordBatch:
    edges = np.concatenate(([0], np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1, [rows.shape[1]]))
    out: tuple[list, list, list, list, list] = [], [], [], [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a < 2 and rows[4, a:b].max(initial=0) <= K:
            continue
        own = rows[:, a:b]
        # of seeds that share both places, the one of the longest extent (rows are in order)
        own = own[:, np.append((own[2, 1:] != own[2, :-1]) | (own[3, 1:] != own[3, :-1]), True)]
        doc, other, at, other_at, extent = own
        for line in chain(at, other_at):
            if len(line) >= 2 or extent[line[0]] > K:
                for column, value in zip(out, (int(doc[0]), int(other[0]), at[line], other_at[line], int(extent[line].max())), strict=True):
                    column.append(value)
    ints, kinds = pa.list_(pa.int32()), (pa.int64(), pa.int64(), None, None, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k or ints) for c, k in zip(out, kinds, strict=True)], names=["doc", "other", "at", "other_at", "extent"])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        new = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def _extend(mine: list[int], theirs: list[int]) -> list[tuple[int, int, int]]:
    """Runs (place, other place, length) of equal words that go on from the begin of two texts across edits.

    Greedy X-drop: after d edits each diagonal is followed as far as it
    reaches; an equal word gains one and an edit costs one. Paths more than
    ``DROP`` below the best score end, and the runs up to the best are returned.
    """
    ahead, best, end, edits = {0: (0, 0, None)}, 0.0, None, 0  # diagonal: (place, place where its run begins, the run before)
    while ahead:
        reached = {}
        for k, (i, start, before) in ahead.items():
            while i < len(mine) and i + k < len(theirs) and mine[i] == theirs[i + k]:
                i += 1
            path = (start, start + k, i - start, before) if i > start else before
            score = i + k / 2 - 2 * edits
            if score > best:
                best, end = score, path
            if score >= best - DROP:
                reached[k] = i, path
        edits += 1
        ahead = {}
        for k, (i, path) in reached.items():
            for step, diagonal in ((1, k), (0, k + 1), (1, k - 1)):
                at = i + step
                if at <= len(mine) and 0 <= at + diagonal <= len(theirs) and at > ahead.get(diagonal, (-1,))[0]:
                    ahead[diagonal] = at, at, path
    runs = []
    while end is not None:
        runs.append(end[:3])
        end = end[3]
    return runs[::-1]


def align(mine: np.ndarray, theirs: np.ndarray, at: np.ndarray, other: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(start, stop, other start, other stop, matches) of the similar parts along a chain of seeds."""
    exact: list[list[int]] = []  # [start, stop, other start] of runs of equal words, in order
    for p, q in zip(at.tolist(), other.tolist(), strict=True):
        if exact and p < exact[-1][1]:
            if p - exact[-1][0] == q - exact[-1][2]:
                continue  # inside the run before it
        back = min(p, q, REACH if not exact else max(REACH, p - exact[-1][0]))
        back = int(np.argmin(np.append(mine[p - back:p][::-1] == theirs[q - back:q][::-1], False)))
        while exact and p - back <= exact[-1][0]:
            exact.pop()  # this run holds the words of the one before: of a word's repeats, another one was met first
        if exact:
            low, low_other = exact[-1][1], exact[-1][1] - exact[-1][0] + exact[-1][2]
            shift = max(0, low - p, low_other - q)
            p, q = p + shift, q + shift
            back = 0 if shift else min(back, p - low, q - low_other)
        front = min(len(mine) - p, len(theirs) - q)
        if front <= 0:
            continue
        front_same = mine[p:p + front] == theirs[q:q + front]
        front = int(np.argmin(np.append(front_same, False)))
        if front:
            exact.append([p - back, p + front, q - back])
    if exact:
        start, _, other = exact[0]
        runs = _extend(mine[max(0, start - REACH):start][::-1].tolist(), theirs[max(0, other - REACH):other][::-1].tolist())
        exact = [[start - i - n, start - i, other - j - n] for i, j, n in reversed(runs)] + exact
        stop, other = exact[-1][1], exact[-1][1] - exact[-1][0] + exact[-1][2]
        exact += [[stop + i, stop + i + n, other + j] for i, j, n in _extend(mine[stop:stop + REACH].tolist(), theirs[other:other + REACH].tolist())]
    found: list[tuple[int, int, int, int, int]] = []

    between = [_common(mine[a[1]:b[0]], theirs[a[1] - a[0] + a[2]:b[2]]) for a, b in zip(exact[:-1], exact[1:], strict=True)]
    waiting = [(exact, between)] if exact else []
    while waiting:
        runs, gaps = waiting.pop()
        start, stop = runs[0][0], runs[-1][1]
        other_start, other_stop = runs[0][2], runs[-1][1] - runs[-1][0] + runs[-1][2]
        hit = sum(r[1] - r[0] for r in runs) + sum(gaps)
        if stop - start < LEAST_PART:
            continue
        if hit >= SIMILARITY * max(stop - start, other_stop - other_start):
            found.append((start, stop, other_start, other_stop, hit))
            continue
        lost = [max(y[0] - x[1], y[2] - (x[1] - x[0] + x[2])) - g for x, y, g in zip(runs[:-1], runs[1:], gaps, strict=True)]
        worst = int(np.argmax(lost))
        waiting += [(runs[:worst + 1], gaps[:worst]), (runs[worst + 1:], gaps[worst + 1:])]
    return found


def parts(linked: DataFrame, words: DataFrame) -> DataFrame:
    """(doc, start, stop, other, other_start, other_stop, matches): aligned parts of each chain (see ``chains``, ``blocks``)."""
    first = lambda c: F.greatest(F.element_at(c, 1) - REACH, F.lit(0))
    reach = lambda c: F.sequence(F.floor(first(c) / BLOCK).cast("int"), F.floor((F.element_at(c, -1) + F.col("extent") + REACH) / BLOCK).cast("int"))
    name = F.struct("doc", "other", F.element_at("at", 1).alias("begin"), F.element_at("other_at", 1).alias("other_begin"))
    asked = linked.select(name.alias("chain"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("doc").alias("doc"), reach("at").alias("blocks"), F.col("at").alias("at"), F.col("other_at").alias("other_at")),
        F.struct(F.lit(1).alias("side"), F.col("other").alias("doc"), reach("other_at").alias("blocks"), F.lit(None).alias("at"), F.lit(None).alias("other_at")))).alias("x"))
    asked = asked.select("chain", "x.side", "x.doc", F.posexplode("x.blocks").alias("n", "block"), "x.at", "x.other_at") \
        .select("chain", "side", "doc", "block", F.when(F.col("n") == 0, F.col("at")).alias("at"), F.when(F.col("n") == 0, F.col("other_at")).alias("other_at"))
    got = asked.join(words, ["doc", "block"]).groupBy("chain").agg(
        F.collect_list(F.struct("side", "block", "words")).alias("blocks"), F.max("at").alias("at"), F.max("other_at").alias("other_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                pieces: tuple[list, list] = ([], [])
                for x in batch.column("blocks")[i].as_py():
                    pieces[x["side"]].append((x["block"], x["words"]))
                text, origin = [], []
                for side in pieces:
                    side.sort(key=lambda x: x[0])
                    origin.append(side[0][0] * BLOCK)
                    text.append(np.frombuffer(b"".join(x[1] for x in side), dtype="<u4"))
                at = batch.column("at")[i].values.to_numpy() - origin[0]
                other = batch.column("other_at")[i].values.to_numpy() - origin[1]
                for start, stop, other_start, other_stop, hit in align(text[0], text[1], at, other):
                    for column, value in zip(out, (batch.column("doc")[i].as_py(), start + origin[0], stop + origin[0], batch.column("other")[i].as_py(),
                                                   other_start + origin[1], other_stop + origin[1], hit), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "start", "stop", "other", "other_start", "other_stop", "matches"])

    return got.select("chain.doc", "chain.other", "blocks", "at", "other_at") \
        .mapInArrow(run, "doc long, start long, stop long, other long, other_start long, other_stop long, matches long")


def repeated(docs: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """(handle, start, stop, similarity, others): passages of a document that occur in earlier ones (see ``with_handles``).

    start and stop are word numbers (stop exclusive), others the handles of the
    documents where the passage's parts were first seen, in order. Frequent
    lines in a new order are no passage: parts from more than ``most_sources``
    documents count only if one of these holds ``LEAST_WORDS`` words of them.
    """
    found = parts(cut(chains(matches(seeds(docs), frequent(docs))), "chains"), blocks(docs))
    order = W.partitionBy("doc").orderBy("start", "stop", "other")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce((F.col("start") > reached + TOUCH).cast("int"), F.lit(1))) \
        .withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    by_source = islands.groupBy("doc", "island", "other").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(F.col("stop") - F.col("start")).alias("words"), F.sum("matches").alias("matches"),
        F.sum(F.greatest(F.col("stop") - F.col("start"), F.col("other_stop") - F.col("other_start"))).alias("compared"))
    return by_source.groupBy("doc", "island").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), (F.sum("matches") / F.sum("compared")).alias("similarity"),
        F.array_sort(F.collect_list("other")).alias("others"), F.max("words").alias("from_one")) \
        .filter((F.col("stop") - F.col("start") >= LEAST_WORDS) & ((F.size("others") <= most_sources) | (F.col("from_one") >= LEAST_WORDS))) \
        .select(F.col("doc").alias("handle"), "start", "stop", "similarity", "others")


def passages(docs: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """One row for each repeated passage: doc_id, start_word, n_words, similarity, sources.

    ``docs`` needs doc_id and text; other columns are ignored. A passage is
    reported for each document but the first that holds it; ``sources`` lists,
    in order, the doc_ids where its parts were first seen. Documents come in
    order of doc_id; rows with equal doc_id and text are one document, rows
    with equal doc_id and other texts are different ones. Rows without doc_id
    and texts of fewer than 50 words have no passages; so have empty tables.
    ``most_sources``: see ``repeated``.
    """
    own = with_handles(docs.select("doc_id", "text"))
    found = repeated(own, most_sources)
    ids = own.filter("__handle IS NOT NULL").select(F.col("__handle").alias("handle"), "doc_id").distinct()
    named = found.select("handle", "start", "stop", "similarity", F.explode("others").alias("other")) \
        .join(ids.withColumnRenamed("handle", "other").withColumnRenamed("doc_id", "source"), "other") \
        .groupBy("handle", "start", "stop", "similarity").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return named.join(ids, "handle").select("doc_id", F.col("start").alias("start_word"), (F.col("stop") - F.col("start")).alias("n_words"), "similarity", "sources")


def without_repeats(docs: DataFrame, most_sources: int = MOST_SOURCES) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (and n_chars, if there, counted anew).

    The first document keeps a passage. A document that has no word left is
    dropped; texts without repeated passages stay as they are, byte for byte.
    ``most_sources``: see ``repeated``.
    """
    own = with_handles(docs)
    spans = repeated(own, most_sources).groupBy(F.col("handle").alias("__handle")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))

    @F.arrow_udf("string")
    def remove(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for row, _, split in T.chunks(texts):
            for d in range(split.n):
                wanted = found[row + d].as_py()
                if not wanted:
                    continue
                low, high, first = split.offsets[d], split.offsets[d + 1], split.first[d]
                kept, at = [], low
                for span in wanted:
                    kept.append(split.data[at:split.start[first + span["start"]]].tobytes())
                    last = first + span["stop"]
                    at = split.start[last] if last < split.first[d + 1] else high
                kept.append(split.data[at:high].tobytes())
                left = b"".join(kept)
                out[row + d] = left.decode() if T.WORD_BYTE[np.frombuffer(left, dtype=np.uint8)].any() else None
        return pa.array(out, type=pa.string())

    cutting = own.join(spans, "__handle", "left")
    changed = cutting.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(remove("text", "__spans"))) \
        .filter("__spans IS NULL OR text IS NOT NULL")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed = changed.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])

"""Periodic runs of words by multi-scale minimizers (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart
are the same) of at least ``max(LEAST_WORDS, 2 * q)`` words that no neighbour
extends. Inside a run, what a window of words keeps as its minimum it keeps
again q words further on.

Periods below ``SCANNED`` are found directly: the text is compared with itself
shifted by each of these lags. Longer ones go by scale. At scale s the periods
are 2**s to 2**(s+1) - 1, grams have k = 2**(s-1) words and windows k grams,
so a window spans 2**s - 1 words: the first period of a run holds a whole
window, its copy one period later lies in the run too, and both keep the same
gram. Pairs of equal minima that are 2**s to 2**(s+1) - 1 words apart are the
seeds, and each is extended word by word to both sides, so a hash never
decides a result.

Work stays near n log n for every text. Equal grams less than k / 2 apart
overlap and repeat themselves with a short period d: such occurrences are one
cluster in one stretch of period d, and other occurrences of the gram are more
than k / 2 away. Two clusters that lie in stretches A and B are not compared
place by place. A run that links them either begins where both begin, or ends
where both end, or lies in A and B alone, which then touch; the first two give
one lag each, and in the last case each lag tried is a run by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as T

LEAST_WORDS = 12
#: Periods below this are found by comparing the text with itself at each lag; a power of two.
SCANNED = 32

RUNS = "array<struct<start:int,length:int,period:int>>"


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(words as numbers, first word of each text): equal words have equal numbers, and each text is followed by a number of its own."""
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    out = np.empty(first[-1], dtype=np.int64)
    known: dict[bytes, int] = {}
    number = count()
    for text, at in zip(texts, first.tolist()):
        out[at:at + len(text)] = np.fromiter(map(known.setdefault, text, number), dtype=np.int64, count=len(text))
    out[first[1:] - 1] = -1 - np.arange(len(texts))
    return out, first


def _back(a: np.ndarray, i: int, q: int, low: int) -> int:
    """The smallest j >= low such that a[j:i] equals the words q further on."""
    step = 32
    while i > low:
        j = max(low, i - step)
        differ = np.flatnonzero(a[j:i] != a[j + q:i + q])
        if len(differ):
            return j + int(differ[-1]) + 1
        i, step = j, 2 * step
    return i


def _ahead(a: np.ndarray, i: int, q: int) -> int:
    """The largest j such that a[i:j] equals the words q further on."""
    step, high = 32, len(a) - q
    while i < high:
        j = min(high, i + step)
        differ = np.flatnonzero(a[i:j] != a[i + q:j + q])
        if len(differ):
            return i + int(differ[0])
        i, step = j, 2 * step
    return max(i, 0)


def _scan(a: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, q) of all stretches of period q, by comparing the whole array with itself."""
    same = np.flatnonzero(a[:-q] == a[q:])
    need = max(q, least - q)
    if len(same) < need:
        return []
    breaks = np.flatnonzero(np.diff(same) != 1)
    start, stop = same[np.append(0, breaks + 1)], same[np.append(breaks, len(same) - 1)] + 1
    long = np.flatnonzero(stop - start >= need)
    return [(int(start[i]), int(stop[i] - start[i]) + q, q) for i in long]


def _smallest_period(block: np.ndarray) -> int:
    """The smallest divisor d of the block's length such that the block is a repetition of its first d words."""
    d, n, p = len(block), len(block), 2
    while p <= n:
        if n % p:
            p += 1
            continue
        n //= p
        if np.array_equal(block[d // p:d], block[:d - d // p]):
            d //= p
    return d


def _minima(a: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams that are the leftmost minimum of a window of k of them."""
    up, down = T.powers(len(a))
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=sums[1:])
    grams = T.mix((sums[k:] - sums[:-k]) * down[:len(a) - k + 1])
    at = T.window_minima(grams, k)
    if len(at):
        at = at[np.append(True, at[1:] != at[:-1])]
    return at, grams[at]


def _lags(a: np.ndarray, first: np.ndarray, low: int) -> set[tuple[int, int]]:
    """Seeds (place, lag) for the periods low to 2 * low - 1: a run of such a period has a seed among its words but the last period."""
    k = low // 2
    if len(a) < 2 * low:
        return set()
    at, grams = _minima(a, T.mix(a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), k)
    order = np.argsort(grams, kind="stable")
    at, grams = at[order], grams[order]
    again = np.append(False, grams[1:] == grams[:-1]) | np.append(grams[1:] == grams[:-1], False)
    at, grams = at[again], grams[again]
    if not len(at):
        return set()
    # clusters: equal grams that overlap by half or more, in one stretch of a short period
    apart = np.append(True, (grams[1:] != grams[:-1]) | (np.diff(at) > k // 2))
    begin = np.flatnonzero(apart)
    head, tail = at[begin], at[np.append(begin[1:], len(at)) - 1]
    gram = grams[begin]
    single = head == tail
    seeds: set[tuple[int, int]] = set()
    bounds: dict[int, tuple[int, int, int]] = {}

    def stretch(i: int, d: int) -> tuple[int, int, int]:
        """(begin, end, period) of the stretch around cluster i, whose gram has period d."""
        if i not in bounds:
            x = int(head[i])
            d = _smallest_period(a[x:x + d])
            bounds[i] = _back(a, x, d, 0), _ahead(a, x, d) + d, d
        return bounds[i]

    for step in range(1, len(head)):
        i = np.flatnonzero((gram[step:] == gram[:-step]) & (head[step:] - tail[:-step] < 2 * low))
        if not len(i):
            break
        j = i + step
        plain = single[i] & single[j]
        lag = head[j[plain]] - head[i[plain]]
        fits = (lag >= low) & (lag < 2 * low)
        place, lag = head[i[plain]][fits], lag[fits]
        # seeds of one lag that overlap lie in one stretch: the first is enough
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        new = np.append(True, (np.diff(lag) != 0) | (np.diff(place) > k))[:len(place)]
        seeds.update(zip(place[new].tolist(), lag[new].tolist()))
        for x, y in zip(i[~plain].tolist(), j[~plain].tolist()):
            if tail[y] - head[x] < low:
                continue
            multiple = x if not single[x] else y
            inside = begin[multiple]
            d = int(at[inside + 1] - at[inside])
            (a0, a1, d), (b0, b1, _) = stretch(x, d), stretch(y, d)
            if a0 == b0:
                continue
            for place, lag in ((a0, b0 - a0), (a1 - 1, b1 - a1)):
                if low <= lag < 2 * low:
                    seeds.add((place, lag))
            if b0 <= a1:
                rest = int(head[y] - head[x]) % d
                for lag in range(low + (rest - low) % d, min(2 * low, a1 - a0 + 1, b1 - b0 + 1), d):
                    if min(a1, b1 - lag) - max(a0, b0 - lag) >= lag:
                        seeds.add((max(a0, b0 - lag), lag))
    return seeds


def find(a: np.ndarray, first: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in texts that lie one after another (see ``numbered``), by start, then period."""
    counts = np.diff(first) - 1
    found: dict[tuple[int, int], int] = {}  # a stretch has its smallest period: it is found with each multiple that fits, too

    def add(start: int, length: int, q: int) -> None:
        if length >= max(least, 2 * q) and found.get((start, length), q) >= q:
            found[start, length] = q

    for q in range(1, min(SCANNED, len(a))):
        for run in _scan(a, q, least):
            add(*run)
    low = SCANNED
    while len(counts) and 2 * low <= counts.max():
        # texts too short for a run of this scale are left out; the others keep the number that ends them
        long = np.flatnonzero(counts >= 2 * low)
        places = np.repeat(first[long] - np.cumsum(np.append(0, counts[long][:-1] + 1)), counts[long] + 1) + np.arange((counts[long] + 1).sum())
        own = a[places] if len(long) < len(counts) else a
        done: dict[int, int] = {}
        for place, q in sorted(_lags(own, first, low)):
            if done.get(q, -1) > place or place + q >= len(own) or own[place] != own[place + q]:
                continue
            start, stop = _back(own, place, q, 0), _ahead(own, place, q)
            done[q] = stop
            add(int(places[start]), stop - start + q, q)
        low *= 2
    rows = np.array([(start, length, q) for (start, length), q in found.items()], dtype=np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def collapse(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with a struct ``__periodic`` of n_words, runs (start, length, period) and collapsed text.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text and numbered from 0. ``collapsed`` has the words joined by one space, less
    those that a run contains after its first period. Each row is judged by itself, so repeated rows and ids and ties need no rule; runs
    come by start, then period. Null, empty and blank texts have no words, no runs and an empty collapsed text; an empty table gives an
    empty result. Other columns, of whatever name, are passed on. Nothing is shuffled; memory follows the longest text.
    """

    @F.arrow_udf(f"n_words long, runs {RUNS}, collapsed string")
    def judge(column: pa.Array) -> pa.Array:
        n_words, ends, lists, out = [], [0], [[], [], []], []
        data, offsets = T.buffers(column)
        row = 0
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + T.CHUNK_BYTES, side="right")) - 1)
            texts = [data[offsets[i]:offsets[i + 1]].tobytes().split() for i in range(row, stop)]
            a, first = numbered(texts)
            start, length, period = find(a, first, least_words)
            owner = np.searchsorted(first, start, side="right") - 1
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            for values, own in zip(lists, (start - first[owner], length, period)):
                values.append(own)
            ends += (edges[1:] + ends[-1]).tolist()
            drop = np.zeros(len(a) + 1, dtype=np.int32)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            keep = np.cumsum(drop[:-1]) == 0
            for d, text in enumerate(texts):
                n_words.append(len(text))
                if edges[d] < edges[d + 1]:
                    text = [text[i] for i in np.flatnonzero(keep[first[d]:first[d] + len(text)]).tolist()]
                out.append(b" ".join(text))
            row = stop
        flat = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int32()) for v in lists]
        runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(flat, ["start", "length", "period"]))
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), runs, pa.array(out, pa.binary()).cast(pa.string())],
                                          ["n_words", "runs", "collapsed"])

    return docs.withColumn("__periodic", judge(F.col(f"`{text}`").cast("string")))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` with periodic texts in about every tenth row, chosen by the crc32 of its doc_id (the query's contract fixes the rule).

    Such a text keeps its first words, and the rest repeats the words that follow them. Rows without doc_id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def rewritten(w):
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    chosen = docs.select("doc_id", "text", ((h % 10) == 0).alias("chosen"))
    listed = chosen.withColumn("w", F.when(F.col("chosen"), words))
    return listed.select("doc_id", F.when(F.size("w") > 0, rewritten(F.col("w"))).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``docs`` (doc_id, text): counts, the greatest run, digests of the runs and of the collapsed text."""
    judged = collapse(docs.select("doc_id", "text"))
    runs = F.col("__periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform(runs, lambda r: F.concat_ws("", F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    long = lambda c: c.cast("long")
    return judged.select(
        "doc_id", long(F.size(runs)).alias("n_runs"), long(-best["col2"]).alias("start"), long(best["length"]).alias("length"),
        long(-best["col3"]).alias("period"), F.floor(1000 * long(best["length"]) / long(-best["col3"])).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("__periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"), F.col("__periodic.n_words").alias("n_words"))

"""Periodic runs against a plain search over all lags and places."""

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import periodic
from tessera.llm.queries import queries
from tests.llm.helpers import SF001, collected, frame, odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, least=periodic.LEAST_WORDS):
    """(start, length, period) of all runs, by comparing the text with itself at every lag."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept(w, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in drop]


def rewritten(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_row(doc_id, text):
    w = rewritten(doc_id, text)
    runs = plain_runs(w)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept(w, runs))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def a_text(pick):
    """Words of few kinds, one of several shapes that hold nested, adjacent and overlapping repetitions."""
    n, few = pick.randint(0, 600), pick.choice([1, 2, 3, 50])
    shape = pick.randrange(6)
    if shape == 0:
        return [pick.randrange(few) for _ in range(n)]
    if shape == 1:
        part = [pick.randrange(few) for _ in range(pick.randint(1, 250))]
        return [pick.randrange(few) for _ in range(pick.randint(0, 50))] + (part * 20)[:n] + [pick.randrange(few) for _ in range(9)]
    if shape == 2:
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[pick.randint(0, 20):n]
    if shape == 3:
        part = [0] * pick.randint(1, 180) + [1]
        return (part * 5)[pick.randint(0, 50):][:n]
    if shape == 4:
        part = ([0, 1] * 60)[:pick.randint(20, 110)]
        return (part + [0] + part[::-1] + part + part + [1] + part + [0] + part)[:n]
    out, part = [], [pick.randrange(2) for _ in range(pick.randint(1, 12))]
    while len(out) < n:
        out += (part * 30)[:pick.randint(1, 150)] + [pick.randrange(3) for _ in range(pick.randint(0, 2))]
    return out * pick.randint(1, 3)


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_all_scales(seed):
    pick = random.Random(seed)
    for _ in range(30):
        texts = [[b"%d" % x for x in a_text(pick)] for _ in range(pick.randint(1, 3))]
        a, first = periodic.numbered(texts)
        got = sorted(zip(*(v.tolist() for v in periodic.find(a, first)), strict=True))
        assert got == sorted((s + int(first[d]), n, q) for d, w in enumerate(texts) for s, n, q in plain_runs(w))


def test_other_least_lengths():
    w = [b"%d" % x for x in [1, 1, 1, 2, 3, 2, 3, 2, 4, 5, 6, 4, 5, 6]]
    for least in (2, 3, 5, 6):
        a, first = periodic.numbered([w])
        assert sorted(zip(*(v.tolist() for v in periodic.find(a, first, least)), strict=True)) == sorted(plain_runs(w, least))


def test_long_repetitive_texts_end():
    fib = [0], [0, 1]
    while len(fib[1]) < 60_000:
        fib = fib[1], fib[1] + fib[0]
    for w, n in (([0] * 100_000, 1), (([0] * 500 + [1]) * 150, 151), (list(range(30_000)) * 3, 1), (list(range(100_000)), 0), (fib[1], None)):
        a, first = periodic.numbered([[b"%d" % x for x in w]])
        assert n is None or len(periodic.find(a, first)[0]) == n


def odd():
    pick = random.Random(9)
    rows = odd_rows() + [(200 + i, " \n".join(str(x) for x in a_text(pick)), "en", "s", 1) for i in range(60)]
    return rows + [(7, "A a " * 30, "en", "s", 1), (7, "A a " * 30, "en", "s", 1), (7, "x y\x1c " * 40, None, None, 1), (8, "la " * 20_000 + "mi", None, None, 1)]


def test_odd_rows_and_other_columns(spark):
    got = collected(periodic.digest(periodic.with_planted_runs(frame(spark, odd()))), *COLUMNS)
    long = (5, 8)  # too long for the plain search
    assert len(got) == len(odd())
    assert sorted((r for r in got if r[0] not in long), key=str) == sorted((plain_row(r[0], r[1]) for r in odd() if r[0] not in long), key=str)
    assert [r[1:6] for r in got if r[0] == 8] == [(1, 0, 20_000, 1, 20_000_000)]


def test_planted_texts(spark):
    rows = [(i, " ".join(str((i * j * j) % 97) for j in range(i % 90)), "en", "s", 1) for i in range(150)]
    got = collected(periodic.digest(periodic.with_planted_runs(frame(spark, rows, extra=False))), *COLUMNS)
    assert sorted(got) == sorted(plain_row(r[0], r[1]) for r in rows)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5


def test_spans_and_text(spark):
    rows = [(1, "x " + "p q r " * 5 + "y", "en", "s", 1)]
    found = periodic.collapse(frame(spark, rows)).first()
    assert found["__periodic"]["runs"] == [(1, 15, 3)] and found["__periodic"]["collapsed"] == "x p q r y" and found["__periodic"]["n_words"] == 17
    assert found["hash"] == "x" and found["text"] == rows[0][1]


def test_empty_table(spark):
    assert periodic.digest(periodic.with_planted_runs(frame(spark, []))).collect() == []


def test_query_over_whole_table(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: r for r in collected(queries()["op11_periodic_runs"](spark, SF001), *COLUMNS)}
    assert len(got) == len(rows)
    for r in rows:
        if len(r["text"] or "") < 9_000:
            assert got[r["doc_id"]] == plain_row(r["doc_id"], r["text"])

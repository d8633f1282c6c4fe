"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tests.llm.helpers import LOWER, SF001, collected, frame, odd_rows
from tests.oracle_harness import compare, duck

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, max_words=3, least=10, share=50, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, max_words + 1):
                counts.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    gone, found = set(), {}
    for (lang, *w), a in counts.items():
        if len(w) < 2 or a < least:
            continue
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= share * counts[lang, *w[i:i + k]]:
                    gone.add((lang, *w[i:i + k]))
        cuts = [(1000000 * a * a // (counts[lang, *w[:k]] * counts[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang, *w] = (score, a, counts[lang, *w[:k]], counts[lang, *w[k:]])
    by: dict = {}
    for (lang, *w), (score, a, left, right) in found.items():
        if (lang, *w) not in gone:
            by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, them in by.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(them)[:top], 1))


def few_words(seed, n, kinds, words=40):
    pick = random.Random(seed)
    names = ["la", "mi", "So", "fa", "é", "日本", "x-y", "(z)"][:kinds]
    return [(i, "".join(pick.choice(names) + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for _ in range(pick.randint(0, words))),
             pick.choice(["en", "en", "de", None]), "s", 1) for i in range(n)]


@pytest.mark.parametrize(("seed", "kinds", "partitions"), [(1, 3, 4), (2, 8, 11), (3, 2, 23)])
def test_scores_ranks_and_dropped_phrases(spark, seed, kinds, partitions):
    rows = few_words(seed, 150, kinds) + [(900, "la mi so " * 40, "en", "s", 1)] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))  # more ranges than words: extensions cross their borders
    try:
        assert sorted(collected(collocations.ranked(frame(spark, rows)), *COLUMNS)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_four_words_and_other_limits(spark):
    rows = few_words(5, 120, 4)
    got = collected(collocations.ranked(frame(spark, rows), top=7, max_words=4, least_count=4, least_share=70), *COLUMNS)
    # phrases are dropped for those of one word more; what two more words contain, one more does at least as often
    assert sorted(got) == plain(rows, 4, 4, 70, 7)


def test_odd_rows_and_extra_columns(spark):
    rows = odd_rows() * 11 + [(60, "Ünï  k k\tÜnï k k", None, None, 1)] * 10 + [(61, "Ünï k k", "und", None, 1)]
    got = collected(collocations.ranked(frame(spark, rows)), *COLUMNS)
    assert sorted(got) == plain(rows)


def test_words_that_fill_a_task_more_than_once(spark, monkeypatch):
    rows = few_words(7, 200, 6)
    monkeypatch.setattr(collocations, "COUNTED_WORDS", 64)
    assert sorted(collected(collocations.ranked(frame(spark, rows)), *COLUMNS)) == plain(rows)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = few_words(8, 100, 8)
    monkeypatch.setattr(collocations, "FILTER_BITS", 1 << 15)
    assert sorted(collected(collocations.ranked(frame(spark, rows)), *COLUMNS)) == plain(rows)


def test_wide_numbers_of_words():
    tokens = b" ".join(b"w%d" % (i * 7919 % 5000) for i in range(20_000))
    narrow = collocations._count("en", tokens, 3, None)
    names = [f"w{k}" for k in (1, 2, 3)]
    got = Counter({tuple(narrow.column(n)[i].as_py() for n in names): narrow.column("f")[i].as_py() for i in range(narrow.num_rows)})
    words = tokens.decode().split()
    assert got == Counter(zip(words, words[1:], words[2:], strict=False))


def test_empty_tables(spark):
    assert collocations.ranked(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None, None, None), (2, "!?", "en", "s", 1)])).collect() == []


def test_query_equals_its_sql(spark):
    assert compare(queries()["op12_collocations"](spark, SF001), duck(SF001), oracle_sql()["op12_collocations"])["status"] == "exact"

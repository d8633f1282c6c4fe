"""Repeated passages: chaining against all chains, alignment, and planted passages."""

import itertools
import random

import numpy as np

from tessera.llm import passages
from tests.llm.helpers import SF01, frame, odd_rows, prose, words


def best_score(at, other):
    """Score of the best chain by trying every predecessor."""
    score = []
    for i in range(len(at)):
        gains = [score[j] - passages.GAP_COST / 2 * (at[i] - at[j] + other[i] - other[j]) for j in range(i) if at[j] < at[i] and other[j] < other[i]]
        score.append(passages.K + max(0, *gains, 0))
    return max(score)


def chain_score(at, other, line):
    total = passages.K
    for a, b in zip(line[:-1], line[1:]):
        assert at[a] < at[b] and other[a] < other[b]
        total += passages.K - passages.GAP_COST / 2 * (at[b] - at[a] + other[b] - other[a])
    return total


def test_fenwick_chains_reach_the_best_score(monkeypatch):
    monkeypatch.setattr(passages, "LONGEST_GAP", 10 ** 9)
    pick = random.Random(3)
    for _ in range(60):
        n = pick.randint(1, 25)
        at = np.array(sorted(pick.sample(range(80), n)))
        other = np.array([pick.randint(0, 60) for _ in range(n)])
        lines = passages.chain(at, other)
        assert sorted(itertools.chain(*lines)) == list(range(n))
        assert abs(max(chain_score(at, other, line) for line in lines) - best_score(at, other)) < 1e-9


def test_chains_end_at_long_gaps():
    at = np.array([0, 10, 20, 200, 210])
    assert [line.tolist() for line in passages.chain(at, at.copy())] == [[0, 1, 2], [3, 4]]


def test_alignment_counts_words_across_an_edit():
    mine = np.arange(100, 160)
    theirs = np.concatenate([np.arange(100, 130), [7, 8], np.arange(131, 160)])
    (start, stop, other_start, other_stop, hit), = passages.align(mine, theirs, np.array([2, 40]), np.array([2, 41]))
    assert (start, stop, other_start, other_stop, hit) == (0, 60, 0, 61, 59)


def test_alignment_splits_what_is_not_similar():
    mine = np.concatenate([np.arange(30), np.arange(1000, 1030), np.arange(30, 60)])
    theirs = np.concatenate([np.arange(30), np.arange(2000, 2030), np.arange(30, 60)])
    found = passages.align(mine, theirs, np.array([3, 65]), np.array([3, 65]))
    assert sorted(f[:2] for f in found) == [(0, 30), (60, 90)]


def planted():
    passage = prose(500, 60).split()
    edited = passage[:20] + ["edit"] + passage[21:40] + passage[41:]
    put = lambda seed, middle: " ".join(prose(seed, 70).split()[:35] + middle + prose(seed + 1, 35).split())
    rows = [(10, put(1, passage)), (11, put(11, edited)), (12, prose(99, 200)), (13, put(31, passage)), (14, put(41, passage[:40])),
            (15, put(51, passage[:30])), (16, put(61, passage[30:] + prose(777, 40).split())), (17, "Zu: " + put(1, passage))]
    return passage, [(i, t, "en", "s", len(t)) for i, t in rows]


def test_planted_passages_are_found_whole_and_clean_documents_left_alone(spark):
    passage, rows = planted()
    got = {r["doc_id"]: r for r in passages.passages(frame(spark, rows + odd_rows()[:4])).collect()}
    assert set(got) == {11, 13, 17}
    text = {r[0]: words(r[1]) for r in rows}
    for i in (11, 13):
        own = text[i][got[i]["start_word"]:got[i]["start_word"] + got[i]["n_words"]]
        assert own[:5] == passage[:5] and own[-5:] == passage[-5:] and got[i]["sources"] == [10]
    assert got[13]["similarity"] == 1 and 0.9 < got[11]["similarity"] < 1
    assert got[17]["n_words"] == len(text[10]) and got[17]["start_word"] == 1


def test_parts_first_seen_in_two_documents_make_one_passage(spark):
    one, two = prose(901, 40), prose(902, 40)
    rows = [(1, prose(1, 30) + " " + one, "en", "s", 1), (2, two + " " + prose(2, 30), "en", "s", 1), (3, " ".join([prose(3, 20), one, two, prose(4, 20)]), "en", "s", 1)]
    got = passages.passages(frame(spark, rows)).collect()
    assert [(r["doc_id"], r["start_word"], r["n_words"], r["sources"]) for r in got] == [(3, 20, 80, [1, 2])]


def test_copies_link_to_the_first_and_ids_may_repeat_or_be_any(spark):
    t = prose(7, 90)
    rows = [(-5, t, "en", "s", 1), (1 << 60, t, "en", "s", 1), (3, t, "en", "s", 1), (3, t, "en", "s", 1), (3, prose(8, 70), "en", "s", 1), (9, prose(8, 70), "en", "s", 1)]
    got = {(r["doc_id"], r["n_words"], tuple(r["sources"])) for r in passages.passages(frame(spark, rows)).collect()}
    assert got == {(3, 90, (-5,)), (1 << 60, 90, (-5,)), (9, 70, (3,))}


def test_repetitions_of_a_word_or_phrase(spark):
    rows = [(1, prose(1, 40) + " so" * 60, "en", "s", 1), (2, "so " * 20 + prose(2, 40), "en", "s", 1), (3, prose(3, 40) + " so" * 400, "en", "s", 1),
            (4, prose(4, 10) + " so" * 330 + " " + prose(5, 10), "en", "s", 1), (5, "ba ke lo " * 40, "en", "s", 1), (6, "ba ke lo " * 30 + prose(6, 10), "en", "s", 1)]
    got = {r["doc_id"]: (r["start_word"], r["n_words"]) for r in passages.passages(frame(spark, rows)).collect()}
    assert set(got) == {3, 4, 6}
    assert got[3] == (40, 60) and got[4] == (10, 330) and got[6] == (0, 90)


def test_cutting_keeps_the_first_and_every_other_byte(spark):
    passage, rows = planted()
    docs = frame(spark, rows + odd_rows())
    kept = passages.without_repeats(docs)
    assert kept.columns == docs.columns
    got = {}
    for r in kept.collect():
        got.setdefault(r["doc_id"], []).append(r)
    before = {r[0]: r for r in rows}
    for i in (10, 12, 14, 15, 16):
        assert [tuple(r)[:5] for r in got[i]] == [before[i]]
    for i in (11, 13):
        left = got[i][0]["text"]
        assert words(left) == words(before[i][1])[:35] + words(before[i][1])[-35:] and got[i][0]["n_chars"] == len(left)
    assert got[17][0]["text"] == "Zu: "
    # odd rows: of the three copies one is left, the others are empty and go
    assert 3 in got and 4 not in got and len(got[None]) == 2 and {0, 1, 2, 5, 6} <= set(got)
    assert passages.without_repeats(frame(spark, [])).collect() == [] and passages.passages(frame(spark, [])).collect() == []


def test_exact_repeats_of_the_shared_table_are_covered(spark):
    """Every run of 60 words or more that an earlier document holds whole is reported."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet").filter("doc_id < 400")
    spans = {}
    for r in passages.passages(docs).collect():
        spans.setdefault(r["doc_id"], []).append((r["start_word"], r["start_word"] + r["n_words"]))
    first, n = {}, 60
    for r in docs.orderBy("doc_id").collect():
        w = words(r["text"])
        own = {}
        for i in range(len(w) - n + 1):
            gram = " ".join(w[i:i + n])
            if gram in first and len(set(w[i:i + n])) > 20:
                assert any(a <= i + 5 and i + n - 5 <= b for a, b in spans.get(r["doc_id"], [])), (r["doc_id"], i)
            own.setdefault(gram, r["doc_id"])
        for gram, i in own.items():
            first.setdefault(gram, i)


def test_alignment_goes_past_edits_near_its_ends():
    mine = np.arange(200, 300)
    theirs = mine.copy()
    theirs[[3, 9, 15, 84, 90, 96]] = np.arange(6)
    assert passages.align(mine, theirs, np.array([40, 50]), np.array([40, 50])) == [(0, 100, 0, 100, 94)]
    shorter = np.delete(theirs, [7, 88])
    assert passages.align(mine, shorter, np.array([40, 50]), np.array([39, 49])) == [(0, 100, 0, 98, 92)]


def edited_words(run, rate, seed):
    """``run`` with words replaced, left out or put in before others, in a share of ``rate`` of its places."""
    pick, out = random.Random(seed), []
    for w in run:
        kind = pick.choice(["other", "out", "before"]) if pick.random() < rate else "same"
        out += {"same": [w], "other": [f"e{pick.randrange(10 ** 6)}"], "out": [], "before": [f"e{pick.randrange(10 ** 6)}", w]}[kind]
    return out


def test_edits_at_any_place_leave_passages_whole(spark):
    for rate, least in ((0.05, 0.95), (0.1, 0.9), (0.2, 0.6)):
        rows, planted_at = [], {}
        for n in range(60):
            run = prose(2000 + n, 70).split()
            changed = edited_words(run, rate, n)
            rows.append((n, " ".join(prose(3000 + n, 40).split() + run + prose(4000 + n, 40).split()), "en", "s", 1))
            rows.append((100 + n, " ".join(prose(5000 + n, 30).split() + changed + prose(6000 + n, 30).split()), "en", "s", 1))
            planted_at[100 + n] = len(changed)
        whole = {r["doc_id"] for r in passages.passages(frame(spark, rows)).collect()
                 if r["n_words"] >= 0.9 * planted_at[r["doc_id"]] and r["sources"] == [r["doc_id"] - 100] and abs(r["start_word"] - 30) <= 7}
        assert len(whole) >= least * len(planted_at), rate


def test_passages_whose_every_seed_was_first_seen_elsewhere(spark):
    rows, planted_at = [], {}
    for n in range(20):
        run = prose(7000 + n, 70).split()
        changed = edited_words(run, 0.08, n)
        # an earlier document of its own for each k-gram of the second and of the third holder
        grams = {" ".join(own[i:i + passages.K]) for own in (run, changed) for i in range(len(own) - passages.K + 1)}
        rows += [(1000 * n + i, " ".join([prose(10 ** 6 + 1000 * n + i, 6), g, prose(2 * 10 ** 6 + 1000 * n + i, 6)]), "en", "s", 1) for i, g in enumerate(sorted(grams))]
        rows.append((10 ** 5 + 2 * n, " ".join([prose(8000 + n, 30), *run, prose(8100 + n, 30)]), "en", "s", 1))
        rows.append((10 ** 5 + 2 * n + 1, " ".join([prose(8200 + n, 30), *changed, prose(8300 + n, 30)]), "en", "s", 1))
        planted_at[10 ** 5 + 2 * n + 1] = len(changed)
    found = {r["doc_id"]: r for r in passages.passages(frame(spark, rows)).collect()}
    whole = [i for i, n in planted_at.items() if i in found and found[i]["n_words"] >= 0.9 * n and i - 1 in found[i]["sources"]]
    assert len(whole) >= 0.9 * len(planted_at)


def test_repeated_rows_of_more_than_a_block_are_one_document(spark):
    long = prose(9000, 700).split()
    rows = [(1, " ".join(long), "en", "s", 1)] * 3 + [(2, " ".join(prose(9001, 20).split() + long[100:640]), "en", "s", 1)] * 2 + [(3, " ".join(long), "en", "s", 1)]
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["similarity"], r["sources"]) for r in passages.passages(frame(spark, rows)).collect())
    assert got == [(2, 20, 540, 1.0, [1]), (3, 0, 700, 1.0, [1])]


def test_frequent_lines_in_a_new_order_are_no_passage(spark):
    lines = [prose(9100 + n, 25) for n in range(3)]
    rows = [(n, " ".join([prose(9200 + n, 30), line, prose(9300 + n, 30)]), "en", "s", 1) for n, line in enumerate(lines)]
    rows.append((9, " ".join([prose(9400, 30), lines[2], lines[0], lines[1], prose(9401, 30)]), "en", "s", 1))
    docs = frame(spark, rows)
    assert passages.passages(docs).collect() == []
    assert [r["text"] for r in passages.without_repeats(docs).orderBy("doc_id").collect()] == [r[1] for r in rows]
    assert [(r["doc_id"], r["n_words"], r["sources"]) for r in passages.passages(docs, most_sources=3).collect()] == [(9, 75, [0, 1, 2])]


def test_frequent_seeds_are_matched_the_same_when_spread(spark, monkeypatch):
    shared, other = prose(9500, 60), prose(9501, 70)
    rows = [(n, " ".join([prose(9600 + n, 20), shared if n % 3 else other, prose(9700 + n, 20)]), "en", "s", 1) for n in range(90)]
    docs = frame(spark, rows)
    own = passages.with_handles(docs)
    hot = passages.frequent(own)
    assert hot
    plain = lambda which: sorted(map(tuple, passages.matches(passages.seeds(own), which).collect()))
    assert plain(hot) == plain([]) == plain(hot[:3])
    got = passages.passages(docs).collect()
    assert {r["doc_id"] for r in got} == set(range(90)) - {0, 1} and all((1 if r["doc_id"] % 3 else 0) in r["sources"] for r in got)

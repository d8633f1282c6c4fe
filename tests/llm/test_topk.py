"""Exact top-k search against brute force."""

import math
import random
from collections import Counter

from tessera.llm import topk
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tests.llm.helpers import SF001
from tests.oracle_harness import compare, duck


def plain(rows, k, every):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in reversed(good) if i % every == 0}.items():
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def found(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_against_brute_force_with_many_blocks(spark):
    pick = random.Random(5)
    centre = [[pick.choice([-1, 1]) * 0.5 for _ in range(6)] for _ in range(4)]
    rows = [(i, [round((c + pick.gauss(0, 0.1)) * 64) / 64 for c in centre[i % 4]]) for i in range(300)]
    rows += [(300 + i, centre[0]) for i in range(120)]  # many copies, all ties
    rows += [(1000, None), (1001, []), (1002, [1.0, None, 2.0]), (1003, [float("nan")] * 6), (1004, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (1010, [0.25, 0.5])]
    got = found(topk.search(vectors(spark, rows), k=7, every=10, block=64, queries_block=16))
    assert got == plain(rows, 7, 10)


def answers(rows, k, every):
    """For each query row its answers, as a counted set."""
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    out = Counter()
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k]))
    return out


def test_every_query_row_answers_and_rows_repeat(spark):
    pick = random.Random(8)
    some = [[pick.randint(-8, 8) / 8 for _ in range(4)] for _ in range(12)]
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5])]
    assert Counter(map(tuple, topk.search(vectors(spark, rows)).collect())) == answers(rows, 10, 100)
    # ids and vectors repeat; one row is there more than k times, as a query and as a candidate
    rows = [(pick.randint(0, 40), pick.choice(some)) for _ in range(200)] + [(10, some[0])] * 15 + [(11, some[0])] * 15
    for k in (1, 3, 10):
        got = topk.search(vectors(spark, rows), k=k, every=10, block=32, queries_block=8)
        assert Counter(map(tuple, got.collect())) == answers(rows, k, 10), k


def test_copies_are_compared_once(spark):
    ints = topk.integer_vectors(vectors(spark, [(i, [0.5, 0.25]) for i in range(900)] + [(5, [0.5, 0.25])] * 50 + [(7, [1.0])])).repartition(6)
    kept = topk.candidates(ints, 3)
    assert sorted(r["vec_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and after both exchanges


def test_extra_columns_and_long_vectors(spark):
    pick = random.Random(3)
    rows = [(i, [pick.randint(-4, 4) / 4 for _ in range(3000)]) for i in range(0, 60)]
    table = vectors(spark, rows).selectExpr("vec_id", "embedding", "vec_id AS row", "'x' AS vector", "1 AS block", "2 AS n", "0.5D AS norm")
    assert found(topk.search(table, k=4, every=20, block=16, queries_block=2)) == plain(rows, 4, 20)


def test_few_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, -0.5]), (1, [0.5, 0.5]), (7, [-1.0, 0.0])]
    assert found(topk.search(vectors(spark, rows))) == {(0, 1, 1, 1024 * 512 - 512 * 512), (0, 2, 7, -1024 * 1024)}
    for empty in ([], [(3, [1.0])], [(0, None)]):
        assert found(topk.search(vectors(spark, empty))) == set()
    assert found(topk.search(vectors(spark, [(0, [1.0])]))) == set()


def test_large_components_stay_integers(spark):
    big = float(2 ** 20)
    rows = [(0, [big, 1.0]), (1, [big, 2.0]), (2, [big, 1.5])]
    assert found(topk.search(vectors(spark, rows))) == plain(rows, 10, 100)


def test_query_against_sql(spark):
    assert compare(queries()["op5_topk"](spark, SF001), duck(SF001), oracle_sql()["op5_topk"])["status"] == "exact"

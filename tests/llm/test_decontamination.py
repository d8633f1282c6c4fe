"""Decontamination against a plain search for every window."""

import hashlib
import random

from tessera.llm import decontamination
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tests.llm.helpers import SF001, frame, odd_rows, words
from tests.oracle_harness import compare, duck


def plain(text, items):
    w = words(text)
    hit, ids = set(), set()
    for item_id, item in items:
        v = words(item)
        n = min(len(v), 10)
        for j in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i:i + n] == v[j:j + n]:
                    hit.update(range(i, i + n))
                    ids.add(item_id)
    return len(w), len(hit), sorted(x for x in ids if x is not None)


def cases(seed):
    pick = random.Random(seed)
    few = ["la", "mi", "so"]
    items = [(i, " ".join(pick.choice(few) for _ in range(pick.randint(1, 14)))) for i in range(8, 14)]
    items += [(1, None), (2, ""), (3, "Quite ONE of a kind: eleven words stand here in a row"), (4, "nine words are a window of their own kind"),
              (3, "Quite ONE of a kind: eleven words stand here in a row"), (None, "la la la la la mi mi mi mi mi mi")]
    texts = [" ".join(pick.choice(few) for _ in range(n)) for n in (0, 1, 5, 9, 10, 11, 40, 90)]
    texts += ["then quite one of a kind eleven words stand here in a row ends", "one of a kind eleven words stand here in", "x nine words are a window of their own kind y",
              "nine words are a window of their own sort", "Quite-one/of a kind... quite one of a kind eleven words stand here"]
    return items, texts


def test_hits_of_all_window_lengths(spark):
    for seed in (1, 2):
        items, texts = cases(seed)
        rows = odd_rows() + [(50 + i, t, "en", "s", 1) for i, t in enumerate(texts)] * 2
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        got = sorted(((r["doc_id"], r["__found"]["n_words"], r["__found"]["n_hit"], r["__found"]["item_ids"])
                      for r in decontamination.scan(frame(spark, rows), benchmark).collect()), key=str)
        assert got == sorted(((r[0], *plain(r[1], items)) for r in rows), key=str)


def test_spans_cover_the_hit_words(spark):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "item_id long, text string")
    rows = [(1, "x a b c d e f g h i j y b c d e f g h i j k", "en", "s", 1)]
    found = decontamination.scan(frame(spark, rows), benchmark).first()["__found"]
    assert found["hit_spans"] == [[1, 11], [12, 22]] and found["n_hit"] == 20


def test_clean_rows_stay_as_they_were(spark):
    benchmark = spark.createDataFrame([(1, "ten words that no clean text of ours will ever hold")], "item_id long, text string")
    rows = odd_rows() + [(9, "so: TEN words that no clean text of ours will ever hold", "en", "s", 1)]
    docs = frame(spark, rows)
    kept = decontamination.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.filter("doc_id IS NULL OR doc_id <> 9").collect()))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.scan(frame(spark, []), none).collect() == []
    assert {r["__found"]["n_hit"] for r in decontamination.scan(frame(spark, odd_rows()), none).collect()} == {0}


def test_query_against_sql(spark):
    assert compare(queries()["op3_decontamination"](spark, SF001), duck(SF001), oracle_sql()["op3_decontamination"])["status"] == "exact"
    empty = hashlib.sha256(b"").hexdigest()
    rows = queries()["op3_decontamination"](spark, SF001).filter("n_items = 0").select("items_sha256").distinct().collect()
    assert [r[0] for r in rows] == [empty]

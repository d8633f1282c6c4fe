"""License scan against a plain search for phrases, and against its SQL."""

from tessera.llm import licenses
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tests.llm.helpers import SF001, frame, odd_rows, words
from tests.oracle_harness import compare, duck

BASE = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def plain(text):
    w = words(text)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(w)) if tuple(w[i:i + len(phrase)]) == phrase]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_phrases_spans_and_odd_rows(spark):
    notice = "Released -- under the MIT License."
    texts = ["CC-BY 4.0, cc by cc\nBY", "GNU General Public License; ALL RIGHTS  reserved.", notice, "all rights\x00reserved rights",
             "Licensed under the fine Apache License, version 2.0", "license public general", "cc", "released into something else", "the MIT under released license"]
    rows = odd_rows() + [(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)] * 2
    got = sorted(map(tuple, licenses.scan(frame(spark, rows)).collect()), key=str)
    expected = sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert [g[:6] for g in got] == expected
    labels = {g[0]: g[6] for g in got}
    assert labels[102] == "mit" and labels[104] == "apache-2.0" and labels[100] == "cc-by" and labels[108] == "" and labels[107] == ""
    assert all(0 <= g[7] <= 1 for g in got) and {g[0]: g[7] for g in got}[102] == 1


def test_neighbouring_diagonals_merge_across_an_inserted_word(spark):
    rows = [(1, "permission is hereby granted entirely free of charge to any person obtaining one a copy of this software", "en", "s", 1)]
    found = [r for r in licenses.spans(frame(spark, rows)).collect() if r["label"] == "mit"]
    assert len(found) == 1 and found[0]["start"] == 0 and not found[0]["exact"] and found[0]["coverage"] >= 0.8


def test_empty_table_and_sql(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    assert compare(queries()["op1_licenses"](spark, SF001), duck(SF001), oracle_sql()["op1_licenses"])["status"] == "exact"


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(frame(spark, odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

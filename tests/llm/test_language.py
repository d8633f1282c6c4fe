"""Language: each kind of evidence decides where the others are silent."""

import pyarrow as pa  # noqa: F401

from tessera.llm import language
from tessera.llm.queries import queries
from tests.llm.helpers import SF01

EN, DE = "the house of that other thing with them there ", "das haus und die sache mit dem anderen dort nicht "
PAGES = "page_id long, url string, html string, lang string, host string"


def docs(spark):
    rows = [(i, EN * (3 + i % 4) if i % 2 else DE * (3 + i % 4), "en" if i % 2 else "de") for i in range(20)] + [(50, None, "en"), (51, EN, None), (52, "", "de")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def page(text, lang=None):
    return f"<!DOCTYPE html><html{f' lang={lang!r}' if lang else ''}><script>var the = 'the the the';</script><p>{text}</p><!-- das und die --></html>"


def identified(spark, rows):
    pages = spark.createDataFrame([(*r, "zz", "clash") for r in rows], PAGES)
    return {r["page_id"]: r for r in language.identify(pages, docs(spark)).collect()}


def test_evidence_is_fused(spark):
    rows = [(i, f"http://www.{'e' if i % 2 else 'd'}.org/{'en' if i % 2 else 'de'}/{i}", page(EN if i % 2 else DE, "en" if i % 2 else "de")) for i in range(60)]
    rows += [(100, "http://www.d.org/1", page("")), (101, "http://new.example/1", page("", "de")), (102, "http://new.example/de/2", page("")),
             (103, "http://www.d.org/en/9", page(EN * 4, "de")), (104, "http://sub.www.e.org/", page("")), (105, None, None), (106, "", page(DE)), (106, "", page(DE))]
    got = identified(spark, rows)
    assert all(got[i]["lang"] == ("en" if i % 2 else "de") and got[i]["probability"] > 0.99 for i in range(60))
    assert got[100]["lang"] == "de" and got[104]["lang"] == "en"  # the host and its parent
    assert got[101]["lang"] == "de" and got[102]["lang"] == "de"  # the markup, the address
    assert got[103]["lang"] == "en"  # a text outweighs markup and host
    assert got[106]["lang"] == "de" and got[105]["lang"] in ("de", "en")
    assert all(0 < r["probability"] <= 1 for r in got.values())


def test_visible_text():
    assert language.visible("<p>a<b>b</b><style>x{}</style>c<!-- no <p> -->d<SCRIPT>if (a<b) no</SCRIPT>e <br") .split() == [b"a", b"b", b"c", b"d", b"e"]
    assert language.visible(None) == b"" and language.visible("<!-- open").strip() == b""


def test_hosts_of_many_labels_and_empty_tables(spark):
    got = identified(spark, [(1, "http://" + "a." * 500 + "net/x", page(DE)), (2, "http://..", page(EN))])
    assert got[1]["lang"] == "de" and got[2]["lang"] == "en"
    assert identified(spark, []) == {}
    none = language.identify(spark.createDataFrame([(1, None, None, "", "")], PAGES), docs(spark).limit(0)).collect()
    assert [(r["page_id"], r["lang"], r["probability"]) for r in none] == [(1, None, 0.0)]


def test_query_agrees_with_markup_and_address(spark):
    got = queries()["op6_language"](spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/pages.parquet").count()
    assert sum(r["lang"] == r["declared"] for r in got) >= 0.98 * len(got)
    assert sum(r["text_lang"] == r["declared"] for r in got) >= 0.9 * len(got)

"""URL rules against a plain search for the longest rule."""

import random

from tessera.llm import url_rules
from tessera.llm.oracles import oracle_sql
from tessera.llm.queries import queries
from tests.llm.helpers import SF001
from tests.oracle_harness import compare, duck


def parts(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    stop = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:stop], rest[stop:]
    path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}


def test_nested_rules_of_random_urls(spark):
    pick = random.Random(11)
    labels, names = ["a", "b", "co", "net", "x-y"], ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/ab", "/é"]
    host = lambda n: ".".join(pick.choice(labels) for _ in range(pick.randint(1, n)))
    rules = list({(h, p): (h, p, pick.choice(["allow", "block"])) for h, p in ((host(3), pick.choice(names)) for _ in range(60))}.values())
    urls = [f"{pick.choice(['http', 'HTTPS'])}://{host(5).upper() if pick.random() < 0.2 else host(5)}{pick.choice(names)}{pick.choice(['', 'c/d', '?q=/a', '#://x/'])}" for _ in range(400)]
    urls += ["http://a.net/same"] * 50
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_urls(spark):
    rules = [("net", "/", "block"), ("", "", "allow"), ("b.net", "/x/", "allow")]
    urls = [None, "", "no scheme net/", "://", "http://", "http://net", "http://net/", "http://.net/", "http://net:80/", "HTTP://É.NET/x", "a://b://c/d",
            "http://b.net/x/" + "y" * 100_000, "http://" + "a." * 3000 + "net/x", "http://B.net/x/?\n", "http://xnet/", "http://\x00.net/\x00"]
    rules = [r for r in rules if r[0]]
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_no_pages_or_no_rules(spark):
    assert judged(spark, [], [("net", "/", "block")]) == {}
    assert judged(spark, ["http://net/"], []) == {0: ("net", "/", None, "allow")}


def test_query_against_sql(spark):
    assert compare(queries()["op7_url_rules"](spark, SF001), duck(SF001), oracle_sql()["op7_url_rules"])["status"] == "exact"


def test_keys_are_drawn_at_every_size(spark, monkeypatch):
    for n in (10, 10**5, 10**11, 10**15):
        assert abs(min(n, url_rules.SAMPLE) - n * url_rules.draw_below(n) / url_rules.DRAW) <= 1
    assert url_rules.draw_below(0) == url_rules.DRAW
    # borders cut to a few characters, and few of them: same verdicts
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.{'a.' * (i % 3)}net/{'en/' * (i % 4)}{i}") for i in range(400)], "page_id long, url string")
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/en/", "allow"), ("h3.net", "/en/en/", "allow"), ("h1.a.a.net", "/", "block")], "host string, path string, verdict string")
    want = sorted(map(tuple, url_rules.judge(pages, rules).collect()))
    for sample, longest in ((50, 1000), (200, 3), (400, 8)):
        monkeypatch.setattr(url_rules, "SAMPLE", sample)
        monkeypatch.setattr(url_rules, "LONGEST", longest)
        assert sorted(map(tuple, url_rules.judge(pages, rules).collect())) == want

"""URL filter rules by a sort-merge range join (operator 7).

A rule (host, path, verdict) fits its host and all subdomains for URLs whose
path starts with the rule's. With the host's labels reversed, a rule is a
prefix of canonical keys ``reversed host NUL path`` and so an interval of the
sorted keys. A URL has one key for each of its host's ancestors (no more than
the rules' hosts have labels), so that subdomains reach their parents' rules.

Rules and URL keys are dealt to ranges of keys: split points are quantiles of
the keys, and a rule goes to every range that its interval touches. Within a
range, rows are swept in key order; intervals of prefixes nest, so the active
rules form a stack, and the ones a key belongs to are the stack after closing
all that are no prefix of it. The longest rule (host and path together) wins.

Equal (host, path) pairs are swept once, whatever number of rows has them.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, lower_ascii

#: Keys that are drawn to place the split points, and the characters of each that are used: any texts may be borders.
SAMPLE, LONGEST = 20_000, 1000
#: Keys are drawn by a hash modulo this.
DRAW = 1 << 60


def draw_below(n: int) -> int:
    """Of ``n`` keys, about ``SAMPLE`` have a hash (modulo ``DRAW``) below this."""
    return min(DRAW, max(1, DRAW * SAMPLE // n)) if n else DRAW


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path of ``url``; both empty for null or without ``://``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", host).withColumn("path", path)


def _reversed(host) -> F.Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host, path) -> F.Column:
    return F.concat(_reversed(host), F.lit("\x00"), path)


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict): the longest fitting rule of each (host, path) that has one.

    ``rules`` is (host, path, verdict), any number of rows; hosts are lower
    case. Of rules with equal host and path the least verdict counts, of
    equally long ones of different hosts the longer host. Rules or urls with
    a null host or path take no part.
    """
    spark = urls.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    distinct = urls.select("host", "path").filter("host IS NOT NULL AND path IS NOT NULL").distinct()
    labels = F.reverse(F.split("host", r"\."))
    ancestors = F.transform(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(depth, 1)))), lambda n: F.array_join(F.slice("labels", 1, n), "."))
    keys = cut(distinct.withColumn("labels", labels).select("host", "path", F.explode(ancestors).alias("ancestor"))
               .select("host", "path", F.concat("ancestor", F.lit("\x00"), "path").alias("key")), "url-keys")
    drawn = sorted(r["key"] for r in keys.filter(F.pmod(F.xxhash64("key", "host"), F.lit(DRAW)) < draw_below(keys.count()))
                   .select(F.substring("key", 1, LONGEST).alias("key")).limit(4 * SAMPLE).collect())
    # four ranges for each partition, as the ranges are dealt to partitions by hash
    splits = sorted({drawn[i * len(drawn) // (4 * parts)] for i in range(1, 4 * parts)}) if drawn else []

    @F.arrow_udf("int")
    def range_of(key: pa.Array) -> pa.Array:
        return pa.array([bisect_right(splits, k) for k in key.to_pylist()], type=pa.int32())

    @F.arrow_udf("array<int>")
    def ranges_of(key: pa.Array) -> pa.Array:
        # splits at or below the prefix are passed; those that begin with it lie inside its interval
        out = []
        for k in key.to_pylist():
            begin = end = bisect_right(splits, k)
            while end < len(splits) and splits[end].startswith(k):
                end += 1
            out.append(list(range(begin, end + 1)))
        return pa.array(out, type=pa.list_(pa.int32()))

    dealt_rules = rules.withColumn("key", _key("host", "path")).withColumn("range", F.explode(ranges_of("key"))) \
        .select("range", "key", F.lit(0).alias("kind"), "host", "path", "verdict")
    dealt_urls = keys.select(range_of("key").alias("range"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, active = -1, []  # active: (key prefix, rule, length, verdict), outermost first
        for batch in batches:
            out: dict[str, list] = {"host": [], "path": [], "length": [], "host_length": [], "rule": [], "verdict": []}
            columns = [batch.column(c).to_pylist() for c in ("range", "key", "kind", "host", "path", "verdict")]
            for rng, key, kind, host, path, verdict in zip(*columns, strict=True):
                if rng != at:
                    at, active = rng, []
                while active and not key.startswith(active[-1][0]):
                    active.pop()
                if kind == 0:
                    active.append((key, host + path, len(host), verdict))
                elif active:
                    _, rule, host_length, won = active[-1]
                    for name, value in zip(out, (host, path, len(rule), host_length, rule, won), strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("host", pa.string()), ("path", pa.string()), ("length", pa.int32()), ("host_length", pa.int32()), ("rule", pa.string()), ("verdict", pa.string())]))

    swept = dealt_rules.unionByName(dealt_urls).repartition(parts, "range").sortWithinPartitions("range", "key", "kind") \
        .mapInArrow(sweep, "host string, path string, length int, host_length int, rule string, verdict string")
    return swept.groupBy("host", "path").agg(F.max(F.struct("length", "host_length", "rule", "verdict")).alias("best")) \
        .select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (``default`` if none fits).

    Every row of pages is returned, repeated and null urls included; columns of
    pages that have one of the four names are replaced.
    """
    marked = with_host_and_path(pages.drop("host", "path", "rule", "verdict"))
    best = match(marked, rules).select(F.col("host").alias("__host"), F.col("path").alias("__path"), "rule", "verdict")
    same = (marked.host == best["__host"]) & (marked.path == best["__path"])
    return marked.join(best, same, "left").drop("__host", "__path").withColumn("verdict", F.coalesce("verdict", F.lit(default)))

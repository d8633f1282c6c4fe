"""Language identification of web pages by Bayesian evidence fusion (operator 6).

For each page and language l, the log posterior adds up
 * the text's likelihood: hashed byte trigrams of its visible text under
   add-one smoothed counts of all labelled documents of l, tempered because
   neighbouring trigrams are not independent;
 * the language that the markup declares: P(declared | l);
 * the address suffix, that is the two-letter directory or else the top-level
   domain: P(suffix | l);
 * the host's prior, smoothed by a hierarchy: host, its parent domains and all
   pages, each level drawn towards the one above it.
The three tables are counts of what the texts alone say, made by grouped
aggregation over all pages that have a text, so markup that lies counts for
what it is worth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, lower_ascii
from tessera.llm.words import LOWER, buffers

BUCKETS = 1 << 14
#: Text evidence counts as so many independent trigrams in each hundred, and at most so many in all.
TEMPER, MOST = 0.2, 400.0
#: Pseudo-counts: of the level above in a host's prior, and of each value in the declared and suffix tables.
PRIOR, SMOOTH = 5.0, 0.5
#: Labels of the longest parent domain that shares its counts.
DEPTH = 8
#: More languages than this would not fit a broadcast model (64 KB each).
MAX_LANGUAGES = 500
#: Trigrams are counted in runs of so many bytes.
RUN = 1 << 20

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*(?:>|\Z)")


def visible(html: str | None) -> bytes:
    """The text between tags, without comments, scripts and styles."""
    return _TAG.sub(" ", _HIDDEN.sub(" ", html or "")).encode()


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram, A-Z lower-cased; white space and ASCII punctuation are one sign, and three of it say nothing."""
    x = CLASS[data]
    if len(x) < 3:
        return np.zeros(0, dtype=np.int64)
    code = x[:-2].astype(np.uint32) << np.uint32(16) | x[1:-1].astype(np.uint32) << np.uint32(8) | x[2:].astype(np.uint32)
    code = code[code != 0x202020]
    return ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


CLASS = LOWER.copy()
CLASS[[b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)]] = 32


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n): counts of trigrams over all texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                own = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for at in range(offsets[i], offsets[i + 1], RUN):
                    own += np.bincount(trigram_buckets(data[at:min(at + RUN + 2, offsets[i + 1])]), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])

    texts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return texts.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and a table (language x bucket) of log probabilities."""
    counts = cut(trigram_counts(docs), "trigrams")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.ones((len(langs), BUCKETS))
    rows = counts.toPandas()  # at most MAX_LANGUAGES x BUCKETS
    place = {name: i for i, name in enumerate(langs)}
    table[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def declared(html) -> F.Column:
    """The first two letters of the root element's lang attribute, in lower case; '' without one."""
    return lower_ascii(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})\b", 1))


def suffix(host, path) -> F.Column:
    """The address's language mark: a first directory of two letters, else the last label of the host."""
    directory = F.regexp_extract(path, r"^/([A-Za-z]{2})(?:/|$)", 1)
    return lower_ascii(F.when(directory != "", F.concat(F.lit("/"), directory)).otherwise(F.substring_index(host, ".", -1)))


def _evidence(pages: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(page_id, host, declared, suffix, text): text holds a log likelihood for each language."""

    @F.arrow_udf("array<double>")
    def likelihoods(html: pa.Array) -> pa.Array:
        out = []
        for page in html:
            data = np.frombuffer(visible(page.as_py()), dtype=np.uint8)
            total, n = np.zeros(len(langs)), 0
            for at in range(0, len(data), RUN):
                found = trigram_buckets(data[at:at + RUN + 2])
                total += table[:, found].sum(axis=1)
                n += len(found)
            out.append(total * (min(TEMPER * n, MOST) / n) if n else total)
        return pa.array(out, type=pa.list_(pa.float64()))

    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.select("page_id", host.alias("host"), declared(F.col("html")).alias("declared"), suffix(host, path).alias("suffix"), likelihoods("html").alias("text"))


def _levels(host) -> F.Column:
    """A host and its parent domains of up to ``DEPTH`` labels, longest first; the empty name stands for all pages."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.greatest(F.lit(0), n - DEPTH), n - 1), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    return F.array_distinct(F.concat(F.array(host), parents, F.array(F.lit(""))))


def _best(scores) -> F.Column:
    """Number of the highest score; of equal ones the first."""
    return F.array_position(scores, F.array_max(scores)) - 1


def host_priors(marked: DataFrame, n_langs: int) -> DataFrame:
    """(host, prior): log prior of each language for every host, smoothed down the levels of its name.

    Counts are added up by name and language first, so a host with a third of
    all pages is a few rows; the levels above a host are joined by name.
    """
    by_host = marked.groupBy("host", "guess").count()
    counts = by_host.withColumn("name", F.explode(_levels(F.col("host")))).groupBy("name", "guess").agg(F.sum("count").alias("n"))
    vectors = counts.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("by"), F.sum(F.when(F.col("guess") >= 0, F.col("n")).otherwise(0)).alias("total"))
    vectors = vectors.select("name", "total", F.transform(F.sequence(F.lit(0), F.lit(n_langs - 1)), lambda i: F.coalesce(F.element_at("by", i.cast("bigint")), F.lit(0))).alias("counts"))
    vectors = cut(vectors, "host-counts")
    levels = by_host.select("host").distinct().select("host", F.posexplode(_levels(F.col("host"))).alias("up", "name"))
    lines = levels.join(vectors, "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct(F.negative("up").alias("order"), "total", "counts"))).alias("line"))
    even = F.array_repeat(F.lit(1.0 / n_langs), n_langs)
    step = lambda p, x: F.zip_with(p, x["counts"], lambda a, c: (c + PRIOR * a) / (x["total"] + PRIOR))
    return lines.select("host", F.aggregate("line", even, step).alias("prior"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, suffix) for every row of ``pages`` (page_id, url, html).

    ``docs`` (text, lang) are the labelled texts, all of which are counted; rows
    with a null text or lang teach nothing. Without any, lang is null and
    probability 0. Null urls and pages are read as empty; a page without any
    evidence takes the most frequent language. Other columns are ignored and
    repeated rows repeat.
    """
    langs, table = text_model(docs)
    if not langs:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), declared(F.col("html")).alias("declared"), none.alias("suffix"))
    n = len(langs)
    marked = cut(_evidence(pages, langs, table).withColumn("guess", F.when(F.array_min("text") < F.array_max("text"), _best(F.col("text"))).otherwise(-1)), "page-evidence")
    totals = marked.groupBy("guess").agg(F.count("*").alias("all"))

    def conditional(column: str) -> DataFrame:
        """(column, likelihoods): log P(value | language) for every value that occurs."""
        counts = marked.groupBy(column, "guess").count().groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("guess", "count"))).alias("by"))
        sums = {r["guess"]: r["all"] for r in totals.collect()}  # one row for each language
        each = [F.log((F.coalesce(F.element_at("by", F.lit(i).cast("bigint")), F.lit(0)) + SMOOTH) / F.lit(sums.get(i, 0) + 10 * SMOOTH)) for i in range(n)]
        return counts.select(column, F.array(*each).alias(f"{column}_likelihood"))

    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    # tables, so that Spark can split the pages of a popular host or suffix in the joins
    priors, by_suffix = cut(host_priors(marked, n), "host-priors"), cut(conditional("suffix"), "suffixes")
    fused = marked.join(conditional("declared"), "declared").join(by_suffix, "suffix").join(priors, "host")
    total = add(add(add("text", "declared_likelihood"), "suffix_likelihood"), F.transform("prior", lambda p: F.log(p)))
    names = F.array(*[F.lit(x) for x in langs])
    fused = fused.withColumn("total", total).withColumn("top", F.array_max("total"))
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    return fused.select("page_id", F.element_at(names, (_best(F.col("total")) + 1).cast("int")).alias("lang"), (1 / mass).alias("probability"),
                        F.when(F.col("guess") >= 0, F.element_at(names, (F.col("guess") + 1).cast("int"))).alias("text_lang"), "declared", "suffix")

"""License scans by diagonal voting (operator 1), in DataFrame functions only.

Every pair of consecutive words of a text is hashed and joined to the places of
that pair in the license templates. A hit votes for its diagonal: document
place minus template place. Votes are counted by (text, template, diagonal);
neighbouring diagonals are merged (a word more or less shifts the rest of a
passage to the next one) and the merged spans are verified by their coverage of
the template and their length in the text. Words that join are compared
themselves, so equal hashes of different words don't count.

Base phrases must stand consecutively: they are the diagonals that have a vote
for each of the phrase's pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.shared import lower_ascii

GRAM = 2
#: Diagonals at most so far apart are neighbours.
DRIFT = 2
#: A span is a license if it covers so much of the template ...
COVERAGE = 0.8
#: ... within at most so many times its words.
STRETCH = 1.5
#: Rows of the template table that are broadcast at most (about 100 bytes each).
MAX_PLACES = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    base: bool = False


#: The base phrases of the contract, then common license notices.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("agpl-notice", "licensed under the gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("lgpl-notice", "licensed under the gnu lesser general public license"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", "released into the public domain"),
)


def template_places(spark: SparkSession, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(template, label, base, pairs, place, left, right): one row for each pair of consecutive words."""
    rows = []
    for number, t in enumerate(templates):
        words = t.words.split()
        if len(words) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {t.words!r}")
        rows += [(number, t.label, t.base, len(words) - 1, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    if len(rows) > MAX_PLACES:
        raise ValueError("too many templates to broadcast")
    # the empty pair marks a text, so that texts without hits stay in the result
    rows.append((-1, "", False, 0, 0, "", ""))
    return spark.createDataFrame(rows, "template int, label string, base boolean, pairs int, place int, left string, right string")


def hits(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, template, label, base, pairs, place, at): every pair of words that stands in a template.

    Each text also has one hit on template -1. ``row`` tells apart rows with
    equal ids; it is used in one exchange only.
    """
    words = F.filter(F.split(lower_ascii(F.col("text").cast("string")), NOT_WORD, -1), lambda w: w != "")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("words"))
    texts = texts.select("row", "doc_id", F.size("words").alias("n_words"), "words")
    none = F.array(F.struct(F.lit("").alias("0"), F.lit("").alias("1")))
    pairs = F.concat(F.arrays_zip(F.col("words").alias("0"), F.slice("words", 2, F.greatest(F.col("n_words"), F.lit(1))).alias("1")), none)
    each = texts.select("row", "doc_id", "n_words", F.posexplode(pairs).alias("at", "pair")) \
        .select("row", "doc_id", "n_words", "at", F.col("pair.0").alias("l"), F.col("pair.1").alias("r")).filter("r IS NOT NULL")
    places = template_places(docs.sparkSession, templates).withColumn("gram", F.xxhash64("left", "right"))
    return each.withColumn("gram", F.xxhash64("l", "r")).join(F.broadcast(places), "gram") \
        .filter("l = left AND r = right").drop("gram", "l", "r", "left", "right")


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(row, doc_id, n_words, label, base, pairs, start, n_span, coverage, exact): merged diagonals of each text and template.

    ``start`` and ``n_span`` are the span's first word and length, ``exact``
    says that one diagonal has every vote. Base phrases keep one span for each
    diagonal, so each of their places is a row. Each text has one row of
    label '' without votes.
    """
    dealt = hits(docs, templates).repartition("row").withColumn("diagonal", F.when(F.col("template") < 0, 0).otherwise(F.col("at") - F.col("place")))
    votes = dealt.groupBy("row", "doc_id", "n_words", "template", "label", "base", "pairs", "diagonal") \
        .agg(F.count("*").alias("votes"), F.min("at").alias("low"), F.max("at").alias("high"))
    order = W.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal", 1, -(1 << 30)).over(order) > DRIFT)
    merged = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order)) \
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "pairs", "span") \
        .agg(F.sum("votes").alias("votes"), F.max("votes").alias("most"), F.min("low").alias("start"), (F.max("high") + GRAM).alias("stop"))
    return merged.select("row", "doc_id", "n_words", "label", "base", "pairs", F.col("start").cast("long").alias("start"),
                         (F.col("stop") - F.col("start")).cast("long").alias("n_span"),
                         F.least(F.lit(1.0), F.col("votes") / F.greatest("pairs", F.lit(1))).alias("coverage"),
                         ((F.col("most") == F.col("pairs")) & (F.col("pairs") > 0)).alias("exact"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; others ignored): its license labels.

    n_base, first_word, last_word, base_labels: places of base phrases. labels:
    these and the labels of verified spans. score: the best coverage of a
    template within its stretch (0 without hits). Null and wordless texts have
    no words, no labels ('') and score 0; empty tables give no rows.
    """
    found = spans(docs, templates)
    place = F.col("base") & F.col("exact")
    real = F.col("pairs") > 0
    close = real & ~F.col("base") & (F.col("n_span") <= STRETCH * (F.col("pairs") + 1))
    labelled = place | (close & (F.col("coverage") >= COVERAGE))
    strings = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(place).alias("n_base"), F.min(F.when(place, F.col("start"))).alias("first_word"),
        F.max(F.when(place, F.col("start"))).alias("last_word"), strings(place).alias("base_labels"), strings(labelled).alias("labels"),
        F.coalesce(F.max(F.when(place | close, F.col("coverage"))), F.lit(0.0)).alias("score")) \
        .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")

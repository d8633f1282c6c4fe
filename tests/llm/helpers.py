"""Fixtures and plain re-statements shared by the tests of the training-data operators."""

import random
import re

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASHING = ["key", "row", "score", "hash", "found", "threshold", "doc", "begin", "bits", "count", "handle"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(seed, n):
    pick = random.Random(seed)
    return " ".join("".join(pick.choice(["ba", "ke", "lo", "mu", "ri", "so", "ta", "ve"]) for _ in range(pick.randint(1, 4))) for _ in range(n))


def odd_rows():
    """Nulls, empty and wordless texts, a very long text, repeated rows and ids."""
    plain = prose(1, 80)
    return [(0, None, "en", "a", None), (1, "", None, None, 0), (2, " \t\n!?.", "en", "a", 7), (3, plain, "en", "a", len(plain)),
            (4, plain, "en", "b", len(plain)), (4, plain, "en", "b", len(plain)), (5, prose(2, 30_000), "de", "a", 1),
            (6, "Ünï K çödé \U0001f600 日本語 x", "de", None, 9), (None, "no id here", None, None, 3), (None, None, None, None, None)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def collected(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]

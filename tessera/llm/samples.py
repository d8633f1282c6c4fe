"""A bounded, repeatable sample of whole texts for fitting a classifier on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut, small_batches

#: Texts above this part of a target's bytes are taken last, so that none of them crowds out the others.
LONG_PART = 32


def order_hash(doc_id) -> F.Column:
    """A pseudo-random order of ids that is the same in every run."""
    return F.xxhash64(F.lit("sample"), doc_id)


def sample_texts(docs: DataFrame, targets: DataFrame, max_docs: int, max_bytes: int) -> pd.DataFrame:
    """(doc_id, target, text, n_target): at most ``max_docs`` texts of ``max_bytes`` together, half for each target.

    ``targets`` is (doc_id, target 0/1) with one row per doc_id. n_target
    counts all rows of that target, so a caller can weigh the sample back to
    its population. Within a target the rows of least hash are picked; of them,
    those that fit are taken (see ``fitting``); texts themselves stay whole. Of
    rows that share a doc_id the smallest text counts.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sides, totals = [], {}
    for row in targets.groupBy("target").count().collect():  # at most two rows
        totals[row["target"]] = row["count"]
    for side in totals:
        sides.append(targets.filter(F.col("target") == side).withColumn("h", order_hash("doc_id"))
                     .orderBy("h", "doc_id").limit(max_docs // 2))
    if not sides:
        return pd.DataFrame({"doc_id": [], "target": [], "text": [], "n_target": []})
    chosen = sides[0]
    for side in sides[1:]:
        chosen = chosen.unionByName(side)
    picked = spark.createDataFrame(chosen.toPandas(), "doc_id long, target int, h long")  # bounded by max_docs
    # one row per picked doc_id, reduced before it is dealt: at most max_docs texts
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
                .groupBy("doc_id", "target", "h").agg(F.min("text").alias("text")), "sample")
    sized = texts.select("doc_id", "target", "h", F.octet_length("text").alias("bytes")).toPandas().sort_values(["h", "doc_id"])
    taken = [rows["doc_id"].to_numpy()[fitting(rows["bytes"].to_numpy(), max_bytes // 2, 4 * max_bytes)] for _, rows in sized.groupby("target")]
    ids = spark.createDataFrame(pd.DataFrame({"doc_id": np.concatenate(taken) if taken else []}), "doc_id long")
    got = texts.join(F.broadcast(ids), "doc_id").select("doc_id", "target", "text").toPandas().sort_values("doc_id", ignore_index=True)
    return got.assign(n_target=got["target"].map(totals))


def fitting(sizes: np.ndarray, most: int, longest: int) -> np.ndarray:
    """Places of the texts, of these sizes and in this order, that are taken into ``most`` bytes.

    A text that doesn't fit is left out and the next one tried. Those of at
    most ``most / LONG_PART`` bytes come first, then the longer ones. If none
    fits, the smallest is taken alone, up to ``longest`` bytes.
    """
    taken, left = [], most
    short = sizes <= most // LONG_PART
    for i in np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)]):
        if sizes[i] <= left:
            taken.append(i)
            left -= sizes[i]
    if not taken and len(sizes) and sizes.min() <= longest:
        taken = [int(sizes.argmin())]
    return np.sort(np.array(taken, dtype=np.int64))

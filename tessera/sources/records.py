"""Records of quoted text files that Spark may split.

A quoted cell may hold line breaks, so a line is no record and Spark's CSV
reader then takes each file in one task. Here files are read as lines, in
splits. A line ends a record when the quotes up to there in its file are even
in number: a quote inside a quoted cell is doubled, so it counts twice. How
many quotes stand before a split follows from one sum for each split. Inside a
split records are then cut as they come; what is open at its end, and what a
split begins with of a record before it, are a few fragments for each split
that are put together by file.

This holds for files that quote as RFC 4180 does: a quote in a cell without
quotes is not foreseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import materialize

#: Kinds of pieces: the end of a record begun in an earlier split, a split inside a record, the begin of one that goes on, a whole record.
END, MIDDLE, BEGIN, WHOLE = range(4)
PIECES = "file string, block long, kind int, first boolean, text binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records and fragments of each split, whose lines come in order; ``inside`` says whether the split begins in a quoted cell."""
    place, state = None, None  # of the open split: [quotes are odd, lines waiting, began inside and no end yet, no record yet]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["file", "block", "kind", "first", "text"])

    def rest() -> list[tuple]:
        if state is None or not state[1]:
            return []
        return [(*place, MIDDLE if state[2] else BEGIN, place[1] == 0 and state[3], b"\n".join(state[1]))]

    for got in batches:
        files, blocks, lines = (got.column(i).to_pylist() for i in range(3))
        odd = got.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        inside = got.column(4).to_numpy(zero_copy_only=False)
        at, out = 0, []
        while at < len(lines):
            if (files[at], blocks[at]) != place:
                out += rest()
                place = files[at], blocks[at]
                state = [int(inside[at]), [], bool(inside[at]), True]
            stop = at
            while stop < len(lines) and (files[stop], blocks[stop]) == place:
                stop += 1
            quotes = state[0] + np.cumsum(odd[at:stop])
            for end in (np.flatnonzero(quotes % 2 == 0) + at + 1).tolist():
                text = b"\n".join(state[1] + lines[at:end]) if state[1] or end > at + 1 else lines[at]
                out.append((*place, END if state[2] else WHOLE, place[1] == 0 and state[3] and not state[2], text))
                state[1:], at = [[], False, False], end
            state[1] += lines[at:stop]
            state[0], at = int(quotes[-1] % 2), stop
        if out:
            yield batch(out)
    if left := rest():
        yield batch(left)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of the text files at ``path``, line breaks in quoted cells kept; ``first`` marks a file's first one.

    A record's bytes come as ISO-8859-1 text, whatever their encoding, without the line end. Blank lines between records are left out, as Spark's
    reader does. An unclosed quote makes the rest of its file one record. Splits are as the session's file settings make them.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"),
                      ((F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "block").agg((F.sum("odd") % 2).alias("odd")) \
        .select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside"))
    # one row for each file split, of which the driver's own plan holds a list
    pieces = raw.join(F.broadcast(splits), ["file", "block"]) \
        .select("file", "block", F.col("value").cast("binary").alias("value"), "odd", "inside").mapInArrow(_pieces, PIECES)
    parts = materialize(pieces.filter(F.col("kind") != WHOLE))  # at most two for each split
    order = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    joined = parts.withColumn("number", F.sum((F.col("kind") == BEGIN).cast("int")).over(order)).groupBy("file", "number").agg(
        F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "kind", F.decode("text", "ISO-8859-1").alias("text")))).alias("parts"))
    made = joined.select("file", "first", F.array_join("parts.text", "\n").alias("record"))
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "first", F.decode("text", "ISO-8859-1").alias("record"))
    return whole.unionByName(made).withColumn("record", F.regexp_replace("record", r"\r$", "")).filter(F.trim(F.col("record")) != "")

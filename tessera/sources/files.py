"""File sources and sinks.

Reading is Spark's CSV/parquet readers (splittable, distributed); writing is
``DataFrameWriter`` (one task per partition). Result tables are small and
land as one directory per table.
"""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.records import records

SUPPORTED = (".csv", ".parquet")


#: Cells that stand for a missing value.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
                 "None", "n/a", "nan", "null")
#: Types a text column may be read as, the narrowest first.
INFERRED = ("bigint", "double", "boolean")


def _csv_cells(spark: SparkSession, path: str, multi_line: bool | str) -> tuple[list[str], DataFrame]:
    """The header, and the cells as c0, c1, ... with their ``file``; all read as single bytes (see ``read_table``)."""
    options = {"header": "true", "mode": "PERMISSIVE", "encoding": "ISO-8859-1", "escape": '"'}
    raw = spark.read.options(**options, multiLine=bool(multi_line), inferSchema=False).csv(path)
    names = [f"c{i}" for i in range(len(raw.columns))]
    if multi_line != "split":
        return raw.columns, raw.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names)], F.col("_metadata.file_path").alias("file"))
    cells = F.from_csv("record", ", ".join(f"{n} string" for n in names), {"mode": "PERMISSIVE", "escape": '"'})
    return raw.columns, records(spark, path).filter(~F.col("first")).select(cells.alias("cells"), "file").select("cells.*", "file")


def read_table(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool | str = "split") -> DataFrame:
    """Read a CSV (header, inferred types) or parquet table; other suffixes are rejected.

    Missing-value words become NULL. Quoted cells may hold line breaks, and
    large files are split all the same, by the parity of their quotes (see
    ``records``). ``multi_line=True`` is Spark's own reader, which takes a file
    in one task, for files with stray quotes in unquoted cells, ``False`` the
    one for files without line breaks in cells. A file whose bytes are not valid UTF-8 is
    read as ISO-8859-1, each file of a folder by its own bytes: cells are read
    as single bytes first, and turned back into them where they are UTF-8.
    One pass finds those files and the columns' types.
    """
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".parquet":
        return spark.read.parquet(path)
    if suffix != ".csv":
        raise ValueError(f"can't read {suffix or path}: .csv and .parquet tables are")
    columns, cells = _csv_cells(spark, path, multi_line)
    names = [f"c{i}" for i in range(len(columns))]
    as_bytes = {n: F.encode(n, "ISO-8859-1") for n in names}
    known = {n: F.when(~F.col(n).isin(*MISSING_WORDS), F.col(n)) for n in names}
    fits = lambda n, t: F.col(n).rlike("(?i)^(true|false)$") if t == "boolean" else F.trim(n).try_cast(t).isNotNull() & F.trim(n).rlike(_PLAIN)
    per_file = cells.groupBy("file").agg(
        F.bool_and(reduce(lambda a, b: a & b, [F.coalesce(F.is_valid_utf8(as_bytes[n].cast("string")), F.lit(True)) for n in names])).alias("utf8"),
        *[F.bool_and(F.when(known[n].isNotNull(), fits(n, t))).alias(f"{n}_{t}") for n in names for t in INFERRED])
    found = per_file.agg(F.collect_list(F.when(~F.col("utf8"), F.col("file"))).alias("latin"),
                         *[F.bool_and(f"{n}_{t}").alias(f"{n}_{t}") for n in names for t in INFERRED]).first()
    latin = F.col("file").isin(*found["latin"]) if found["latin"] else F.lit(False)
    text = {n: F.when(latin, F.col(n)).otherwise(F.decode(as_bytes[n], "UTF-8")) for n in names}

    def cell(n: str, kind: str) -> F.Column:
        value = F.when(~F.col(n).isin(*MISSING_WORDS), text[n])
        return value if kind == "string" else F.trim(value).try_cast(kind)

    header = [c if found["latin"] else c.encode("latin-1", "replace").decode("utf-8", "replace") for c in columns]
    if schema is not None:
        return cells.select(*[cell(n, f.dataType.simpleString()).alias(f.name) for n, f in zip(names, schema.fields)])
    kinds = [next((t for t in INFERRED if found[f"{n}_{t}"]), "string") for n in names]
    return cells.select(*[cell(n, k).alias(h) for n, k, h in zip(names, kinds, header)])


#: Numbers as a CSV cell holds them (a cast alone takes literals' type suffixes too).
_PLAIN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF])$"


def newest_file(spark: SparkSession, directory: str, patterns: str = "*.{csv,CSV,parquet}") -> str:
    """S3: path of the most recently modified supported file in a directory (error when none).

    Uses the binary-file source's metadata columns only; file contents are not read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", patterns).load(directory)
             .select("path", "modificationTime"))
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    if row is None or row["p"] is None:
        raise FileNotFoundError(f"{directory} holds no CSV or parquet table")
    return row["p"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Persist a table as parquet, CSV (with header) or JSON lines, one file for each partition.

    JSON documents have null fields written out, and the table's schema in a
    document beside them (``<path>.schema``), as JSON alone does not tell whole
    doubles from integers or dates from text.
    """
    writer = df.write.mode(mode)
    if fmt == "csv":
        # a quote inside a cell is doubled, as readers expect
        writer.options(header=True, escape='"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
        schema = df.sparkSession.createDataFrame([(df.schema.json(),)], "value string").coalesce(1)
        schema.write.mode(mode if mode == "overwrite" else "ignore").text(f"{path}.schema")
    else:
        writer.parquet(path)


def write_report(tables: dict[str, DataFrame], directory: str, fmt: str = "parquet") -> dict[str, str]:
    """A report is a set of named result tables, one directory each."""
    paths = {}
    for name, df in tables.items():
        p = os.path.join(directory, name)
        write_table(df, p, fmt)
        paths[name] = p
    return paths


def read_result(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Read a persisted result table back (JSON by the schema written beside it)."""
    p = os.path.join(directory, name)
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(p)
    if fmt == "json":
        schema = StructType.fromJson(json.loads(spark.read.text(f"{p}.schema").first()[0]))
        return spark.read.schema(schema).json(p)
    return spark.read.parquet(p)

"""Profiling (A1-A11, A17): counts, duplicates, missing values, types, class balance,
describe, histograms, box statistics, correlations, category x class counts, class weights.

Each profile is one aggregation over the table (or an ``unpivot`` first so
that all columns are done in the same pass); quantiles use the distributed
exact selection of :mod:`tessera.operators.prefix`.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.prefix import exact_quantiles


def counts(df: DataFrame) -> DataFrame:
    """A1: (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """A2: rows beyond the first occurrence of each distinct row; NULLs compare equal.

    One hash aggregation on all columns with map-side partial counts, so a
    value repeated a billion times costs one partial row per task.
    """
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
                      F.count(F.lit(1)).alias("distinct_rows"))


def missing_by_column(df: DataFrame) -> DataFrame:
    """A3: (column, missing) for every column, one pass. NaN counts as missing (pandas isna)."""
    dtypes = dict(df.dtypes)

    def is_missing(c):
        col = F.col(f"`{c}`")
        if dtypes[c] in ("double", "float"):
            return col.isNull() | F.isnan(col)
        return col.isNull()

    wide = df.agg(*[F.count_if(is_missing(c)).alias(f"m{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', m{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) AS (column, missing)")


def dtypes(df: DataFrame) -> DataFrame:
    """A4: (column, type) -- schema metadata, no data read."""
    return df.sparkSession.createDataFrame(list(df.dtypes), "column string, type string")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """A5: (class, rows) sorted by class."""
    return df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("rows")).orderBy("class")


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("__u")
    ).select("__u.column", "__u.value")


def describe_numeric(df: DataFrame, cols: list[str], exact: bool = True,
                     probs=(0.25, 0.5, 0.75), accuracy: int = 100000) -> DataFrame:
    """Count, mean, sample std, min, quartiles (linear interpolation), max per column.

    ``exact=True`` uses distributed exact selection; ``exact=False`` uses
    ``percentile_approx`` sketches (one pass, bounded memory) for huge inputs.
    """
    long = _long_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    moments = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    if exact:
        q = exact_quantiles(long, ["column"], "value", list(probs))
        wide_q = q.groupBy("column").agg(*[
            F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(names.get(p, f"q{int(p * 100)}"))
            for p in probs])
    else:
        wide_q = long.groupBy("column").agg(
            F.percentile_approx("value", list(probs), accuracy).alias("__q")).select(
            "column", *[F.col("__q")[i].alias(names.get(p, f"q{int(p * 100)}")) for i, p in enumerate(probs)])
    return moments.join(wide_q, "column", "left").select(
        "column", "count", "mean", "std", "min", *[names.get(p, f"q{int(p * 100)}") for p in probs], "max")


#: Size of a quantile sketch: ranks are off by less than RANK_ERROR of the rows (0.3 % at 99 % confidence).
SKETCH_SIZE, RANK_ERROR = 1000, 0.01


def sketch_numeric(df: DataFrame, cols: list[str], by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """A6, mergeable: one row for each part (``by``, such as a day or a file) and column, to be stored and merged later.

    (by..., column, count, total, rest, variance, min, max, sketch): a part's
    rows are read once, when it arrives. The sum is total + rest: of each value
    its leading 24 bits and what is left, whose sums round much later than a
    plain one, so means hardly depend on how rows were dealt. NULL and NaN are
    left out; a part without values has no row.
    """
    value = F.col("value")
    lead = F.when(F.abs(value) < 1e38, value.cast("float").cast("double")).otherwise(value)
    rest = F.when(F.abs(value) < 1e38, value - value.cast("float").cast("double")).otherwise(0.0)
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("__u")) \
        .select(*by, "__u.column", "__u.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("count"), F.sum(lead).alias("total"), F.sum(rest).alias("rest"), F.var_pop("value").alias("variance"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def describe_sketches(parts: DataFrame, probs=(0.25, 0.5, 0.75), size: int = SKETCH_SIZE) -> DataFrame:
    """A6 over stored parts: (column, count, mean, std, min, quantiles array, max), from ``sketch_numeric`` rows alone.

    Counts, means, deviations and extremes are those of all rows; a quantile is
    a value whose rank is within RANK_ERROR of the one asked for. ``std`` of one
    row is NULL. The parts of a column are merged by partial aggregation.
    """
    means = parts.groupBy("column").agg(((F.sum("total") + F.sum("rest")) / F.sum("count")).alias("__mean"))
    n, off = F.sum("count"), (F.col("total") + F.col("rest")) / F.col("count") - F.col("__mean")
    # deviations within the parts and between them
    squares = F.sum(F.col("count") * (F.col("variance") + off * off))
    merged = parts.join(F.broadcast(means), "column").groupBy("column", "__mean").agg(
        n.alias("count"), F.when(n > 1, F.sqrt(squares / (n - 1))).alias("std"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", F.lit(size)).alias("__sketch"))
    return merged.select("column", "count", F.col("__mean").alias("mean"), "std", "min",
                         F.kll_sketch_get_quantile_double("__sketch", F.array(*[F.lit(float(p)) for p in probs])).alias("quantiles"), "max")


def rank_errors(df: DataFrame, described: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """(column, rank_error): how far, as a share of the rows, the described quantiles' ranks are from ``probs`` at most (one pass)."""
    q = described.select(F.col("column").alias("__c"), "quantiles")  # a line for each column
    value = F.col("value")
    counts_ = _long_numeric(df, cols).where(value.isNotNull() & ~F.isnan("value")).join(F.broadcast(q), F.col("column") == F.col("__c")).groupBy("column").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(value < F.col("quantiles")[i]).alias(f"below{i}") for i in range(len(probs))],
        *[F.count_if(value <= F.col("quantiles")[i]).alias(f"upto{i}") for i in range(len(probs))])
    off = [F.greatest(F.lit(0.0), F.col(f"below{i}") / F.col("n") - p, p - F.col(f"upto{i}") / F.col("n")) for i, p in enumerate(probs)]
    return counts_.select("column", F.array_max(F.array(*off)).alias("rank_error"))


def describe_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, unique, top (most frequent; ties -> smallest value), freq per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("__u")
    ).select("__u.column", "__u.value").where(F.col("value").isNotNull())
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return per_value.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
        F.max("n").alias("freq"))


def histogram(df: DataFrame, cols: list[str], bins: int = 24) -> DataFrame:
    """Equal-width histogram per column, every bin listed (empty bins count 0).

    Edges follow numpy: [min, max] split into ``bins``; the last bin is closed;
    a constant column uses [v - 0.5, v + 0.5].
    """
    long = _long_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    ranges = long.groupBy("column").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).select(
        "column",
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    # a line for each named column: it goes to the rows, which are not dealt by column
    binned = (long.join(F.broadcast(ranges), "column")
                  .select("column", F.least(F.floor((F.col("value") - F.col("lo")) / width),
                                            F.lit(bins - 1)).cast("int").alias("bin"))
                  .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    grid = ranges.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (grid.join(binned, ["column", "bin"], "left")
                .select("column", "bin",
                        (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("lower"),
                        (F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / F.lit(bins)).alias("upper"),
                        F.coalesce("count", F.lit(0)).cast("bigint").alias("count")))


def box_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Quartiles, IQR, whiskers (extreme values inside 1.5 IQR fences), outlier count."""
    long = _long_numeric(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75]).groupBy("column").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    fences = q.select("column", "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col("value") >= lo_f) & (F.col("value") <= hi_f)
    return long.join(F.broadcast(fences), "column").groupBy("column", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: Pearson correlation for every ordered pair (pairwise complete), one aggregation.

    NULL where a correlation is not defined: a column is constant (or has
    fewer than two values) over the rows that hold both.
    """
    x = {c: F.col(c).cast("double") for c in cols}

    def pearson(a: str, b: str) -> F.Column:
        both = x[a].isNotNull() & x[b].isNotNull()
        p, q = (F.when(both, x[c]) for c in (a, b))
        varies = (F.min(p) < F.max(p)) & (F.min(q) < F.max(q))
        # corr() itself would divide by zero whatever stands around it
        return F.when(varies, F.lit(1.0) if a == b else F.try_divide(F.covar_pop(p, q), F.stddev_pop(p) * F.stddev_pop(q)))

    pairs = [*itertools.combinations(cols, 2), *((c, c) for c in cols)]
    wide = df.agg(*[pearson(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        rows += [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"c{i}").alias("r")) for p, q in {(a, b), (b, a)}]
    return wide.select(F.explode(F.array(*rows)).alias("__p")).select("__p.a", "__p.b", "__p.r")


def category_class_counts(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(column, category, class, rows) for every categorical column in one pass."""
    long = df.select(F.col(target).alias("class"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols])).alias("__u"))
    return long.groupBy(F.col("__u.column").alias("column"), F.col("__u.category").alias("category"), "class").agg(
        F.count(F.lit(1)).alias("rows"))


def class_weights(df: DataFrame, target: str, min_ratio: float = 1.5) -> DataFrame:
    """Balanced weights n / (2 n_c), applied only when max/min class count >= min_ratio.

    Returns (class, rows, weight); weight is 1.0 when the classes are balanced enough.
    """
    by_class = df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy()
    total = F.sum("rows").over(w)
    k = F.count(F.lit(1)).over(w)
    ratio = F.max("rows").over(w) / F.min("rows").over(w)
    return by_class.select("class", "rows",
                           F.when((ratio >= min_ratio) & (k >= 2), total / (F.lit(2.0) * F.col("rows")))
                            .otherwise(F.lit(1.0)).alias("weight"))


def quality_report(frame: DataFrame, target: str, rows_excluded: int, warnings: list[str], numeric: list[str] = (),
                   renamed: list[tuple[str, str]] = ()) -> DataFrame:
    """Data-quality document as a long table (section, name, value, text): rows, rows excluded,
    columns, duplicates, missing per column, types, class distribution, warnings, the described
    ``numeric`` columns (name ``column.statistic``) and the ``renamed`` headers (header, column).

    ``rows_excluded`` and ``warnings`` come from the validation counters (the
    count survives: it is not recomputed on the already filtered frame).
    """
    spark = frame.sparkSession
    schema = "section string, name string, value double, text string"
    c = counts(frame).select(F.explode(F.array(
        F.struct(F.lit("rows").alias("section"), F.lit(None).cast("string").alias("name"),
                 F.col("rows").cast("double").alias("value"), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit("columns").alias("section"), F.lit(None).cast("string").alias("name"),
                 F.col("columns").cast("double").alias("value"), F.lit(None).cast("string").alias("text")))
    ).alias("r")).select("r.*")
    d = duplicate_rows(frame).select(F.lit("duplicates").alias("section"), F.lit(None).cast("string").alias("name"),
                                     F.col("duplicates").cast("double").alias("value"),
                                     F.lit(None).cast("string").alias("text"))
    m = missing_by_column(frame).select(F.lit("missing").alias("section"), F.col("column").alias("name"),
                                        F.col("missing").cast("double").alias("value"),
                                        F.lit(None).cast("string").alias("text"))
    k = class_distribution(frame, target).select(F.lit("class").alias("section"),
                                                 F.col("class").cast("string").alias("name"),
                                                 F.col("rows").cast("double").alias("value"),
                                                 F.lit(None).cast("string").alias("text"))
    meta = spark.createDataFrame(
        [("rows_excluded", None, float(rows_excluded), None)]
        + [("dtype", col, None, t) for col, t in frame.dtypes]
        + [("column", header, None, column) for header, column in renamed]
        + [("warning", str(i), None, w) for i, w in enumerate(warnings)], schema)
    out = c.unionByName(d).unionByName(m).unionByName(k).unionByName(meta)
    if numeric:
        wide = describe_numeric(frame, list(numeric))
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("s"), F.col(x).cast("double").alias("v")) for x in wide.columns if x != "column"]))
        out = out.unionByName(wide.select("column", each.alias("x")).select(
            F.lit("describe").alias("section"), F.concat_ws(".", "column", "x.s").alias("name"), F.col("x.v").alias("value"), F.lit(None).cast("string").alias("text")))
    return out

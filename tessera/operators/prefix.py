"""Global running totals and exact quantiles without a single-task window.

``Window.orderBy`` with no (or a low-cardinality) partition key moves every
row of a group into one task. For AUC, average precision, ROC points, exact
stratified ranks and exact quantiles we need running totals over whole
groups, any of which may hold a third of all rows. One plan serves all sizes:

1. Spark deals the rows by range of (group, order), the one exchange of rows.
   The number of ranges follows the number of rows, so a group of any size is
   spread over as many ranges as it fills;
2. each range is sorted and read in order: a row gets the running totals
   within its slice (the rows of one group in one range). The result is
   written, with the slice's number;
3. totals per slice are cumulated per group and joined back as offsets, by
   that number. That table has at most #groups + #ranges rows.

Slices depend on Spark's sample of split points, which is why they are
written: totals and offsets read the same ones, whatever runs again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, MapType, StructField, StructType, VariantType

from tessera.session import materialize

ROWS_PER_RANGE = "tessera.prefix.rowsPerBucket"
#: With fewer rows than this a range is not worth a task.
ROWS_WORTH_A_TASK = 5_000
#: Offsets of up to so many slices are broadcast.
SLICES = 100_000
#: A range has fewer slices than this: the first slice of partition p has the number p * SLICES_PER_RANGE.
SLICES_PER_RANGE = 1 << 33


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _starts(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal, NaNs too."""
    both = pc.and_(pc.is_null(now, nan_is_null=True), pc.is_null(before, nan_is_null=True))
    same_kind = pc.equal(pc.is_null(now), pc.is_null(before))
    equal = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(both, same_kind))
    return ~equal.to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, new: np.ndarray, carry, inclusive: bool) -> tuple[np.ndarray, object]:
    """Running sums that begin anew where ``new`` is set (else from ``carry``), and the sum that the next batch goes on from."""
    at = np.flatnonzero(new)
    if values.dtype == np.int64:
        total = np.cumsum(values)
        base = np.concatenate([[-carry], total[at] - values[at]])
        out = total - base[np.cumsum(new)]
    else:  # not by subtraction, which would lose digits
        edges = [0, *at.tolist(), len(values)]
        parts = [np.cumsum(np.concatenate([[0 if i else carry], values[a:b]]).astype(values.dtype))[1:]
                 for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
        out = np.concatenate(parts).astype(values.dtype)
    if inclusive:
        return out, out[-1]
    shifted = np.concatenate([[carry], out[:-1]]).astype(out.dtype)
    shifted[at] = 0
    return shifted, out[-1]


def _in_order(names: list[str], keys: int, inclusive: bool):
    """For ``mapInArrow``: batches of (columns..., keys..., values...), read in order, as (columns..., slice, sums...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, carries = TaskContext.get().partitionId() * SLICES_PER_RANGE - 1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, rest = batch.columns[:len(names)], batch.columns[len(names):]
            own, values = rest[:keys], rest[keys:]
            new = np.zeros(batch.num_rows, dtype=bool)
            new[0] = last is None
            for i, key in enumerate(own):
                new[1:] |= _starts(key[1:], key[:-1])
                new[0] = new[0] or _starts(key[:1], last[i])[0]
            last = [key[-1:] for key in own]
            slices = number + np.cumsum(new)
            number = int(slices[-1])
            sums, carries = zip(*[_sums(v.fill_null(0).to_numpy(zero_copy_only=False), new, carry, inclusive)
                                  for v, carry in zip(values, carries or [0] * len(values), strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(slices), *[pa.array(s, v.type) for s, v in zip(sums, values, strict=True)]],
                                             names=[f"c{i}" for i in range(len(names) + 1 + len(values))])

    return run


def running_totals(df: DataFrame, keys: list[str], order: list, values: dict, with_totals: bool = False,
                   inclusive: bool = True, rows_per_range: int | None = None, written: bool = False) -> DataFrame:
    """Add running sums of ``values`` within each ``keys`` group in ``order``.

    ``order`` must be a total order inside a group. Output keeps all input
    columns plus one column per value name (inclusive running sum unless
    ``inclusive=False``) and, when asked, ``<name>_total`` per group. The input
    is written first; ``written=True`` says that ``df`` is such a table already.
    """
    spark = df.sparkSession
    vals = {name: _as_col(v) for name, v in values.items()}
    rows = df if written else materialize(df)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_range = rows_per_range or int(spark.conf.get(ROWS_PER_RANGE, "1000000"))
    n = rows.count()  # of a written table, from its files' footers
    ranges = max(1, min(parts, n // ROWS_WORTH_A_TASK), -(-n // per_range))

    types = rows.agg(*[F.sum(v).alias(name) for name, v in vals.items()]).schema
    group = [F.col(f"`{k}`") for k in keys]
    nested = [isinstance(rows.schema[k].dataType, (ArrayType, MapType, StructType, VariantType)) for k in keys]
    place = [*group, *[_as_col(o) for o in order]]
    dealt = rows.repartitionByRange(ranges, *place).sortWithinPartitions(*place).select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.to_json(F.struct(g)) if deep else g for g, deep in zip(group, nested, strict=True)],
        *[v.cast(types[name].dataType) for name, v in vals.items()])
    # mapInArrow has its columns by place; those of the input are named by it again
    dealt = dealt.toDF(*[f"c{i}" for i in range(len(dealt.columns))])
    fields = [*rows.schema.fields, StructField("__slice", LongType()), *[StructField(f"__loc_{name}", types[name].dataType) for name in vals]]
    out = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    local = materialize(dealt.mapInArrow(_in_order(rows.columns, len(keys), inclusive), out).toDF(*[f.name for f in fields]))

    slices = local.groupBy("__slice").agg(*[F.first(g).alias(f"__g{i}") for i, g in enumerate(group)],
                                          *[F.sum(v).alias(f"__s_{name}") for name, v in vals.items()])
    same = Window.partitionBy(*[f"__g{i}" for i in range(len(keys))])
    before = same.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(slices.select(
        F.col("__slice").alias("__of"),
        *[F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0)).alias(f"__off_{name}") for name in vals],
        *([F.sum(f"__s_{name}").over(same).alias(f"{name}_total") for name in vals] if with_totals else [])))
    offsets = F.broadcast(offsets) if offsets.count() <= SLICES else offsets
    joined = local.join(offsets, F.col("__slice") == F.col("__of"))
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__loc_{name}") + F.col(f"__off_{name}")).alias(name) for name in vals],
        *([F.col(f"{name}_total") for name in vals] if with_totals else []))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], accuracy: int = 2000) -> DataFrame:
    """Linear-interpolated quantiles per group (numpy default, percentile_cont).

    NULL and NaN values are ignored. Two passes and no shuffle of rows: a
    mergeable sketch of each group gives, for each position asked for, a
    bracket of values that surely holds it (``accuracy`` bounds the sketch, and
    the share of rows in a bracket of different values is 6 / accuracy at most:
    2 for safety and 1 for the sketch at each end). Then values are counted:
    those in a bracket level by level, all others together for each gap
    between brackets, so map-side sums leave a task with gaps + bracketed
    levels. Running counts over these give the levels at positions
    floor/ceil((n - 1) q). Groups of up to 4 * accuracy values are counted whole.
    Returns (keys..., prob, quantile, n).
    """
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x"))
    margin = 2.0 / accuracy
    low, high = ([min(max(float(p) + side * margin, 0.0), 1.0) for p in probs] for side in (-1, 1))
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__x", low + high, accuracy).alias("__b"))
    k, inf = len(probs), float("inf")
    ends = []
    for j in range(k):
        small = F.col("__n") <= 4 * accuracy
        ends.append(F.struct(F.when(small | F.lit(low[j] <= 0.0), F.lit(-inf)).otherwise(F.col("__b")[j]).alias("lo"),
                             F.when(small | F.lit(high[j] >= 1.0), F.lit(inf)).otherwise(F.col("__b")[k + j]).alias("hi")))
    # one row for each group; written, as the second pass joins it
    brackets = materialize(sketch.select(*[F.col(c).alias(f"__g_{c}") for c in keys], F.lit(1).alias("__one"), *[e.alias(f"__e{j}") for j, e in enumerate(ends)]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in keys], F.col("__l") == F.col("__one"))
    x = F.col("__x")
    kept = reduce(lambda a, b: a | b, [(x >= F.col(f"__e{j}.lo")) & (x <= F.col(f"__e{j}.hi")) for j in range(k)])
    passed = reduce(lambda a, b: a + b, [(F.col(f"__e{j}.hi") < x).cast("int") for j in range(k)])
    # order: brackets passed, then the values between them, then those inside the next
    levels = rows.withColumn("__l", F.lit(1)).join(brackets, same) \
        .groupBy(*keys, passed.alias("__passed"), F.when(kept, x).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    run = running_totals(levels, keys, ["__passed", "__x"], {"__cum": "__c"}, with_totals=True)
    n = F.col("__cum_total")
    targets = F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p"),
                 F.floor((n - 1) * F.lit(float(p))).alias("lo"), F.ceil((n - 1) * F.lit(float(p))).alias("hi"))
        for j, p in enumerate(probs)])
    holds = lambda at: (F.col(f"__t.{at}") >= F.col("__cum") - F.col("__c")) & (F.col(f"__t.{at}") < F.col("__cum"))
    hits = run.select(*keys, "__x", "__cum", "__c", n.alias("__n"),
                      F.explode(targets).alias("__t")).where(holds("lo") | holds("hi"))
    agg = hits.groupBy(*keys, F.col("__t.j").alias("__j"), F.col("__t.p").alias("prob")).agg(
        F.max(F.when(holds("lo"), F.col("__x"))).alias("__xl"),
        F.max(F.when(holds("hi"), F.col("__x"))).alias("__xh"),
        F.max("__n").alias("n"))
    frac = (F.col("n") - 1) * F.col("prob") - F.floor((F.col("n") - 1) * F.col("prob"))
    return agg.select(*keys, "prob",
                      (F.col("__xl") + (F.col("__xh") - F.col("__xl")) * frac).alias("quantile"),
                      F.col("n"))

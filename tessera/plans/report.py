"""Report tables (S8) and the overall interpretation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overall_interpretation(friedman: DataFrame, paired_t: DataFrame, wilcoxon: DataFrame,
                           family: list[str] = ()) -> DataFrame:
    """One sentence per family combining Friedman and the counts of significant pairs."""
    family = list(family)
    t = paired_t.groupBy(*family).agg(F.count_if("significant").alias("t_sig"), F.count(F.lit(1)).alias("t_all"))
    w = wilcoxon.groupBy(*family).agg(F.count_if("significant").alias("w_sig"), F.count(F.lit(1)).alias("w_all"))
    j = friedman.select(*family, "available", "p_value")
    for side in (t, w):
        # without families each side is one row
        j = j.join(side, family, "left") if family else j.withColumn("__one", F.lit(1)).join(side.withColumn("__one", F.lit(1)), "__one").drop("__one")
    overall = (F.when(~F.col("available"), F.lit("Too few complete blocks for an overall test."))
                .when(F.col("p_value") < 0.05, F.lit("Overall, the treatments are not all alike (Friedman)."))
                .otherwise(F.lit("Overall, the treatments can't be told apart (Friedman).")))
    pairs = F.format_string("Pairs that differ after Holm: %d of %d by the t test, %d of %d by signed ranks.",
                            *[F.coalesce(c, F.lit(0)) for c in ("t_sig", "t_all", "w_sig", "w_all")])
    return j.select(*family, F.concat_ws(" ", overall, pairs).alias("interpretation"))

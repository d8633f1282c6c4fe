"""Bindings of the study roles to the shared parquet tables.

The study engine works on any labelled table; these builders derive study
inputs from the TPC-H-like tables so every registered query reads them
whole and its work grows with them:

* an *upload* frame (orders joined to customer) with messy headers, text
  numerics, missing values and a messy target with an excluded class 2;
* model *scores* per row from an md5 uniform mixed with the target;
* a *fold-score* table (block = order month, treatment = order priority,
  value = mean total price).

Every builder is plain DataFrame/SQL code: Catalyst prunes the scans to the
columns used and pushes filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import uniform_sql
from tessera.spec import IRRIGATION_SPEC, TableSpec

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Study spec for the order-derived upload: canonical names and the header
# slugs accepted for them.
ORDER_SPEC = TableSpec(
    numeric=("total_price", "account_balance", "order_month"),
    categorical=("order_status", "order_priority", "market_segment"),
    target="result",
    optional=("clerk_group",),
    aliases={
        "order_key": frozenset({"order_key", "orderkey", "o_orderkey"}),
        "total_price": frozenset({"total_price", "totalprice", "o_totalprice"}),
        "account_balance": frozenset({"acct_bal", "account_balance", "c_acctbal"}),
        "order_month": frozenset({"order_month", "month"}),
        "order_status": frozenset({"order_status", "status", "o_orderstatus"}),
        "order_priority": frozenset({"order_priority", "priority", "o_orderpriority"}),
        "market_segment": frozenset({"mkt_segment", "market_segment", "c_mktsegment"}),
        "result": frozenset({"result", "target", "label"}),
    },
    key="order_key",
    positive=IRRIGATION_SPEC.positive,
    negative=IRRIGATION_SPEC.negative,
    excluded_class=2.0,
)

# SQL text of the upload projection; the same expressions are valid in
# Spark SQL and in ANSI engines, which lets the check tool rebuild the input.
UPLOAD_COLUMNS = [
    ("o_orderkey", "Order Key"),
    ("o_totalprice", "Total Price"),
    ("CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE c_acctbal END", "Acct Bal"),
    ("CASE WHEN o_orderkey % 29 = 0 THEN 'unknown' ELSE CAST(month(o_orderdate) AS STRING) END", "Order Month"),
    ("o_orderstatus", "Order Status"),
    ("o_orderpriority", "Order-Priority"),
    ("CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE c_mktsegment END", "Mkt Segment"),
    ("CASE WHEN o_custkey % 3 = 1 AND o_orderkey % 4 = 0 THEN ' Yes ' "
     "WHEN o_custkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'NO' "
     "WHEN o_custkey % 3 = 2 AND o_orderkey % 8 = 0 THEN '2.0' "
     "ELSE CAST(o_custkey % 3 AS STRING) END", "Result"),
]

# A target column with unusable values, for the quarantine path.
MESSY_RESULT = ("CASE o_orderkey % 13 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'maybe' "
                "WHEN 3 THEN 'si' WHEN 4 THEN 'False' WHEN 5 THEN '7' WHEN 6 THEN 'required' "
                "ELSE CAST(o_custkey % 3 AS STRING) END")


def upload_frame(spark: SparkSession, sf_dir: str, messy_target: bool = False) -> DataFrame:
    """Orders left-joined to customer, shaped like a user upload."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
    cols = list(UPLOAD_COLUMNS)
    if messy_target:
        cols[-1] = (MESSY_RESULT, "Result")
    return joined.select(*[F.expr(sql).alias(name) for sql, name in cols])


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated study table (lazy): canonical names, coerced types, binary target."""
    from tessera.operators.validate import validated_frame
    return validated_frame(upload_frame(spark, sf_dir), ORDER_SPEC)


# stand-ins, not networks: md5 scores that lean on the label more or less
MODELS = ("scorer_a", "scorer_b", "scorer_c", "scorer_d", "scorer_e")
# Weight of the true label in each synthetic score: stronger scorers lean more on y.
MODEL_SIGNAL = {"scorer_a": 0.62, "scorer_b": 0.55, "scorer_c": 0.47, "scorer_d": 0.41, "scorer_e": 0.33}


def score_sql(key: str, y: str, model: str, seed: int = 42) -> str:
    """score = w * y + (1 - w) * u(key, model, seed); u uniform from md5."""
    w = MODEL_SIGNAL[model]
    u = uniform_sql(f"concat(CAST({key} AS STRING), '{model}', '{seed}')")
    return f"({w}D * {y} + {1 - w}D * {u})"


def scored(df: DataFrame, key: str, y: str, seed: int = 42, keep: list[str] = ()) -> DataFrame:
    """Long predictions (key, y, model, score, keep...): one row per input row and model."""
    per_model = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(score_sql(key, y, m, seed)).alias("score"))
                          for m in MODELS])
    return (df.select(F.col(key), F.col(y), *keep, F.explode(per_model).alias("p"))
              .select(key, y, "p.model", "p.score", *keep))


def fold_scores(spark: SparkSession, sf_dir: str, by_status: bool = False) -> DataFrame:
    """(block, treatment, value): order month x order priority -> mean total price.

    With ``by_status`` the order status becomes a family column, giving
    independent test families that run in the same jobs.
    """
    orders = table(spark, sf_dir, "orders")
    family = [F.col("o_orderstatus").alias("family")] if by_status else []
    return (orders.groupBy(*family, F.date_format("o_orderdate", "yyyy-MM").alias("block"),
                           F.col("o_orderpriority").alias("treatment"))
                  .agg(F.avg("o_totalprice").alias("value")))

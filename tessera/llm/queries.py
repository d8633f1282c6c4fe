"""The registered query of each operator, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat, collocations, decontamination, language, licenses, oracles, packing, passages, periodic, quality, simhash, topk, toxicity, url_rules
from tessera.llm.shared import table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file of the contract; the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("__found.item_ids", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "__found.n_words", "__found.n_hit", F.size("__found.item_ids").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("__found.n_hit") > 0).alias("contaminated"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


#: Fixed by the contract: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~toxicity.not_held_out(F.col("doc_id")), F.lit(False))
    return toxicity.classify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.with_planted_runs(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.ranked(table(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.formatted(turns.unionByName(probe)))


def queries() -> dict:
    return {"op1_licenses": op1_licenses, "op2_packing": op2_packing, "op3_decontamination": op3_decontamination, "op4_passages": op4_passages, "op5_topk": op5_topk, "op6_language": op6_language, "op7_url_rules": op7_url_rules, "op8_simhash": op8_simhash, "op9_toxicity": op9_toxicity,
            "op10_quality": op10_quality, "op11_periodic_runs": op11_periodic_runs, "op12_collocations": op12_collocations, "op13_chat": op13_chat}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""The thin queries of the corpus operators, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hosts, langid, line_dedup, merkle, mixing, packing, pseudonyms, quality_model, quality_rules, simhash


#: Public, hence only for synthetic tables.
TRIAL_KEY = "stripeworks trial key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the number of the document they show at the end of their path; its label is the page's outcome."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    shown = F.regexp_extract(hosts.path_of(F.col("url")), "/([0-9]{1,18})(\\.html)?/?$", 1)
    refs = pages.select("page_id", F.when(shown != "", shown).cast("long").alias("doc_id"))
    outcomes = refs.join(labels, "doc_id").select("page_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return hosts.judge_urls(pages, outcomes)


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``stripeworks.pseudonyms.key``; the trial key is for tables that hold nobody's data."""
    key = spark.conf.get("stripeworks.pseudonyms.key", TRIAL_KEY).encode()
    found = pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"), key)
    return found.select("doc_id", "text", F.size("found").alias("n_found"), F.array_sort(F.array_distinct(F.col("found.kind"))).alias("kinds"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_frequent_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(_table(spark, sf_dir, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select(F.col("__id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), taken)


def queries() -> dict:
    own = (op1_url_reputation, op2_merkle_fingerprints, op3_packing, op4_pseudonyms, op5_quality_model, op6_quality_rules, op7_simhash, op8_language, op9_line_dedup, op10_mixing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from . import sql

    return sql.oracle_sql()

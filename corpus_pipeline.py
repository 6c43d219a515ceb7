"""From raw documents to packed sequences, in five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stripeworks.llm import line_dedup, mixing, near_copies, packing, quality_rules
from stripeworks.llm.common import bits_of, cut, with_bit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.judge(docs).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many of the remaining documents share go; ``n_chars`` follows the text."""
    return line_dedup.drop_frequent_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word similarity of 0.8 or more) the text with the smallest id stays, once.

    A group in which no row has an id keeps one row as well.  Of rows with the
    same id and text the one with the least language and source stays.
    """
    first = near_copies.groups(docs).select("first").distinct()
    firsts = first.select(F.when(~F.col("first.z"), F.col("first.id")).alias("__id"), F.col("first.v").alias("__v"), F.lit(True).alias("__first"))
    marked = docs.withColumn("__v0", near_copies.text_hash())
    counts = marked.groupBy(F.col("doc_id").alias("__id0"), "__v0").agg(F.count(F.lit(1)).alias("__n"))
    known = counts.join(firsts, F.col("__id0").eqNullSafe(F.col("__id")) & (F.col("__v0") == F.col("__v")), "left")
    # Of these keys (id and text) some rows go.  Those of all other keys stay, and most of them need no join.
    some = known.filter("__first is null or __n > 1").select(F.col("__id0").alias("__id"), F.col("__v0").alias("__v"), F.col("__first").isNotNull().alias("__first"))
    odd = cut(some, "some-rows-go")
    bit = with_bit(marked, bits_of(odd, "__v", "__id"), "__v0", "doc_id")
    met = bit.filter("__bit").join(odd, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__v0") == F.col("__v")), "left")
    kept = bit.filter("not __bit").select(docs.columns).unionByName(met.filter("__first is null").select(docs.columns))
    if odd.filter("__first").isEmpty():
        return kept
    others = [c for c in docs.columns if c != "doc_id"]
    one = F.min_by(F.struct(*others), F.struct("lang", "source"))
    repeated = met.filter("__first").groupBy("doc_id", "__v0").agg(one.alias("x")).select("doc_id", *[F.col(f"x.`{c}`") for c in others])
    return kept.unionByName(repeated.select(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Drop the lines that many documents share.

Lines are exploded in normal form, hashed, and counted once a document; the
lines over the threshold are looked up again by position, and each document is
put together from the positions that stay.  Texts are shuffled once, by
document; everything else moves hashes and positions only.  Texts and lines
may have any length; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, UPPER, cut, let, sheltered


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _hashes(text: Column, min_chars: int) -> Column:
    """Of each line its key's 96-bit hash, or null where the key is too short to count."""
    def one(line: Column) -> Column:
        return let(line_key(line), lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.hash(k).alias("g"))))

    return F.transform(_lines(text), one)


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Hashes (h, g) of the line keys found in at least ``min_docs`` documents.

    Each row is a document, so repeated rows count apart; a line counts once a row.
    """
    keys = F.array_distinct(F.filter(_hashes(F.col(text), min_chars), lambda x: x.isNotNull()))
    return (
        docs.select(F.explode(keys).alias("k"))
        .groupBy("k.h", "k.g")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("h", "g")
    )


@sheltered
def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the frequent lines gone from ``text``, plus ``n_lines`` (before) and ``n_dropped``.

    A null or empty text is one empty line: it stays, and a null text comes
    back as the empty text.  Keys shorter than ``min_chars`` are never dropped.
    Rows with equal id and text have equal lines, so they share one list of
    positions; null ids are an id like any other.  Input columns named
    ``n_lines`` or ``n_dropped`` are replaced; all others pass through.
    """
    # Stored, so that the join below stands on its own: the side of a line that a third of the documents share can then be split.
    found = cut(frequent_lines(docs, text, min_docs, min_chars), "frequent-lines")
    marked = F.col(id_col).alias("__id"), F.xxhash64(F.col(text)).alias("__th")
    places = (
        docs.select(*marked, F.posexplode(_hashes(F.col(text), min_chars)).alias("__pos", "__k"))
        .filter(F.col("__k").isNotNull())
        .select("__id", "__th", "__pos", F.col("__k.h").alias("h"), F.col("__k.g").alias("g"))
        .join(found, ["h", "g"], "left_semi")
        .groupBy("__id", "__th")
        .agg(F.collect_set("__pos").alias("__drop"))
        .select(F.col("__id").alias("__id2"), F.col("__th").alias("__th2"), "__drop")
    )
    own = docs.drop("n_lines", "n_dropped").withColumn("__th", F.xxhash64(F.col(text)))
    joined = own.join(places, own[id_col].eqNullSafe(places["__id2"]) & (own["__th"] == places["__th2"]), "left")
    gone = F.coalesce("__drop", F.array().cast("array<int>"))

    def whole(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        kept = F.when(F.size(gone) == 0, lines).otherwise(F.transform(stay, lambda i: lines[i]))
        return F.struct(F.array_join(kept, "\n").alias("text"), F.size(lines).cast("long").alias("n"))

    return (
        joined.withColumn("__out", let(_lines(F.col(text)), whole))
        .withColumn(text, F.col("__out.text"))
        .withColumn("n_lines", F.col("__out.n"))
        .withColumn("n_dropped", F.size(gone).cast("long"))
        .drop("__th", "__id2", "__th2", "__drop", "__out")
    )

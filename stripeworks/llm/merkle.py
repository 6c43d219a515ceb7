"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text is cut into sections (at blank lines), paragraphs (at line ends) and
phrases (where ``CUT`` says: after words by their last character, so that cuts
depend on the words nearby and move with them; after any word that ends in a
sign, a digit, a capital or a letter beyond a to z; after full-width stops).  Written out, a fingerprint is

    root section:paragraph=phrase,phrase|paragraph=...;section:...

with 32, 16, 12 and 6 hexadecimal digits.  Cutting loses nothing and the root
hashes full hashes, so roots are equal where texts are; the inner hashes tell
which branches differ.  Two trees are compared from the root down: branches
that both have, wherever they stand, are not entered.  All of it is built-in
functions.

A null text is the empty text, which has a tree of one empty phrase; texts of
any length are read whole; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let

CUT = "([^acf-rt-z] |[。！？、，；：])"
MARK = "\x1f"
#: Ranges of ids for each shuffle partition: one window holds one range.
RANGES_EACH = 4


def fingerprint(text: Column) -> Column:
    """The written tree of a text; null is the empty text."""
    def phrases(p: Column) -> Column:
        marked = F.regexp_replace(p, CUT, f"$1{MARK}")
        return F.array_join(F.transform(F.split(marked, MARK), lambda x: F.substring(F.md5(x), 1, 6)), ",")

    def section(s: Column) -> Column:
        pars = F.transform(F.split(s, "\n"), lambda p: F.struct(F.md5(p).alias("h"), phrases(p).alias("b")))
        return let(
            pars,
            lambda a: F.struct(
                F.md5(F.array_join(F.transform(a, lambda x: x.h), "")).alias("h"),
                F.array_join(F.transform(a, lambda x: F.concat(F.substring(x.h, 1, 12), F.lit("="), x.b)), "|").alias("b"),
            ),
        )

    def tree(a: Column) -> Column:
        root = F.substring(F.sha2(F.array_join(F.transform(a, lambda x: x.h), ""), 256), 1, 32)
        return F.concat(root, F.lit(" "), F.array_join(F.transform(a, lambda x: F.concat(F.substring(x.h, 1, 16), F.lit(":"), x.b)), ";"))

    return let(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section), tree)


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 32)


def _sections(fp: Column) -> Column:
    return F.split(F.substring(fp, F.lit(34), F.length(fp)), ";")


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring_index(section, ":", -1), "\\|")


def _phrases(paragraph: Column) -> Column:
    return F.split(F.substring_index(paragraph, "=", -1), ",")


def _leaves(nodes: Column) -> Column:
    """Phrases below some sections or paragraphs."""
    return F.aggregate(nodes, F.lit(0), lambda n, x: n + F.length(x) - F.length(F.translate(x, ",|", "")) + 1)


def _inside(nodes: Column, cut_up) -> Column:
    return F.array_distinct(F.flatten(F.transform(nodes, cut_up)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, by a descent of their trees: 1 if their roots agree, else twice the phrases they share over those they have.

    Sections that both have count by their phrases; of the others, paragraphs
    that both have; of the others, the phrases themselves, each once.
    """
    def level(x: Column, y: Column, shared: Column, deeper) -> Column:
        return let(F.array_except(x, y), lambda p: let(F.array_except(y, x), lambda q: let(shared + _leaves(F.array_intersect(x, y)), lambda n: deeper(p, q, n))))

    def sections(x: Column, y: Column) -> Column:
        return level(x, y, F.lit(0), lambda p, q, n: let(_inside(p, _paragraphs), lambda u: let(_inside(q, _paragraphs), lambda v: level(u, v, n, paragraphs))))

    def paragraphs(p: Column, q: Column, n: Column) -> Column:
        return let(_inside(p, _phrases), lambda u: let(_inside(q, _phrases), lambda v: let(F.size(F.array_intersect(u, v)), lambda k: 2 * (n + k) / (2 * n + F.size(u) + F.size(v)))))

    unequal = let(F.array_distinct(_sections(a)), lambda x: let(F.array_distinct(_sections(b)), lambda y: sections(x, y)))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(unequal)


BRANCHES = "array<struct<side:string,section:int,paragraph:int>>"


def differing_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (side, section, paragraph) of what only ``a`` or only ``b`` has.

    Places count from 0; branches are aligned by hash, so what was moved or
    pushed down by an insertion isn't reported.  A section of which the other
    side knows no paragraph is one branch, its paragraph null.
    """
    def only(side: str, x: Column, y: Column) -> Column:
        def places(sec: Column, i: Column, known: Column) -> Column:
            row = lambda j: F.struct(F.lit(side).alias("side"), i.cast("int").alias("section"), j.cast("int").alias("paragraph"))
            own = _paragraphs(sec)
            new = F.filter(F.transform(own, lambda p, j: F.when(~F.array_contains(known, p), row(j))), lambda r: r.isNotNull())
            return let(new, lambda r: F.when((F.size(r) == F.size(own)), F.array(row(F.lit(None)))).otherwise(r))

        met = _inside(F.array_except(y, x), _paragraphs)
        return let(met, lambda known: F.flatten(F.transform(x, lambda sec, i: F.when(F.array_contains(y, sec), F.array().cast(BRANCHES)).otherwise(places(sec, i, known)))))

    return let(_sections(a), lambda x: let(_sections(b), lambda y: F.concat(only("a", x, y), only("b", y, x))))


def _constant(values: list, kind: str = "bigint") -> Column:
    """A literal array, however long: it is folded once, not built for each row."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _below(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``value``, by a look at every so many and then at those between."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    count = lambda some: F.size(F.filter(some, lambda b: b < value))
    return let(F.greatest(count(_constant(bounds[::step])) - 1, F.lit(0)) * step, lambda at: at + count(F.slice(_constant(bounds), at + 1, step)))


def with_next(docs: DataFrame, id_col: str, columns: list[str], th: str, parts: int, made: dict[str, Column] | None = None) -> DataFrame:
    """``docs`` plus, for each of ``columns``, ``next_<column>`` of the next row in descending id order; after the last comes the first.

    Ids are whole numbers.  They are dealt into ranges by their quantiles, as
    many as the shuffle partitions ask for; the first row of each range also
    visits the range before it, so every row finds its successor in its own
    range and no window spans more than one.  Equal ids follow each other by
    ``th`` (hexadecimal); null ids come last, by ``th``, dealt into ranges of
    it.  ``made`` are columns computed once a row, after the shuffle.
    """
    n = max(1, RANGES_EACH * parts)
    id_, hashed = F.col(id_col).cast("bigint"), F.conv(F.substring(F.col(th), 1, 8), 16, 10).cast("bigint")
    known = docs.agg(F.percentile_approx(id_, [(i + 1) / n for i in range(n - 1)] or [0.5], max(10_000, 10 * n)), F.count(F.lit(1)), F.count(id_)).first()
    bounds = sorted(set(known[0] or []))
    blanks = -(-n * (known[1] - known[2]) // max(1, known[1]))
    null_range = F.greatest(F.lit(0), blanks - 1 - F.shiftright(hashed * blanks, 32)).cast("int")
    ranged = docs.withColumn("__range", F.when(id_.isNull(), null_range).otherwise(blanks + _below(id_, bounds)).cast("int"))
    ranged = ranged.withColumn("__key", F.struct(F.bitwise_not(id_).alias("i"), F.col(th).alias("h")))
    firsts = {r["__range"]: r["k"] for r in ranged.groupBy("__range").agg(F.min("__key").alias("k")).collect()}
    if not firsts:
        for c, v in (made or {}).items():
            ranged = ranged.withColumn(c, v)
        return ranged.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("__range", "__key")
    held = sorted(firsts)
    before = {r: held[(i + 1) % len(held)] for i, r in enumerate(held)}
    every = range(held[-1] + 1)
    first = lambda f: [f(firsts[r]) if r in firsts else 0 for r in every]
    at = F.col("__range")
    # A range holds null ids alone or none.
    leads = (F.coalesce("__key.i", F.lit(0)) == _constant(first(lambda k: k.i or 0))[at]) & (F.col("__key.h") == _constant(first(lambda k: k.h), "string")[at])
    visit = F.when(leads, F.array(_constant([before.get(r, 0) for r in every])[at].cast("int"))).otherwise(F.array().cast("array<int>"))
    stops = F.concat(F.array(F.struct(at.alias("at"), F.lit(False).alias("guest"))), F.transform(visit, lambda r: F.struct(r.alias("at"), F.lit(True).alias("guest"))))
    dealt = ranged.withColumn("__stop", F.explode(stops)).select(*docs.columns, "__key", F.col("__stop.at").alias("__at"), F.col("__stop.guest").alias("__guest")).repartition(parts, "__at")
    for c, v in (made or {}).items():
        dealt = dealt.withColumn(c, v)
    w = Window.partitionBy("__at").orderBy("__guest", F.col("__key.i").asc_nulls_last(), "__key.h")
    dealt = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return dealt.filter(~F.col("__guest")).drop("__at", "__guest", "__key")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: its last half replaced by the beginning of the next document in descending id order.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; a null text is empty; a lone document follows itself.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("__th", F.md5("text"))
    pairs = with_next(own, "doc_id", ["text", "fingerprint"], "__th", parts, {"fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    made = pairs.withColumn("__edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("__edited")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        F.round(likeness(F.col("fingerprint"), F.col("edited_fingerprint")), 6).alias("near_edited"),
        F.round(likeness(F.col("fingerprint"), F.col("next_fingerprint")), 6).alias("near_next"),
    )

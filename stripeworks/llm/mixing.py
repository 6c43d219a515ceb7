"""Mix sources to target weights by systematic sampling.

Each document's expected copies are its source's target over its source's
size; copies are what the prefix sum of expected copies, shifted by one random
offset, gains in whole numbers at the document.  Documents of a source are
laid out by size, so that the words taken stay close to the target.

The offset of a source is the one of ``OFFSETS`` random draws that comes
nearest its target; with ``draws=1`` it is the only one, and each document is
taken at its expected rate exactly, at the price of a wider miss in small
sources.  Texts of any length count by their words; repeated rows and ties are
told apart by their rank alone; an empty table gives an empty mix.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CELLS, cut, n_words_of, sheltered, with_rank

WEIGHTS, SHARE, MOST_COPIES, SEED, OFFSETS = (5, 2, 1), 1.5, 2, 20_240_613, 64


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all, by weight, none above ``most`` times its size; what one cannot give, the others do.

    Sources take the weights in turn, by code point, null last.
    """
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_, out = share * sum(size.values()), [s for s, _ in ordered], {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * unit > most * size[s]]
        if not over:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in over:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def target_table(totals: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """``targets`` for any number of sources: of ``totals`` (s, n) gives ``s, source_size, target, rate``.

    Sources are numbered by ranges, each for itself and shifted by the counts
    before it; of them all, only sums and one count a range come to the driver.
    """
    parts = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut(totals, "mix-totals").repartitionByRange(parts, F.col("s").isNull(), F.col("s")).sortWithinPartitions(F.col("s").isNull(), F.col("s"))
    placed = cut(sorted_.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shift = [0]
    for p in range(max(counts, default=0)):
        shift.append((shift[-1] + counts.get(p, 0)) % len(weights))
    turn = (within + F.array(*[F.lit(x) for x in shift])[part.cast("int")]) % len(weights)
    weighed = placed.select("s", F.col("n"), F.array(*[F.lit(float(w)) for w in weights])[turn.cast("int")].alias("w"))
    total, heavy = weighed.agg(F.sum("n"), F.sum("w")).first()
    unit, known = share * (total or 0) / (heavy or 1), 0
    while True:
        over = F.col("w") * unit > most * F.col("n")
        n_over, full, open_ = weighed.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("n"))), F.sum(F.when(~over, F.col("w")))).first()
        if n_over <= known or not open_:
            break
        unit, known = (share * total - most * (full or 0)) / open_, n_over
    target = F.when(F.col("w") * unit > most * F.col("n"), most * F.col("n")).otherwise(F.col("w") * unit).cast("double")
    out = weighed.select("s", F.col("n").alias("source_size"), target.alias("target"))
    return out.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def size_bin(size: Column) -> Column:
    """Sizes in steps of an eighth at most: 0, 1, ... 15, then eight steps to each power of two; at most some 500 bins."""
    digits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(digits * 16 + F.expr("shiftright(__size * 16, length(bin(__size)))")).cast("int")


def offsets(seed: int = SEED, n: int = OFFSETS) -> list[float]:
    rng = random.Random(seed)
    return [rng.random() for _ in range(n)]


def copies(rank: Column, rate: Column, offset: Column | float) -> Column:
    """Whole numbers crossed from ``rank`` to ``rank`` + 1 expected copies."""
    u = offset if isinstance(offset, Column) else F.lit(offset)
    # At high ranks rounding may cross a number too many.
    return F.least(F.floor((rank + 1) * rate + u) - F.floor(rank * rate + u), F.ceil(rate))


def _cell(id_: Column, text_hash: Column) -> Column:
    """Deals rows out by a hash of their ids, without an id of their texts."""
    return F.pmod(F.coalesce(F.conv(F.substring(F.md5(id_.cast("string")), 1, 8), 16, 10).cast("long"), text_hash), F.lit(CELLS))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = SEED, draws: int = OFFSETS) -> DataFrame:
    """Of each row of ``docs``: ``__id, __src, __th`` (hash of the text), ``size, source_size, target, copies`` and its ``__rank``; ``emit`` applies it.

    Sizes are words; a null text has none.  A document without words costs
    nothing and is sampled at its source's rate; in a source without any
    words the rate is zero.  Null sources are one source.  Of ``draws``
    seeded offsets a source uses the one that comes nearest its target; the
    choice depends on the rows and the seed alone, so reruns agree.  Rows
    with equal size and id are laid out side by side in any order.
    Other columns of ``docs`` are not read.
    """
    # Texts are read once, for their sizes; ranks need no more.
    own = docs.select(F.col(id_col).alias("__id"), F.col(source).alias("__src"), n_words_of(F.col(text)).alias("__size"), F.xxhash64(F.col(text)).alias("__th"))
    narrow = cut(own.withColumn("__bin", size_bin(F.col("__size"))), "mix-sizes")
    totals = narrow.groupBy(F.col("__src").alias("s")).agg(F.sum("__size").alias("n"))
    plan = cut(target_table(totals, weights, share, most), "mix-targets")
    cell = _cell(F.col("__id"), F.col("__th"))
    binned = narrow.groupBy("__src", "__bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(_upto("__src", "__bin")), F.lit(0)).alias("__base")
    base = binned.select(F.col("__src").alias("__s2"), F.col("__bin").alias("__b2"), before)
    ranked = with_rank(narrow, ["__src", "__bin"], ["__size", "__id", "__th"], cell, "__in_bin")
    ranked = ranked.join(base, ranked["__src"].eqNullSafe(base["__s2"]) & (ranked["__bin"] == base["__b2"])).join(plan, ranked["__src"].eqNullSafe(plan["s"]))
    ranked = cut(ranked.select("__id", "__src", "__size", "__th", (F.col("__base") + F.col("__in_bin")).alias("__rank"), "source_size", "target", "rate"), "mix-ranks")
    tried = offsets(seed, draws)
    sums = [F.sum(F.col("__size") * copies(F.col("__rank"), F.col("rate"), u)).alias(f"t{k}") for k, u in enumerate(tried)]
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k"), F.lit(u).alias("u")) for k, u in enumerate(tried)]))
    drawn = cut(ranked.groupBy("__src", "target").agg(*sums).select(F.col("__src").alias("s"), nearest["u"].alias("offset")), "mix-offsets")
    out = ranked.join(drawn, ranked["__src"].eqNullSafe(drawn["s"])).withColumn("copies", copies(F.col("__rank"), F.col("rate"), F.col("offset")).cast("long"))
    return out.select(F.col("__id"), F.col("__src"), F.col("__size").alias("size"), "source_size", "target", "copies", "__th", "__rank")


def _upto(group: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


@sheltered
def emit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Rows that agree in id, source and text are told apart by their number, so each gets its own copies.
    """
    plan = mix(docs, id_col, text, source, **how)
    totals = plan.groupBy("__id", "__src", "__th").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__same"))
    marked = docs.withColumn("__th0", F.xxhash64(F.col(text)))
    hit = marked[id_col].eqNullSafe(totals["__id"]) & marked[source].eqNullSafe(totals["__src"]) & (marked["__th0"] == totals["__th"])
    joined = marked.join(totals, hit)
    taken = joined.filter("__same = 1 and __copies > 0")
    if not totals.filter("__same > 1").isEmpty():
        # Rows that can't be told apart share their copies: the first of them take what does not divide.
        same = cut(joined.filter("__same > 1").withColumn("__at", F.monotonically_increasing_id()), "mix-same")
        keys = ["__id", "__src", "__th"]
        placed = with_rank(same.select(*keys, "__at"), keys, ["__at"], F.pmod(F.xxhash64("__at"), F.lit(CELLS)), "__i").select(F.col("__at").alias("__at0"), "__i")
        share = F.expr("__copies div __same + if(__i < __copies % __same, 1, 0)")
        each = same.join(placed, F.col("__at") == F.col("__at0")).withColumn("__copies", share).filter("__copies > 0")
        taken = taken.select(*[F.col(f"`{c}`") for c in docs.columns], "__copies").unionByName(each.select(*[F.col(f"`{c}`") for c in docs.columns], "__copies"))
    return taken.withColumn("__copy", F.explode(F.expr("sequence(1, __copies)"))).select(*[F.col(f"`{c}`") for c in docs.columns])

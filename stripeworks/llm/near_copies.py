"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Groups are the connected components of all such pairs.  Two rounds of cheap
candidates join most copies.  SimHash fingerprints of the shingles that differ
in at most two bits are found by the pigeonring chains of ``simhash``.  At a
similarity of 0.8 fingerprints differ in some ten bits of 64, which no segment
of them survives, so texts also meet where they share one of 20 bands of five
MinHash values.  Up to ``ALL_PAIRS_UP_TO`` texts of a band are held all against
all; of more, a few heads - those that meet most others, as the original of
many copies does - are held against all others.  Every candidate is held
against the sets themselves, so nothing is linked by chance.

What these leave out is found by exact prefix filtering over all texts, and
only pairs that are already in one group are passed over there.  Each text is
filed under its least shingle hashes, as many as two similar texts need to
share at least ``least_shared`` of them.  A text that has fewer crowded keys
than that meets each of its copies under some other key, and pairs that share
too few keys go before their sets are looked at.  Texts of mostly crowded keys
are filed again among themselves by their rarest shingles; where those are
crowded as well, heads are held against all others, eight times as many each
round, until every two texts of different groups that meet have been compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from . import simhash
from .common import SLICE, bits_of, cut, discard, give_back, with_bit

SHINGLE, SIMILARITY, BANDS, ROWS, SEED = 5, 0.8, 20, 5, 42
ALL_PAIRS_UP_TO, RARE_PAIRS_UP_TO, HEADS, MORE_HEADS = 16, 64, 4, 8
#: Keys of a text in its prefix, as a share of its shingles, beyond the least by which similar texts meet.
SPARE = 0.05
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _blend(h: np.ndarray, more: np.ndarray | np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1] + more
    return (h ^ (h >> np.uint64(27))) * _MIX[2]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words, ASCII case folded; a shorter text is one shingle, no words: none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(simhash._FOLD).split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    size = min(SHINGLE, n)
    runs = n - size + 1
    h = own[:runs] ^ np.uint64(size)
    for k in range(1, size):
        h = _blend(h, own[k : k + runs])
    h = _blend(h, _MIX[0])
    h = np.sort(h ^ (h >> np.uint64(31)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band."""
    import xxhash

    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, at : at + 512] * _FACTORS[:, None]).min(1), out=least)
    keys = least.reshape(BANDS, ROWS)
    return [x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(k.tobytes(), i) for i, k in enumerate(keys))]


def prefix_length(n: int) -> int:
    """How many of a text's ``n`` shingles, first in one order, are filed."""
    return n - math.ceil(n * SIMILARITY - 1e-9) + 1 + int(n * SPARE + 1e-9) if n else 0


def least_shared(n: Column) -> Column:
    """Filed shingles that a text of ``n`` shares with any similar text.

    Of two similar texts take the one whose prefix ends first: what both have
    of its prefix is in the other's prefix too, and it lacks no more than a
    fifth of its shingles, so ``1 + n * SPARE`` of it or more.  That text may be
    the other, which is not smaller than four fifths.
    """
    return F.floor(F.ceil(n * SIMILARITY - 1e-9) * SPARE + 1e-9) + 1


def text_hash(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def _over_texts(rows: DataFrame, work, fields: str) -> DataFrame:
    """``rows`` with ``work`` of the column ``t`` (text to a tuple of values) as ``fields`` in its place."""
    from pyspark.sql.pandas.types import to_arrow_schema

    others = [c for c in rows.columns if c != "t"]
    made = T._parse_datatype_string(fields)
    out = T.StructType([rows.schema[c] for c in others] + made.fields)
    kinds = [f.type for f in to_arrow_schema(made)]
    names = out.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                columns = zip(*[work(t) for t in b.column(len(others)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x, k) for x, k in zip(columns, kinds)]], names)
        give_back()

    return rows.select(*others, "t").mapInArrow(run, out)


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``ref`` and text ``t`` of ``wanted``.  The row with a vertex's id is looked up, not all that have its text; rows that can't be wanted are not shuffled."""
    likely = with_bit(texts, bits_of(wanted, "wv", "wid"), "v", "id").filter("__bit").drop("__bit")
    return likely.join(wanted, (F.col("v") == F.col("wv")) & F.col("id").eqNullSafe(F.col("wid"))).groupBy("ref").agg(F.min("t").alias("t"))


def _sets_of(refs: DataFrame, every: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    found = every.join(refs.distinct(), "ref").select("ref", F.col("k.v").alias("wv"), F.when(~F.col("k.z"), F.col("k.id")).alias("wid"))
    wanted = cut(found, "near-wanted")
    out = cut(_over_texts(_texts_of(wanted, texts), lambda t: (shingles(t).view(np.int64),), "s array<long>"), label)
    discard(wanted)
    return out


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b: refs) those that are near copies by their ``sets``."""
    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                x, y = b.column(2), b.column(3)
                ok = []
                for i in range(b.num_rows):
                    p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(both >= SIMILARITY * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))
        give_back()

    x = sets.select(F.col("ref").alias("a"), F.col("s").alias("x"))
    y = sets.select(F.col("ref").alias("b"), F.col("s").alias("y"))
    rows = pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y")
    return cut(rows.mapInArrow(judge, pairs.schema), "near-links")


def _by_rare_shingles(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """``rest`` (ref, n) filed under the shingles of each text that are rarest in ``rest`` (``sets``), as many as two sets of the similarity can't both lack; ``at`` is the shingle's place."""
    each = sets.select("ref", F.explode("s").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    known = each.join(shared, "key").groupBy("ref").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    # Shingles of one text alone come first in its order and meet nobody.
    sized = known.join(rest, "ref")
    prefix = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1 - (F.col("n") - F.size("s"))
    filed = sized.filter(prefix > 0).select("ref", "n", (F.col("n") - F.size("s") + 1).alias("from"), F.posexplode(F.slice("s", F.lit(1), prefix.cast("int"))).alias("i", "x"))
    return filed.select(F.col("x.key").alias("key"), "ref", "n", (F.col("from") + F.col("i")).alias("at"))


def _noted(used: list[DataFrame], df: DataFrame) -> DataFrame:
    """``df``, a cut to be discarded with the others in ``used``."""
    used.append(df)
    return df


def _by_fingerprint(every: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Candidate pairs from SimHash: each text with the least of its fingerprint, and those of fingerprints within the distance of ``simhash``."""
    heads = _noted(used, cut(every.groupBy("fp").agg(F.min("ref").alias("h")), "near-fingerprints"))
    near = simhash.links(heads.select("fp", F.col("fp").alias("rep")))
    of = lambda c: heads.select(F.col("fp").alias(f"__{c}"), F.col("h").alias(c))
    met = near.join(of("p"), F.col("u") == F.col("__p")).join(of("q"), F.col("v") == F.col("__q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    same = every.join(heads, "fp").filter(F.col("ref") != F.col("h")).select(F.col("h").alias("a"), F.col("ref").alias("b"))
    return same.unionAll(met)


def _side(df: DataFrame, c: str) -> DataFrame:
    return df.select("key", *[F.col(x).alias(c + x) for x in df.columns if x != "key"])


def _alike(first_places: bool) -> Column:
    """Whether the sizes allow the similarity, and, from the places where both first meet, what is left of both sets holds all they must share."""
    left = F.least(F.col("an") - F.col("aat"), F.col("bn") - F.col("bat")) + 1 if first_places else F.least("an", "bn")
    return left >= (F.col("an") + F.col("bn")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9


def _ordered(met: DataFrame, *more: str) -> DataFrame:
    return met.select(F.least("aref", "bref").alias("a"), F.greatest("aref", "bref").alias("b"), *more)


def _heads(large: DataFrame, each: int) -> DataFrame:
    """Of each key ``each`` rows at most, one of each part of its texts: the text that has most crowded keys."""
    met = large.groupBy("ref").agg(F.count(F.lit(1)).alias("met"))
    salted = large.join(met, "ref").groupBy("key", F.pmod(F.xxhash64("ref"), F.lit(each)).alias("salt"))
    columns = [c for c in large.columns if c != "key"]
    return cut(salted.agg(F.max_by(F.struct(*columns), F.struct("met", F.xxhash64("ref"))).alias("c")).select("key", "c.*"), "near-heads")


def _by_bands(every: DataFrame, used: list[DataFrame]) -> DataFrame:
    """Candidate pairs that share a band; in crowded bands only heads meet the others."""
    active = every.select("ref", "n", F.posexplode("keys").alias("band", "key")).select(F.struct("band", "key").alias("key"), "ref", "n")
    counts = active.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    held = _noted(used, cut(active.join(counts, "key"), "near-held"))
    small = held.filter(F.col("m") <= ALL_PAIRS_UP_TO).drop("m")
    pairs = _ordered(_side(small, "a").join(_side(small, "b"), "key").filter(_alike(False) & (F.col("aref") < F.col("bref"))))
    large = held.filter(F.col("m") > ALL_PAIRS_UP_TO).drop("m")
    if not large.isEmpty():
        star = _side(_noted(used, _heads(large, HEADS)), "a").join(_side(large, "b"), "key").filter(_alike(False) & (F.col("aref") != F.col("bref")))
        pairs = pairs.unionAll(_ordered(star))
    return pairs


def _regroup(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (ref, n, c: the group) after ``links`` (a, b)."""
    of = lambda x: labels.select(F.col("ref").alias(x), F.col("c").alias(f"c{x}"))
    moved = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("cb").alias("u"), F.col("ca").alias("v")), cut, discard)
    return cut(labels.join(moved, F.col("c") == F.col("node"), "left").select("ref", "n", F.coalesce("component", "c").alias("c")), "near-labels")


def _mixed(active: DataFrame, up_to: int, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows (key, ref, ..., c) of the keys whose texts are of several groups: of those with at most ``up_to`` outside the largest, and of the others.

    ``main`` is the largest group.
    """
    parts = active.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"))
    keys = parts.groupBy("key").agg(F.sum("m").alias("m"), F.max(F.struct("m", "c")).alias("most")).filter("m > most.m")
    held = _noted(used, cut(active.join(keys.select("key", F.col("most.c").alias("main"), (F.col("m") - F.col("most.m")).alias("others")), "key"), "near-held"))
    return held.filter(F.col("others") <= up_to).drop("others"), held.filter(F.col("others") > up_to).drop("others")


def _across(small: DataFrame) -> DataFrame:
    """Each two rows of a key that are of different groups, once: those outside the largest group meet all."""
    once = (F.col("bc") == F.col("bmain")) | (F.col("aref") < F.col("bref"))
    return _side(small.filter("c <> main"), "a").join(_side(small, "b"), "key").filter((F.col("ac") != F.col("bc")) & once)


def _by_least_hashes(filed: DataFrame, every: DataFrame, labels: DataFrame, used: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs across groups from the prefixes by hash (``filed``: key, vh), and the texts (ref, n) that crowded keys may keep apart."""
    shared = filed.groupBy("key").agg(F.min("vh").alias("lo"), F.max("vh").alias("hi")).filter("lo <> hi").select("key")
    known = every.select("vh", "ref").join(labels, "ref")
    active = cut(filed.join(shared, "key").distinct().join(known, "vh").select("key", "ref", "n", "c"), "near-filed")
    small, large = _mixed(active, RARE_PAIRS_UP_TO, used)
    discard(active)
    n = F.col("n")
    crowded = cut(large.groupBy("ref", "n").agg(F.count(F.lit(1)).alias("w")), "near-crowded")
    met = _ordered(_across(small).filter(_alike(False)), F.when(F.col("aref") < F.col("bref"), F.struct("an", "bn")).otherwise(F.struct(F.col("bn").alias("an"), F.col("an").alias("bn"))).alias("x"))
    pairs = met.groupBy("a", "b", F.col("x.an").alias("an"), F.col("x.bn").alias("bn")).agg(F.count(F.lit(1)).alias("both"))
    lacks = lambda n: F.floor(n * SPARE + 1e-9) + 1 - F.ceil(n * SIMILARITY - 1e-9)
    must = F.least(lacks(F.col("an")), lacks(F.col("bn"))) + F.ceil((F.col("an") + F.col("bn")) * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)
    if crowded.isEmpty():
        return pairs.filter(F.col("both") >= must).select("a", "b"), crowded.select("ref", "n")
    of = lambda x: crowded.select(F.col("ref").alias(x), F.col("w").alias(f"w{x}"))
    unseen = F.least(F.coalesce("wa", F.lit(0)), F.coalesce("wb", F.lit(0)))
    pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.col("both") >= must - unseen).select("a", "b")
    return pairs, crowded.filter(F.col("w") >= least_shared(n)).select("ref", "n")


def groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each distinct text as ``v`` (its hash) and ``first``, the least text (z, id, v) of its group of near copies.

    Texts are ordered by the least id they have (``z``: none, which comes
    last), then by hash.  Rows are told apart by their text, not their id:
    different texts of one id are different, and null ids take part.  A null
    text is the empty text; texts without words are one group.  No rows give
    no groups.  Whole texts count, whatever their length.  Other columns of
    ``docs`` are not read.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text).alias("v"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def keys(t: str) -> tuple:
        s = shingles(t)
        fp = simhash.majority(s)
        return len(s), fp - (1 << 64) if fp >> 63 else fp, bands(s), s[: prefix_length(len(s))].view(np.int64)

    made = cut(_over_texts(rows, keys, "n long, fp long, keys array<long>, least array<long>"), "near-keys")
    least = made.groupBy("v").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    vertex = F.struct(F.col("id").isNull().alias("z"), F.coalesce("id", F.lit(0).cast(kind)).alias("id"), F.col("v"))
    numbered = least.select(vertex.alias("k"), "n", "fp", "keys", F.monotonically_increasing_id().alias("ref"), F.xxhash64("v").alias("vh"))
    every = cut(numbered, "near-vertices")
    labels = every.select("ref", "n", F.col("ref").alias("c"))

    used: list[DataFrame] = []

    def link(labels: DataFrame, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """``labels`` after those of ``pairs`` that are near copies.  What ``pairs`` was made of goes."""
        met = cut(pairs.distinct(), "near-pairs")
        while used:
            discard(used.pop())
        if not met.isEmpty():
            both = met.select(F.col("a").alias("ref")).unionAll(met.select(F.col("b").alias("ref")))
            own = _sets_of(both, every, rows, "near-sets") if sets is None else sets
            found = _similar(met, own)
            if sets is None:
                discard(own)
            if not found.isEmpty():
                before, labels = labels, _regroup(labels, found)
                discard(before)
            discard(found)
        discard(met)
        return labels

    # Texts whose hashes ``vh`` are equal meet here, others in the prefixes too.
    twins = every.groupBy("vh").agg(F.min("ref").alias("a")).join(every.select("vh", F.col("ref").alias("b")), "vh").filter("a <> b").select("a", "b")
    labels = link(labels, _by_bands(every, used).unionAll(_by_fingerprint(every, used)).unionAll(twins))
    filed = made.select(F.xxhash64("v").alias("vh"), F.explode("least").alias("key"))
    pairs, rest = _by_least_hashes(filed, every, labels, used)
    discard(made)
    labels = link(labels, pairs)
    if not rest.isEmpty():
        sets = _sets_of(rest.select("ref"), every, rows, "near-rest")
        active, heads_each = cut(_by_rare_shingles(rest, sets), "near-rare"), HEADS
        while True:
            small, large = _mixed(active.join(labels.select("ref", "c"), "ref"), RARE_PAIRS_UP_TO, used)
            discard(active)
            pairs = _ordered(_across(small).filter(_alike(True)))
            crowded = not large.isEmpty()
            if crowded:
                heads = _noted(used, _heads(large, heads_each))
                star = _side(heads, "a").join(_side(large, "b"), "key").filter(_alike(True) & (F.col("ac") != F.col("bc")))
                pairs = pairs.unionAll(_ordered(star))
                # Heads meet all others now.
                active = cut(large.select("key", "ref", "n", "at").join(heads.select("key", "ref"), ["key", "ref"], "left_anti"), "near-buckets")
            labels = link(labels, pairs, sets)
            if not crowded:
                break
            heads_each *= MORE_HEADS
        discard(sets)
    named = every.select("k", "ref").join(labels.select("ref", "c"), "ref")
    first = named.groupBy("c").agg(F.min("k").alias("first"))
    return named.join(first, "c").select(F.col("k.v").alias("v"), "first")

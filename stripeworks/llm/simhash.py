"""Near-duplicates by SimHash, searched with pigeonring chains.

Fingerprints are cut into five segments on a ring.  If two differ in at most
two bits, some chain of consecutive segments stays within the proportional
budgets 0, 0, 1, 1, 2 (Qin and Xiao, "Pigeonring", 2018): its first two
segments are equal, and at most one bit differs in the next two together, so
at least one of those is equal as well.  That makes ten keys of 38 or 39 bits;
each distinct fingerprint is filed under all ten, and only fingerprints that
share a key are held against the chain's budgets and then the full distance.

A run of one key hands out a spanning forest of its links, never all pairs,
and long runs look their neighbours up instead of comparing all with all.
Distinct fingerprints that share 38 bits number 2**26 at most, whatever the
number of documents, and equal fingerprints are one vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, discard, give_back, map_texts

BITS, SEGMENTS, DISTANCE, SHINGLE, SEED = 64, 5, 2, 3, 42
#: Allowed differences in the first 1, 2, ... segments of a chain.
BUDGETS = tuple((k + 1) * DISTANCE // SEGMENTS for k in range(SEGMENTS))
#: Runs over this many fingerprints look neighbours up.
ALL_PAIRS_UP_TO = 256


def _segment_masks() -> list[int]:
    edges = [round(BITS * k / SEGMENTS) for k in range(SEGMENTS + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


MASKS = _segment_masks()
#: (start of the chain, the segment after the first two that must be equal as well)
KEYS = [(start, (start + third) % SEGMENTS) for start in range(SEGMENTS) for third in (2, 3)]


def key_mask(k: int) -> int:
    start, other = KEYS[k]
    return MASKS[start] | MASKS[(start + 1) % SEGMENTS] | MASKS[other]


def within_chain(diff: np.ndarray, start: int) -> np.ndarray:
    """Whether the differing bits keep within the budget at every length of the chain from ``start``."""
    total = np.zeros(diff.shape, np.uint8)
    ok = np.ones(diff.shape, bool)
    for k, budget in enumerate(BUDGETS):
        total += np.bitwise_count(diff & np.uint64(MASKS[(start + k) % SEGMENTS]))
        ok &= total <= budget
    return ok


_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text; no words: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        hashes = np.array([digest(b" ".join(words), seed)], np.uint64)
    elif shingle == 3:
        hashes = np.fromiter((digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:])), np.uint64, n)
    else:
        hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; no hashes: zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id`` and the fingerprint of its text as a signed long ``fp``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([simhash(t, shingle, seed) for t in b["t"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    return map_texts(docs, id_col, text, work, "fp long")


def _forest(fps: np.ndarray, start: int, free: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the sorted distinct ``fps`` of one run; ``free`` marks the bits in which they may differ."""
    n = len(fps)
    if n <= ALL_PAIRS_UP_TO:
        i, j = np.triu_indices(n, 1)
    else:
        bits = [np.uint64(1 << b) for b in range(BITS) if free >> b & 1]
        masks = np.array([*bits, *(a | b for x, a in enumerate(bits) for b in bits[:x])], np.uint64)
        left, right = [], []
        for m in masks[within_chain(masks, start)]:
            to = fps ^ m
            at = np.searchsorted(fps, to)
            hit = np.flatnonzero((to > fps) & (fps[np.minimum(at, n - 1)] == to))
            left.append(hit)
            right.append(at[hit])
        i, j = np.concatenate(left), np.concatenate(right)
    ok = within_chain(fps[i] ^ fps[j], start)
    i, j = i[ok], j[ok]
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key, then fp; a run may span batches."""
    def links(key: np.ndarray, slot: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pd.DataFrame:
        change = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]), [True])))
        u, v = [], []
        for k in np.flatnonzero(np.diff(change) > 1):
            a, b = change[k], change[k + 1]
            order = np.argsort(fp[a:b].view(np.uint64), kind="stable")
            own, ids, s = fp[a:b].view(np.uint64)[order], rep[a:b][order], int(slot[a])
            free = ((1 << BITS) - 1) ^ key_mask(s)
            for x, y in _forest(own, KEYS[s][0], free):
                u.append(ids[x])
                v.append(ids[y])
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    held: list[np.ndarray] | None = None
    for b in batches:
        now = [b[c].to_numpy() for c in ("key", "slot", "fp", "rep")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        first = int(np.argmax(last))
        held = [x[first:] for x in now]
        yield links(*[x[:first] for x in now])
    if held is not None:
        yield links(*held)
    give_back()


def links(reps: DataFrame) -> DataFrame:
    """Edges (u, v) between the ``rep`` of distinct fingerprints ``fp`` that are near: enough of them to connect all that are."""
    filed = F.explode(F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_signed(key_mask(k)))).alias("key")) for k in range(len(KEYS))]))
    keys = reps.select("fp", "rep", filed.alias("k")).select("k.key", "k.slot", "fp", "rep")
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key", "slot").sortWithinPartitions("key", "slot").mapInPandas(_runs, "u long, v long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed) and ``component_id``: the smallest doc_id reachable over links.

    Texts without words (null, empty, blank) have fingerprint zero and link
    like any other.  Repeated rows stay; rows with a null id get the
    component of their fingerprint but never name one, and a component of
    null ids alone has a null id.
    """
    fps = cut(fingerprints(docs, id_col, text), "fingerprints")
    reps = fps.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = components(links(reps), cut, discard).select(F.col("node"), "component")
    named = reps.join(found, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("__fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, F.col("fp") == F.col("__fp"), "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))

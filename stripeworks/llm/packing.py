"""Pack token sequences: shortest pack first over the length histogram.

Documents are tokenized once, where they lie, and cut at every ``capacity``
ids; a piece is then only its place, length and checksum.  The histogram of
piece lengths has at most ``capacity`` rows whatever the input, so the packing
is planned on the driver: lengths from the longest, each into the packs that
are shortest so far, as counts of packing patterns.  Pieces find their pattern
again by their rank among the pieces of their length.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CELLS, cut, map_texts, with_rank

CAPACITY, END = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
#: The usual split of a byte-level vocabulary into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@functools.lru_cache(2)
def load(path: str):
    """The vocabulary of a byte-level ``tokenizers`` file, run by tiktoken: the same ids, several times faster.

    Ids of such a file are in the order of its merges, so they are the ranks;
    special tokens in a text get their own ids, as ``tokenizers`` does it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    byte = {c: b for b, c in letters.items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, text: str | None) -> list[int]:
    enc = load(path)
    text = text or ""
    if any(s in text for s in enc.special_tokens_set):
        return enc.encode(text, allowed_special="all")
    return enc.encode_ordinary(text)


def pieces(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document: ``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids`` as little-endian bytes).

    A null or empty text is the end id alone.
    """
    path = path or vocabulary_path()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    fields = ", ".join([f"{n} long" for n in names[1:5]] + ["ids binary"] * with_ids)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, t in zip(b["doc_id"], b["t"]):
                ids = token_ids(path, t)
                ids.append(end)
                raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                for at in range(0, n, capacity):
                    own = raw[4 * at : 4 * (at + capacity)]
                    rows.append((doc, at, len(own) // 4, zlib.crc32(own), n, *[own] * with_ids))
            yield pd.DataFrame(rows, columns=names)

    return map_texts(docs, id_col, text, work, fields)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (the lengths of a pack, longest first) and how many packs follow each.

    Lengths go from the longest; a length enters the packs that are shortest
    so far, as many of them as it has pieces, and opens new packs, filled as
    far as it goes, only where none takes it.
    """
    packs: dict[tuple[int, ...], int] = {}
    heap: list[tuple[int, tuple[int, ...]]] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        if n:
            if pattern not in packs:
                heapq.heappush(heap, (sum(pattern), pattern))
            packs[pattern] = packs.get(pattern, 0) + n

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and heap and heap[0][0] + length <= capacity:
            _, pattern = heapq.heappop(heap)
            have = packs.pop(pattern)
            n = min(left, have)
            put(pattern, have - n)
            put((*pattern, length), n)
            left -= n
        fit = capacity // length
        put((length,) * fit, left // fit)
        if left % fit:
            put((length,) * (left % fit), 1)
    return sorted(packs.items(), key=lambda x: (-sum(x[0]), x[0]))


def layout(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length, where its pieces go: (first rank, end rank, pieces a pack, first sequence, offset of the first such piece)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            lo = next_rank.get(length, 0)
            next_rank[length] = lo + n * m
            out.setdefault(length, []).append((lo, lo + n * m, m, sequence, offset))
            offset += m * length
        sequence += n
    return out


def place(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cuts`` (with doc_id, start, length) plus ``sequence_id`` and ``offset``; ``cuts`` is read twice, so cut its lineage first."""
    spark = cuts.sparkSession
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = layout(shortest_pack_first(histogram, capacity))
    table = spark.createDataFrame([(k, v) for k, v in where.items()], "__l long, __at array<struct<lo:long,hi:long,m:long,seq:long,off:long>>")
    cell = F.pmod(F.xxhash64("doc_id", "start"), F.lit(CELLS))
    ranked = with_rank(cuts, ["length"], ["doc_id", "start", "ids_crc32"], cell, "__rank")
    hit = ranked.join(F.broadcast(table), F.col("length") == F.col("__l"))  # at most `capacity` rows
    hit = hit.withColumn("__p", F.filter("__at", lambda x: (x.lo <= F.col("__rank")) & (F.col("__rank") < x.hi))[0])
    step = F.col("__rank") - F.col("__p.lo")
    return (
        hit.withColumn("sequence_id", F.col("__p.seq") + F.floor(step / F.col("__p.m")).cast("long"))
        .withColumn("offset", F.col("__p.off") + F.pmod(step, F.col("__p.m")) * F.col("length"))
        .drop("__l", "__at", "__p", "__rank")
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their place in sequences of at most ``capacity`` ids.

    Repeated rows are packed as often as they come, alike in all but their place.  An empty table packs into nothing.
    """
    return place(cut(pieces(docs, id_col, text, path, capacity, end, with_ids), "pieces"), capacity)

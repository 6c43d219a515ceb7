"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile lists the most frequent 1- to 3-grams of letters, words padded at
both ends, by rank.  A document goes to the language from whose profile its
own most frequent n-grams are least out of place.

Texts are read whole.  Repeated rows are judged alike, ties among n-grams go by
code, among languages by name; an empty table gives an empty result; columns
other than the id, the text and (to learn) the language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts
from .quality_model import held_out

PROFILE = 300
#: Profiles are learned from this many documents a language, in expectation, chosen by a hash of their ids.
MOST_DOCS = 20_000
#: Distances are fractions of the largest possible; scores are a softmax over them.
TEMPERATURE = 0.05
#: Texts are counted in pieces of so many characters; a word on the edge of two counts as two.
PIECE = 1 << 18
UNDETERMINED = "und"
_BITS = 21
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of a text: up to three code points plus one, the edge of a word being 1, in 21 bits each."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if not len(raw):
        return raw
    s = np.where(_is_letter()[raw], raw + 1, 1).astype(np.uint64)
    s = np.concatenate(([np.uint64(1)], s, [np.uint64(1)]))
    s = s[np.concatenate(([True], (s[1:] != 1) | (s[:-1] != 1)))]
    edge = s == 1
    b = np.uint64(_BITS)
    two = s[:-1] << b | s[1:]
    three = (two[:-1] << b | s[2:])[~edge[1:-1]]
    return np.concatenate((s[~edge], two, three)) if len(s) > 1 else s[~edge]


def ranked(codes: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes, ties by code."""
    each, n = np.unique(codes, return_counts=True)
    return each[np.argsort(-n, kind="stable")[:size]]


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, most_docs: int = MOST_DOCS) -> dict[str, np.ndarray]:
    """The profile of each language in ``docs``; rows without a language or with a null text teach nothing.

    What comes to the driver is ``size`` n-grams for each distinct language:
    languages are expected to number some thousands at most.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # Only languages with more documents than that are drawn from; the rest are taken whole.
    many = known.groupBy(F.col(lang).alias("l")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_docs).collect()
    share = F.lit(1.0)
    for r in many:
        share = F.when(F.col(lang) == r["l"], F.lit(most_docs / r["n"])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, part in b.groupby("doc_id"):
                held: list[np.ndarray] = []
                size = 0
                for t in part["t"]:
                    for at in range(0, len(t), PIECE):
                        held.append(ngrams(t[at : at + PIECE]))
                        size += len(held[-1])
                        if size > 4 * PIECE:
                            yield counted(k, held)
                            held, size = [], 0
                yield counted(k, held)

    def counted(k: str, held: list[np.ndarray]) -> pd.DataFrame:
        each, seen = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
        return pd.DataFrame({"doc_id": k, "code": each.astype(np.int64), "n": seen})

    grams = map_texts(known.filter(drawn), lang, text, count, "code long, n long").withColumnRenamed("doc_id", "l")
    sums = grams.groupBy("l", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "code"))
    out: dict[str, list] = {}
    for r in sums.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("l", "rank").collect():
        out.setdefault(r["l"], []).append(r["code"])
    return {k: np.array(v, np.uint64) for k, v in out.items()}


def distances(own: np.ndarray, codes: np.ndarray, ranks: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """Out-of-place distance of the ranked n-grams ``own`` to each language, over the largest possible."""
    at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    hit = codes[at] == own
    place = np.arange(len(own))[hit, None]
    total = np.minimum(np.abs(ranks[at[hit]] - place), size).sum(0) + (~hit).sum() * size
    return total / (len(own) * size)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text: str = "text", size: int = PROFILE) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.

    Null texts, texts without letters, and all texts if nothing was learned
    are ``und`` with score 0.  Equal distances go to the first language by name.
    """
    names = sorted(profiles)
    codes = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.uint64)
    ranks = np.full((len(codes), len(names)), size, np.int64)
    for j, k in enumerate(names):
        ranks[np.searchsorted(codes, profiles[k]), j] = np.arange(len(profiles[k]))

    def one(t: str | None) -> tuple[str, float]:
        grams = ngrams(t)
        if not names or not len(grams) or not (grams < (1 << _BITS)).any():
            return UNDETERMINED, 0.0
        d = distances(ranked(grams, size), codes, ranks, size)
        best = int(np.argmin(d))
        return names[best], float(1 / np.exp((d[best] - d) / TEMPERATURE).sum())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *one(t)) for i, t in zip(b["doc_id"], b["t"])], columns=["doc_id", "lang_pred", "score"])

    return map_texts(docs, id_col, text, work, "lang_pred string, score double")


def predict(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", **how) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the documents that are not held out."""
    profiles = learn(docs.filter(~held_out(F.col(id_col))), id_col, text, lang, **how)
    made = identify(docs, profiles, id_col, text)
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

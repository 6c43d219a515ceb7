"""A quality classifier: random Fourier features, ridge regression, isotonic calibration.

Texts become some twenty statistics; random Fourier features of these
approximate a Gaussian kernel.  Each partition sums its part of the normal
equations, so what meets on the driver is a few matrices of fixed size, and
all labelled rows count.  Raw scores are calibrated by isotonic regression
over a fixed grid of score bins.

Texts of any length are read whole; repeated rows and ties score alike; an
empty table gives an empty result; columns other than the ids, the text and the
label are not read.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts
from .quality_rules import STOP_WORDS, SYMBOLS

FEATURES, RIDGE, SEED = 256, 1e-3, 11
#: Raw scores are binned over this range for the calibration.
LOW, HIGH, BINS = -0.5, 1.5, 2000

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LETTER = _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
_SYMBOL = np.isin(_BYTES, [ord(c) for c in SYMBOLS])
STATISTICS = (
    "log_bytes", "log_words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "other", "spaces", "entropy",
    "distinct", "distinct_by_length", "adjacent", "top_word", "stop_words", "all_caps", "dup_lines", "line_length", "full_stops", "commas",
)


def statistics(text: str | None) -> list[float]:
    """The document's statistics, in the order of ``STATISTICS``; an empty text has all zeros."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "replace")
    histogram = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = histogram[histogram > 0] / size
    letters = max(1, int(histogram[_LETTER].sum()))
    symbols = int(histogram[_SYMBOL].sum())
    return [
        np.log1p(size), np.log1p(n), min(20.0, (size - int(histogram[_SPACE].sum())) / n), min(3.0, symbols / n), min(3.0, int(histogram[33]) / n), min(1.0, int(histogram[124]) / n),
        int(histogram[_UPPER].sum()) / letters, int(histogram[_DIGIT].sum()) / size, 1 - (letters + int(histogram[_DIGIT | _SPACE].sum())) / size, int(histogram[_SPACE].sum()) / size, float(-(share * np.log2(share)).sum()),
        len(seen) / n, np.log(len(seen)) / np.log(n + 1), sum(map(operator.eq, words, words[1:])) / n, max(seen.values()) / n, sum(seen[w] for w in STOP_WORDS) / n, sum(map(str.isupper, words)) / n,
        1 - len(set(lines)) / len(lines), np.log1p(size / len(lines)), int(histogram[46]) / n, int(histogram[44]) / n,
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and its statistics ``x``."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": [statistics(t) for t in b["t"]]})

    return map_texts(docs, id_col, text, work, "x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.cos((x - self.mean) / self.scale @ self.weights + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def isotonic(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the centres and the levels of the blocks of a rising fit to good / n over ``at``."""
    blocks: list[list[float]] = []
    for x, g, c in zip(at, good, n):
        blocks.append([x * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([x / c for x, _, c in blocks]), np.array([g / c for _, g, c in blocks])


def fit(rows: DataFrame, n_features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """Fit on ``rows`` (x, y); null labels are left out; without any label there is no model."""
    rows = rows.filter("y is not null").select("x", F.col("y").cast("double").alias("y"))
    d = len(STATISTICS)
    moments = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(d)], *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1 : d + 1], float), np.array(moments[d + 1 :], float)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(seed)
    model = Model(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, n_features)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((n_features + 1, n_features + 1)), np.zeros(n_features + 1)
        for part in batches:
            z = model.expand(np.array(part["x"].tolist(), float).reshape(-1, d))
            a += z.T @ z
            b += z.T @ part["y"].to_numpy(float)
        yield pd.DataFrame({"line": np.arange(n_features + 1), "v": [x.tobytes() for x in np.hstack((a, b[:, None]))]})

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in batches:
            for line, v in zip(part["line"], part["v"]):
                sums[line] = sums.get(line, 0.0) + np.frombuffer(v)
        yield pd.DataFrame({"line": list(sums), "v": [x.tobytes() for x in sums.values()]})

    # Matrix lines are dealt out, and each is summed as the partitions' parts stream by: no task holds more than one matrix.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = rows.mapInPandas(partial, "line int, v binary").repartition(min(parts, n_features + 1), "line").mapInPandas(total, "line int, v binary").collect()
    whole = np.zeros((n_features + 1, n_features + 2))
    for r in sums:
        whole[r.line] += np.frombuffer(r.v)
    a, b = whole[:, :-1], whole[:, -1]
    model.ridge = np.linalg.solve(a + ridge * moments[0] / n_features * np.eye(n_features + 1), b)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            raw = model.raw(np.array(part["x"].tolist(), float).reshape(-1, d))
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
            yield pd.DataFrame({"bin": at, "y": part["y"]})

    bins = rows.mapInPandas(binned, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    at = np.array([LOW + (r.bin + 0.5) * (HIGH - LOW) / BINS for r in bins])
    model.knots, model.levels = isotonic(at, np.array([r.good for r in bins]), np.array([r.n for r in bins], float))
    return model


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from the learning: CRC-32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from the rows of ``labels`` whose document is not held out; a
    document with several labels counts once for each, labels of unknown
    documents and null labels not at all.  Without labels every score is 0.5.
    Empty and null texts have a score like any other.
    """
    x = cut(features(docs, id_col, text), "statistics")
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).alias("y"))
    rows = x.filter(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("__id")).select("x", "y")
    model = fit(cut(rows, "labelled"), **how)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = np.array(b["t"].tolist(), float).reshape(-1, len(STATISTICS))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.score(own) if model else np.full(len(own), 0.5)})

    scored = map_texts(x, "doc_id", "x", work, "score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

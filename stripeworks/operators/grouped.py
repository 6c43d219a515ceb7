"""Many small groups in few Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Group = dict[str, np.ndarray]


def by_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], one: Callable[[Group], Group | None], schema: str) -> DataFrame:
    """``one`` over the rows of each group, in order, as NumPy columns; it gives columns (scalars are repeated) or None.

    A grouped-map function costs an Arrow batch per group.  Here groups are
    shuffled and sorted by Spark and stream through in batches of many; a
    group that spans batches is held until it is whole.
    """
    names = _names(schema)
    columns = df.columns

    def cut(b: pd.DataFrame, ends: np.ndarray) -> pd.DataFrame:
        arrays = {c: b[c].to_numpy() for c in columns}
        out: dict[str, list] = {n: [] for n in names}
        for i, j in zip(ends[:-1].tolist(), ends[1:].tolist()):
            made = one({c: a[i:j] for c, a in arrays.items()})
            if made is None:
                continue
            n = max((len(v) for v in made.values() if isinstance(v, (list, np.ndarray))), default=1)
            for k in names:
                v = made[k]
                out[k].extend(v.tolist() if isinstance(v, np.ndarray) and v.ndim == 1 else list(v) if isinstance(v, (list, np.ndarray)) else [v] * n)
        return pd.DataFrame(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            same = np.ones(len(b), bool)
            for k in keys:
                v = b[k].to_numpy()
                same &= v == v[-1]
            start = len(b) - int(np.argmin(same[::-1])) if not same.all() else 0
            if start == 0 and held and all(held[-1][k].iloc[-1] == b[k].iloc[0] for k in keys):
                held.append(b)
                continue
            whole = pd.concat([*held, b.iloc[:start]], ignore_index=True) if held else b.iloc[:start]
            held = [b.iloc[start:]]
            yield from made_of(whole)
        if held:
            yield from made_of(pd.concat(held, ignore_index=True))

    def made_of(whole: pd.DataFrame) -> Iterator[pd.DataFrame]:
        made = cut(whole, _ends(whole)) if len(whole) else whole
        if len(made):  # empty columns have no type
            yield made

    def _ends(b: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(b), bool)
        change[0] = True
        for k in keys:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), len(b))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


def _names(schema: str) -> list[str]:
    """Column names of a schema string."""
    out, depth, word = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out

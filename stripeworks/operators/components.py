"""Connected components of an edge table.

Alternates the two star contractions of Kiveris et al. ("Connected Components
in MapReduce and Beyond", 2014): every vertex hands its larger neighbours,
then its smaller ones, to the smallest vertex it knows.  Edges never outgrow
the input, no vertex gathers its neighbours in memory, and the rounds grow
with the logarithm of the size, not with the longest path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    return both.filter("v > u").join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` with u > v."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    kept = edges.join(least, F.col("u") == F.col("c")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))


def components(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame], drop: Callable[[DataFrame], None], most_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``component`` (its smallest vertex) for every vertex of ``edges(u, v)``.

    Vertices are of any one ordered type; loops and repeated edges are
    harmless; a vertex without an edge to another is not in the result.
    ``cut`` stores a table where all executors can read it, ``drop`` forgets one.
    """
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        large = cut(_large_star(now).filter("u <> v").distinct(), "large-star")
        new = cut(_small_star(large).filter("u <> v").distinct(), "small-star")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        drop(large)
        now = new
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))

"""Helpers shared by the corpus operators: lineage cuts, local bindings, ranks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..storage import cut, discard

__all__ = ["CELLS", "GAP", "SPACE", "UPPER", "WORD", "bits_of", "cut", "discard", "give_back", "let", "map_texts", "n_words_of", "sheltered", "with_bit", "with_rank", "words_of"]

#: The white space of all contracts: space and the five controls from tab to carriage return.
SPACE = " \t\n\x0b\f\r"
#: A word is a run of anything else (Java regular expression).
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Ranks are dealt over this many cells a group; it is fixed so that reruns on other clusters agree.
CELLS = 1021


#: Bits of a filter, in rows of as many as Spark's bitmaps have; it is fixed, so what is broadcast (4 MB of bits) does not grow with the keys.
FILTER_BITS, ROW_BITS = 1 << 25, 1 << 15


def bits_of(keys: DataFrame, *columns: str) -> DataFrame:
    """A filter over the hashes of ``columns``, for ``with_bit``: two keys may share a bit, none goes without."""
    bit = keys.select(F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).alias("b"))
    at = (F.col("b") % ROW_BITS).cast("long")
    return bit.groupBy(F.floor(F.col("b") / ROW_BITS).cast("long").alias("__part")).agg(F.bitmap_construct_agg(at).alias("__bits"))


def with_bit(df: DataFrame, bits: DataFrame, *columns: str) -> DataFrame:
    """Add ``__bit``: false if no key of ``bits`` has the values of ``columns`` (null equals null); true if one has, or at times by chance."""
    bit = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    marked = df.withColumn("__part0", F.floor(bit / ROW_BITS).cast("long")).withColumn("__at", (bit % ROW_BITS).cast("int"))
    joined = marked.join(F.broadcast(bits), F.col("__part0") == F.col("__part"), "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, __at div 8 + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.getbit(byte, F.col("__at") % 8) == 1, F.lit(False))
    return joined.withColumn("__bit", is_set).drop("__part0", "__at", "__part", "__bits")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, even where the optimizer would copy it into a lambda."""
    return F.transform(F.array(value), body)[0]


def sheltered(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose own columns (``__...``) can't clash with the input's: those go by other names meanwhile."""
    @functools.wraps(operator)
    def run(docs: DataFrame, *how, **named) -> DataFrame:
        away = {c: f"input {c}" for c in docs.columns if c.startswith("__")}
        out = operator(docs.withColumnsRenamed(away), *how, **named)
        return out.withColumnsRenamed({v: k for k, v in away.items()})

    return run


def words_of(text: Column) -> Column:
    """The words of a text (null: none)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, GAP))


def n_words_of(text: Column) -> Column:
    """How many words a text has (null: 0), without keeping them."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, GAP))).cast("long")


#: Rows of a batch that are Python objects at a time.
SLICE = 512


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task should be small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not a GNU system


def map_texts(docs: DataFrame, id_col: str, text: str, work: Callable, fields: str) -> DataFrame:
    """``work`` over pandas frames of ``doc_id`` and ``t``, giving ``doc_id`` and ``fields``.

    Ids travel as text, as pandas has no exact integers beside nulls.  Batches
    stay in Arrow and become objects a slice at a time.
    """
    kind = docs.schema[id_col].dataType
    out = T._parse_datatype_string(f"doc_id string, {fields}")
    schema = to_arrow_schema(out)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        frames = (b.slice(at, SLICE).to_pandas() for b in batches for at in range(0, b.num_rows, SLICE))
        for made in work(frames):
            yield pa.RecordBatch.from_pandas(made, schema=schema, preserve_index=False)
        give_back()

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, out)
    return rows.withColumn("doc_id", F.col("doc_id").cast(kind))


def with_rank(df: DataFrame, group: Sequence[str], order: Sequence[str], cell: Column, into: str) -> DataFrame:
    """Add the 0-based rank of each row within ``group``, by ``cell``, then ``order``.

    Rows are numbered within the cells of a group and then shifted by what the
    earlier cells hold, so no task ever holds a whole group; only the counts
    of a group's cells meet in one window.  ``cell`` gives a bounded number of
    integers.  Groups and cells may be null.
    """
    df = df.withColumn("__cell", cell.cast("long"))
    keys = [*group, "__cell"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"),
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    numbered = df.withColumn("__within", within)
    same = None
    for i, k in enumerate(keys):
        one = numbered[k].eqNullSafe(shift[f"__k{i}"])
        same = one if same is None else same & one
    return (
        numbered.join(shift, same)
        .withColumn(into, F.col("__within") + F.col("__shift"))
        .drop("__cell", "__within", "__shift", *[f"__k{i}" for i in range(len(keys))])
    )

"""Quality rules: a table of thresholds compiled into one projection.

Every metric is a Column over the text, every rule a row of ``RULES``; the
verdict is their conjunction.  No user function, no shuffle.

Texts of any length are judged whole, by ratios: there is no upper bound on
words.  Repeated rows are judged alike, an empty table gives an empty result.
Repeats are found by 64-bit hashes: windows by the hash of their words' hashes,
so two windows of one text would have to collide to be miscounted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, let, sheltered, words_of

SYMBOLS = "#*$%&|<>"
#: The languages that ``STOP_WORDS`` serves.
SERVED = ("en", "de", "fr", "es")
#: Frequent short words of the languages served.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they be at this have from or by an not but what all were when there a he she you we do if will "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei um noch wie "
    "le la les de des et un une du en est que qui dans pour pas sur au par plus il elle ce se son avec ne sont ou "
    "el los las y en del que es por con para una su al lo como más pero sus o este se no"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= metric <= high, or if its words number fewer than ``from_words`` or more than ``to_words``, or if its language isn't among ``langs`` (where given)."""

    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    to_words: int | None = None
    langs: tuple[str, ...] = ()


#: Ratios are per word (symbols, shouts, stop words) or per line.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_ratio", high=0.30),
    Rule("symbol_ratio", high=0.10),
    Rule("mean_word_length", low=2.0, high=14.0),
    Rule("shout_ratio", high=0.40),
    Rule("stop_word_ratio", low=0.01, from_words=100, langs=SERVED),
    Rule("distinct_ratio", low=0.40, to_words=2_000),
    Rule("dup_line_ratio", high=0.50),
    Rule("ellipsis_line_ratio", high=0.30),
    Rule("bullet_line_ratio", high=0.90, from_words=50),
)


def _repeat_words(hashes: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, first occurrence included.

    Windows are compared by the hash of their words' hashes.  Only a text in
    which some window repeats pays for the sort that finds where.
    """
    def covered(places: Column) -> Column:
        step = F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("end")),
            lambda acc, p: F.struct((acc.n + F.least(F.lit(WINDOW), p + WINDOW - acc.end)).alias("n"), (p + WINDOW).alias("end")),
            lambda acc: acc.n,
        )
        return step

    def located(ranked: Column) -> Column:
        last = F.size(ranked) - 1
        alike = F.transform(
            ranked,
            lambda x, i: F.when(
                ((i > 0) & (x.h == ranked[F.greatest(i - 1, F.lit(0))].h)) | ((i < last) & (x.h == ranked[F.least(i + 1, last)].h)), x.p
            ),
        )
        return covered(F.array_sort(F.filter(alike, lambda p: p.isNotNull())))

    def judged(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ranked, located))

    last = F.size(hashes) - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[hashes[i + k] for k in range(WINDOW)]))
    return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(windows, judged))


def metrics(text: Column) -> dict[str, Column]:
    """All metrics of a text, as one struct's fields: counts first, then ratios."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.split(whole, "\n")
    full = F.filter(lines, lambda x: F.btrim(x, F.lit(SPACE)) != "")

    known = [F.xxhash64(F.lit(x)) for w in STOP_WORDS for x in dict.fromkeys((w, w.capitalize()))]

    def of_words(w: Column) -> Column:
        shout = F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) > 1))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(shout).alias("n_shout"),
            let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes).alias("h"),
        )

    def of_hashes(h: Column) -> Column:
        return F.struct(
            _repeat_words(h).alias("n_repeat_words"),
            F.size(F.array_distinct(h)).alias("n_distinct"),
            F.size(F.filter(h, lambda x: x.isin(known))).alias("n_stop"),
        )

    def of_lines(x: Column) -> Column:
        ellipsis = F.filter(x, lambda y: F.rtrim(y).endswith("...") | F.rtrim(y).endswith("…"))
        bullet = F.filter(x, lambda y: F.substring(F.ltrim(y), 1, 1).isin("-", "*", "•"))
        return F.struct(
            F.size(x).alias("n_full_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(ellipsis).alias("n_ellipsis"),
            F.size(bullet).alias("n_bullet"),
        )

    return {
        "__w": let(words_of(text), of_words),
        "__l": let(full, of_lines),
        "word_chars": F.length(F.translate(whole, SPACE, "")).cast("long"),
        "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
    }


def _ratio(top: str, below: str) -> Column:
    return F.when(F.col(below) == 0, F.lit(0.0)).otherwise(F.col(top) / F.col(below))


@sheltered
def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str = "lang") -> DataFrame:
    """``docs`` plus the metrics, ``base_failed`` and ``kept``.

    A null or blank text has no words: it fails the length rule.  Columns of
    these names that ``docs`` already has are replaced.  Rules for some
    languages judge rows whose ``lang`` is one of them; where it is null, or
    ``docs`` has no such column, they judge nothing.
    """
    made = metrics(F.col(text))
    names = ["n_words", "n_repeat_words", "n_shout", "n_stop", "n_distinct", "n_full_lines", "n_dup_lines", "n_ellipsis", "n_bullet", "word_chars", "n_symbols"]
    ratios = {
        "symbol_ratio": ("n_symbols", "n_words"),
        "mean_word_length": ("word_chars", "n_words"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "stop_word_ratio": ("n_stop", "n_words"),
        "distinct_ratio": ("n_distinct", "n_words"),
        "shout_ratio": ("n_shout", "n_words"),
        "dup_line_ratio": ("n_dup_lines", "n_full_lines"),
        "ellipsis_line_ratio": ("n_ellipsis", "n_full_lines"),
        "bullet_line_ratio": ("n_bullet", "n_full_lines"),
    }
    df = docs.drop(*[c for c in docs.columns if c in {*names, *ratios, "base_failed", "kept"} and c != text])
    df = df.withColumns(made)
    df = df.select("*", "__w.n_words", "__w.n_shout", "__w.h.*", "__l.*").drop("__w", "__l").withColumns({k: _ratio(*v) for k, v in ratios.items()})
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = F.lit(True)
    for r in rules:
        ok = F.lit(True)
        if r.low is not None:
            ok = ok & (F.col(r.metric) >= r.low)
        if r.high is not None:
            ok = ok & (F.col(r.metric) <= r.high)
        if r.from_words:
            ok = ok | (F.col("n_words") < r.from_words)
        if r.to_words is not None:
            ok = ok | (F.col("n_words") > r.to_words)
        if r.langs:
            ok = ok | ~F.coalesce(F.col(lang).isin(*r.langs), F.lit(False)) if lang in docs.columns else F.lit(True)
        passed = passed & ok
    return df.withColumn("base_failed", base).withColumn("kept", ~base & passed)

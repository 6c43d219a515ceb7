"""Host reputation by empirical Bayes, behind a table of host and path rules.

Labelled page outcomes are counted by host, registered domain and suffix.
Each level's rate is shrunk towards its parent's by a beta prior.  What the
prior is worth is fitted to the spread of a level's rates around their
parents' (analysis of variance of the beta-binomial, degrees of freedom
counted); it is ``LIGHTEST`` where no parent has two labelled children, and
never over ``HEAVIEST``, as the spread itself is an estimate.  A parent's rate
leaves out the child that it is the prior of, so no label counts twice.

A host is allowed if the lower bound of its posterior is high enough.  The
posterior's variance is that of its beta distribution plus what the parents'
rates are uncertain by; the bound is its normal approximation on the scale of
log odds.  So a host without labels inherits its domain's rate, but not the
certainty of a host with many.

Null urls and urls without a host are the host ``""``; texts of any length are
cut by expressions, not by user functions; repeated pages count as often as
they come; empty tables give empty results; input columns other than those
named are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, cut

#: (verdict, host, path); the longest host and path that fit decide.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za")
MIN_GOOD, Z, PRIOR_RATE, LIGHTEST, HEAVIEST = 0.6, 1.645, 0.5, 2.0, 20.0


def host_of(url: Column) -> Column:
    """The host of a url, A-Z in lower case; null or without ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def registered_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The last two labels of a host, or three under ``suffixes`` of two; shorter hosts and addresses are their own."""
    labels = F.split(host, "\\.")
    two = F.substring_index(host, ".", -2)
    named = F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when((F.size(labels) < 2) | host.rlike("^[0-9.]+$"), host).otherwise(named)


def suffix_of(domain: Column) -> Column:
    cut_off = F.substring(domain, F.locate(".", domain) + 1, F.length(domain))
    return F.when((F.locate(".", domain) == 0) | domain.rlike("^[0-9.]+$"), domain).otherwise(cut_off)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule's text and its verdict, or nulls."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, F.lit(h + p)).otherwise(which), F.when(fits, F.lit(said)).otherwise(verdict)
    return which, verdict


def _weight(children: DataFrame, n: str, s: str) -> float:
    """How many observations the prior of ``children`` is worth: they have counts ``n`` and ``s`` and their parent's rate ``m``, count ``pn`` and children ``k``."""
    over = lambda a, b: a / F.nullif(b.cast("double"), F.lit(0.0))
    p, size = F.col(s) / F.col(n), F.col(n)
    between, within = F.sum(size * F.pow(p - F.col("m"), 2.0)), F.sum(F.col(s) * (1 - p))
    df_between, df_within = F.sum(1 - over(F.lit(1.0), F.col("k"))), F.sum(size - 1)
    typical = F.sum(size - over(size * size, F.col("pn")))
    made = children.agg(between.alias("b"), within.alias("w"), df_between.alias("db"), df_within.alias("dw"), typical.alias("t"))
    msb, msw = over(F.col("b"), F.col("db")), over(F.col("w"), F.col("dw"))
    rho = over(msb - msw, msb + (over(F.col("t"), F.col("db")) - 1) * msw)
    worth = F.when(rho > 0, 1 / rho - 1).otherwise(HEAVIEST)
    known = (F.col("db") > 0.5) & (F.col("dw") > 0)
    return made.select(F.when(known, F.round(F.least(F.greatest(worth, F.lit(LIGHTEST)), F.lit(HEAVIEST)), 6)).otherwise(LIGHTEST)).first()[0]


def reputation(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per host of ``pages``: ``host, domain, suffix, n_labelled, n_good, rate, bound``.

    ``outcomes`` has ``page_id`` and a boolean ``good``; pages without a label, nulls and unknown ids add nothing.  Without any label the
    rate is ``PRIOR_RATE`` everywhere.  ``suffixes`` are those of two labels under which names are registered.
    """
    host = host_of(F.col(url))
    named = lambda df: df.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("domain")))
    seen = pages.select(F.col(page_id).alias("page_id"), host.alias("host")).join(outcomes.filter("good is not null").select("page_id", "good"), "page_id")
    level = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("s"))
    hosts = cut(named(level), "host-outcomes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("s").alias("ds"), F.count(F.lit(1)).alias("dk"))
    above = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("ds").alias("ss"), F.count(F.lit(1)).alias("sk"))
    top = above.agg(F.sum("sn").alias("n"), F.sum("ss").alias("s"), F.count(F.lit(1)).alias("k")).first()
    base = top.s / top.n if top.n else PRIOR_RATE
    wh = _weight(hosts.join(domains.select("domain", (F.col("ds") / F.col("dn")).alias("m"), F.col("dn").alias("pn"), F.col("dk").alias("k")), "domain"), "n", "s")
    wd = _weight(domains.join(above.select("suffix", (F.col("ss") / F.col("sn")).alias("m"), F.col("sn").alias("pn"), F.col("sk").alias("k")), "suffix"), "dn", "ds")
    ws = _weight(above.select("sn", "ss", F.lit(base).alias("m"), F.lit(top.n).cast("long").alias("pn"), F.lit(top.k).alias("k")), "sn", "ss")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    every = named(pages.select(host.alias("host")).distinct())
    own = every.join(hosts.select("host", "n", "s"), "host", "left").join(domains.select("domain", "dn", "ds"), "domain", "left").join(above.select("suffix", "sn", "ss"), "suffix", "left")

    def level_of(df: DataFrame, good: Column, n: Column, worth: float, above: str | float, into: str) -> DataFrame:
        """Rate and variance of one level from its counts and its parent's rate and variance."""
        parent, unsure = (F.col(above), F.col(f"{above}_v")) if isinstance(above, str) else (F.lit(above), F.lit(0.0))
        df = df.withColumn(into, (good + worth * parent) / (n + worth))
        return df.withColumn(f"{into}_v", F.col(into) * (1 - F.col(into)) / (n + worth + 1) + F.pow(worth / (n + worth), 2.0) * unsure)

    own = level_of(own, zero("ss") - zero("ds"), zero("sn") - zero("dn"), ws, float(base), "__s")
    own = level_of(own, zero("ds") - zero("s"), zero("dn") - zero("n"), wd, "__s", "__d")
    own = level_of(own, zero("s"), zero("n"), wh, "__d", "__h")
    r = F.least(F.greatest(F.col("__h"), F.lit(1e-6)), F.lit(1 - 1e-6))
    bound = 1 / (1 + F.exp(Z * F.sqrt("__h_v") / (r * (1 - r)) - F.log(r / (1 - r))))
    return own.select("host", "domain", "suffix", zero("n").cast("long").alias("n_labelled"), zero("s").cast("long").alias("n_good"), F.round("__h", 6).alias("rate"), F.round(bound, 6).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, url: str = "url", page_id: str = "page_id", rules: tuple = RULES, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's ``rate`` and ``bound``, for every row of ``pages``.

    Repeated rows are judged alike and stay; a null url has an empty host,
    which is a host like any other; only the columns named are read.
    """
    # Stored, so that the join below stands on its own: the pages of a host that has a third of them can then be split.
    known = cut(reputation(pages, outcomes, url, page_id, suffixes).select(F.col("host").alias("__host"), "rate", "bound"), "reputation")
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    which, said = rule_for(F.col("host"), F.col("path"), rules)
    fallback = F.when(F.col("bound") >= min_good, F.lit("allow")).otherwise(F.lit("block"))
    joined = own.join(known, F.col("host") == F.col("__host"), "left")
    return joined.select("page_id", "host", "path", which.alias("rule"), F.coalesce(said, fallback).alias("verdict"), "rate", "bound")

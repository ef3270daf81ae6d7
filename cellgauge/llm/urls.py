"""URL filters: host reputations from labelled pages, shrunk through beta-binomial priors.

The rate of bad pages of a host is drawn towards the rate of its registered
domain, that towards the rate of its suffix, and that towards the rate of all
labelled pages. How strongly a level follows the one above is fitted to the
data by moments. A page is blocked when a low quantile of its host's posterior,
a beta distribution, lies above a limit; rules of the caller come first.

Only DataFrame functions are used. Labels are summed per host before anything
is shuffled; reputations are one row per host and meet the pages in one
equi-join, which adaptive execution splits where a host is hot.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgauge.session import stage

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path prefix)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Second-level names under which countries register domains (co.uk, com.au, ...)
COUNTRY_SECOND = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def suffix_labels(host: Column) -> tuple[Column, Column]:
    """The labels of the host's name and how many of them are its suffix.

    The suffix is the last label, or the last two of ``x.co.uk`` and the like:
    a two-letter last label behind one of ``COUNTRY_SECOND``. User, port and
    final dots are no part of the name.
    """
    labels = F.split(F.regexp_replace(host, r"(?s)^.*@|\.*(:[0-9]*)?\z", ""), r"\.")
    country = (F.size(labels) > 1) & F.regexp_like(F.element_at(labels, -1), F.lit("^[a-z][a-z]$")) & F.get(labels, F.size(labels) - 2).isin(*COUNTRY_SECOND)
    return labels, F.when(country, 2).otherwise(1)


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain (one label before the suffix, if there is one) and suffix. A dotted number is its own domain."""
    labels, n = suffix_labels(host)

    def last(k: Column) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k), ".")

    number = F.array_join(labels, ".").rlike(r"^[0-9]+(\.[0-9]+){3}$")
    return F.when(number, F.array_join(labels, ".")).otherwise(last(n + 1)), F.when(number, F.lit("")).otherwise(last(n))


def share_above(a: Column, b: Column, limit: float, steps: int = 128, widths: float = 14.0) -> Column:
    """P(rate > limit) under Beta(a, b): Simpson's rule on the log-odds, on either side of the limit.

    The density of the log-odds has one peak at log(a/b), is as wide as its
    curvature there says, and has tails that fall by a and b. Both sides are
    integrated as far as ``widths`` times that, so nothing has to be normalised.
    """
    peak, spread = F.log(a / b), F.sqrt(1 / a + 1 / b)
    low, high = peak - widths * (spread + 1 / a), peak + widths * (spread + 1 / b)
    cut = F.least(F.greatest(F.lit(math.log(limit / (1 - limit))), low), high)

    def height(u: Column) -> Column:
        return a * u - (a + b) * (F.greatest(u, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(u))))

    def area(start: Column, end: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            weight = F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * F.exp(height(start + (end - start) * i / steps) - height(peak))

        return (end - start) * F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), add)

    below, above = area(low, cut), area(cut, high)
    return above / (below + above)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does. Equal lengths: the first in text order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shrunk(children: DataFrame, parents: DataFrame, parent_key: str, out: str) -> DataFrame:
    """Posterior mean ``out`` and the strength of the prior for each child.

    ``children`` has n and k, ``parents`` has ``mean``. The intra-class
    correlation comes from the moments of all children with labels.
    """
    joined = children.join(parents, parent_key, "left")
    n, k, mean = F.col("n"), F.col("k"), F.col("mean")
    spread = joined.filter("n > 0").agg(
        F.sum(n * (k / n - mean) * (k / n - mean)).alias("seen"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(mean * (1 - mean) * (n - 1)).alias("room"),
    ).select(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.coalesce(F.try_divide(F.col("seen") - F.col("noise"), F.col("room")), F.lit(0.001)))).alias("rho"))
    fitted = joined.withColumn("strength", spread.select((1 / F.col("rho") - 1).alias("strength")).scalar())
    return fitted.withColumn(out, (k + F.col("strength") * mean) / (n + F.col("strength"))).drop("mean")


def host_reputations(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", bad: str = "bad") -> DataFrame:
    """One row per host of ``pages``: host, n, k, the posterior mean, and the posterior's parameters bad_a and bad_b.

    ``outcomes`` has (key, bad) of labelled pages; bad is 0 or 1. Null keys and
    null outcomes count as unlabelled; a page labelled twice counts twice. A
    host without labels takes its domain's rate, a domain without labels its
    suffix's. Without any label all rates are 0.5. The empty host is a host of
    its own. Domains and suffixes: see ``registered``. Each level is written
    once, since its rows and its moments are both read.
    """
    seen = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"))
    told = outcomes.select(F.col(key).alias("_key"), F.col(bad).cast("long").alias("_bad")).filter("_bad is not null")
    hosts = seen.join(told, "_key", "left").groupBy("host").agg(F.count("_bad").alias("n"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("host"))
    hosts = stage(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stage(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    suffixes = stage(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1)), "suffixes")
    whole = suffixes.groupBy("all").agg(((F.sum("k") + 0.5) / (F.sum("n") + 1.0)).alias("mean"))
    suffix_rate = stage(_shrunk(suffixes, whole, "all", "rate").select("suffix", F.col("rate").alias("mean")), "suffix-rates")
    domain_rate = stage(_shrunk(domains, suffix_rate, "suffix", "rate").select("domain", F.col("rate").alias("mean")), "domain-rates")
    rated = _shrunk(hosts, domain_rate, "domain", "rate")
    weight = F.col("n") + F.col("strength")
    return rated.select("host", "n", "k", F.col("rate").alias("bad_rate"), (F.col("rate") * weight).alias("bad_a"), ((1 - F.col("rate")) * weight).alias("bad_b"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = 0.5, doubt: float = 0.05,
               url: str = "url", key: str = "page_id", bad: str = "bad") -> DataFrame:
    """All rows of ``pages`` with host, path, rule, bad_rate, bad_share and verdict.

    The verdict is the longest fitting rule's, else block where the ``doubt``
    quantile of the posterior rate of bad pages lies above ``limit``, that is
    where bad_share, the posterior's share above ``limit``, exceeds 1 - ``doubt``.
    Columns of ``pages`` with these names are replaced. Null or malformed urls
    have empty host and path. Repeated rows are judged each.
    """
    made = ("host", "path", "rule", "bad_rate", "bad_share", "verdict")
    base = pages.drop(*made).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    known = host_reputations(pages, outcomes, url, key, bad).select("host", "bad_rate", share_above(F.col("bad_a"), F.col("bad_b"), limit).alias("bad_share"))
    known = stage(known, "reputations")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    judged = base.join(known, "host", "left")
    own = F.when(F.col("bad_share") > 1 - doubt, "block").otherwise("allow")
    return judged.select(*[c for c in base.columns if c not in ("host", "path")], "host", "path", rule.alias("rule"), "bad_rate", "bad_share", F.coalesce(said, own).alias("verdict"))

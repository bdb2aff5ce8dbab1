"""URL filters: fixed rules, and host reputation by empirical Bayes, with DataFrame operations only.

Labelled page outcomes are counted per host, registered domain and suffix. At each level the bad rate
has a beta prior whose mean is the posterior mean one level up and whose strength comes from the data:
the spread of the level's own rates beyond what binomial noise explains. A host with few labels so
stays near its domain, one with many speaks for itself. A host is blocked if the lower bound of its
posterior bad rate is above a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import lookup, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# (verdict, host, path): for the host and its subdomains, if the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Longer lists belong in a table.
MAX_RULES = 1000

# Block where the bad rate is above this with a probability of about 95 %.
BAD_RATE = 0.5
Z = 1.645
# Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1e6


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(F.col(url), start + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. Equally long ones: the first in order."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    found = []
    for verdict, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found.append(F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")
    return best["rule"], best["verdict"]


def strength(rates: DataFrame) -> float:
    """Strength of the beta prior that rows (n, k, mean) were drawn around, by moments.

    The expected square of k - n * mean is n * v * (1 + (n - 1) / (strength + 1)) with
    v = mean * (1 - mean). Without excess spread the prior is as strong as may be.
    """
    v = F.col("mean") * (1 - F.col("mean"))
    excess = F.pow(F.col("k") - F.col("n") * F.col("mean"), 2) / F.col("n") - v
    sums = [F.sum(c.cast("decimal(38,9)")).cast("double") for c in (excess, v * (F.col("n") - 1))]
    top, bottom = rates.where("n > 0").agg(*sums).first()
    if not top or not bottom or top <= 0:
        return STRONGEST
    return min(max(bottom / top - 1, WEAKEST), STRONGEST)


def reputation(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, domain, suffix, n, k, ...) with the posterior of the bad rate: mean, bound."""
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    above, levels = F.lit((k + 1) / (n + 2)), []
    for level in ("suffix", "domain", "host"):
        keys = ["suffix", "domain", "host"][: len(levels) + 1]
        counted = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if levels:
            parent = levels[-1].select(*keys[:-1], F.col("posterior").alias("mean"))
            rates = counted.join(parent, keys[:-1])
        else:
            rates = counted.withColumn("mean", above)
        rates = stored(rates, f"{level}-rates", True)
        size = strength(rates)
        weight = F.col("n") + size
        posterior = (F.col("k") + size * F.col("mean")) / weight
        levels.append(rates.withColumns({"posterior": posterior, "weight": weight}))
    own = levels[-1].withColumnRenamed("posterior", "bad_rate")
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("weight") + 1))
    bound = F.greatest(F.col("bad_rate") - Z * spread, F.lit(0.0))
    return own.select("host", "domain", "suffix", "n", "k", "bad_rate", bound.alias("bound"))


def _last_labels(count: int) -> Column:
    return F.substring_index("host", ".", -count)


def judged(
    pages: DataFrame,
    outcomes: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple = RULES,
    bad_rate: float = BAD_RATE,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, bad_rate, bound.

    ``outcomes`` has (id, bad) rows: labelled pages; several of one id count as bad if one is. The
    registered domain is the last two labels of the host, the suffix the last one. Urls without a
    host share the empty host. Null ids have no outcome. Repeated rows are judged, and counted, each.
    """
    host, path = url_parts(url_col)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parts = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    rows = stored(parts.select("*", rule.alias("rule"), verdict.alias("by_rule")), "urls")
    known = outcomes.groupBy(F.col("id").alias("page")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = rows.select("page", "host").join(known, "page", "left").groupBy("host").agg(
        F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")
    )
    levels = {"domain": _last_labels(2), "suffix": _last_labels(1)}
    hosts = stored(counted.withColumns(levels), "hosts", True)
    ranked = reputation(hosts).join(hosts.select("host", "pages"), "host")
    found = lookup(rows, stored(ranked.select("host", "pages", "bad_rate", "bound"), "reputation", True), "host", "pages")
    own = F.when(F.col("bound") > bad_rate, "block").otherwise("allow")
    return found.select(
        F.col("page").alias(id_col), "host", "path", "rule",
        F.coalesce("by_rule", own).alias("verdict"), "bad_rate", "bound",
    )


def page_outcomes(labels: DataFrame) -> DataFrame:
    """The given labels as outcomes of the pages of the same ids: toxic or poor ones are bad."""
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))
    return labels.select(F.col("doc_id").alias("id"), bad.alias("bad"))

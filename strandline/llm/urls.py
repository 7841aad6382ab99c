"""URL filters: rules by host and path, else empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each
level's share of bad pages has a beta prior around the share of the level above
(suffix under the whole corpus, domain under suffix, host under domain), whose
weight is estimated from the outcomes: the more the groups of a level differ
beyond chance, the less the level above counts. A page without a rule is blocked
if the lower bound of its host's posterior is above the limit; a host without
outcomes falls back to its domain's bound, and then to its suffix's. All of it
is column expressions and pre-aggregated joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, small

#: Rules of the contract: host, path prefix, verdict. Fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Second labels below which names are registered, under suffixes of two letters. Fixed values.
SECOND_LABELS = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "net", "org")
#: The weight of the level above, in pages, at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def site_of(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$|\.(?=:[0-9]*$)", "")


def suffix_of(site: Column) -> Column:
    """The last label; the last two where names are registered below both, as in co.uk."""
    below = F.substring_index(F.substring_index(site, ".", -2), ".", 1)
    two = (F.length(F.substring_index(site, ".", -1)) == 2) & below.isin(*SECOND_LABELS) & (F.size(F.split(site, r"\.")) > 2)
    return F.when(two, F.substring_index(site, ".", -2)).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    return F.when(F.locate(".", suffix) > 0, F.substring_index(site, ".", -3)).otherwise(F.substring_index(site, ".", -2))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (as host and path) and its verdict; null if none."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shrunk(groups: DataFrame, z: float) -> DataFrame:
    """groups (name, n, bad, prior: the share of the level above) with share (posterior mean) and bound (mean less z standard deviations).

    The weight of the prior comes from moments: under a beta-binomial law the
    squared surplus of a group's bad pages is n p (1 - p) (1 + (n - 1) r) on
    average, and the weight is (1 - r) / r.
    """
    p, chance = F.col("prior"), F.col("n") * F.col("prior") * (1 - F.col("prior"))
    beyond = F.sum(F.pow(F.col("bad") - F.col("n") * p, 2) - chance)
    r = F.coalesce(beyond / F.nullif(F.sum((F.col("n") - 1) * chance), F.lit(0.0)), F.lit(0.0))
    r = F.least(F.greatest(r, F.lit(1 / (1 + MOST_WEIGHT))), F.lit(1 / (1 + LEAST_WEIGHT)))
    weight = groups.agg(r.alias("r")).select(((1 - F.col("r")) / F.col("r")).alias("weight"))
    a, b = F.col("bad") + F.col("weight") * p, F.col("n") - F.col("bad") + F.col("weight") * (1 - p)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return groups.crossJoin(F.broadcast(weight)).select(*groups.columns, (a / (a + b)).alias("share"), (a / (a + b) - z * sd).alias("bound"))  # one row


def reputations(outcomes: DataFrame, z: float = 1.645) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables of name, n, bad, prior, share, bound: hosts, registered domains and suffixes of outcomes (site, bad). Null outcomes are left out."""
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("site").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("site")))
    hosts = checkpoint(hosts.withColumn("domain", domain_of(F.col("site"), F.col("suffix"))))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    every = hosts.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))
    suffixes = hosts.groupBy("suffix").agg(*sums).crossJoin(F.broadcast(every))  # one row
    suffixes = checkpoint(shrunk(suffixes.withColumnRenamed("suffix", "name"), z))
    above = suffixes.select(F.col("name").alias("suffix"), F.col("share").alias("prior"))
    domains = checkpoint(shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix").select(F.col("domain").alias("name"), "n", "bad", "prior"), z))
    above = domains.select(F.col("name").alias("domain"), F.col("share").alias("prior"))
    hosts = checkpoint(shrunk(hosts.join(above, "domain").select(F.col("site").alias("name"), "n", "bad", "prior"), z))
    return hosts, domains, suffixes


def judge_urls(pages: DataFrame, outcomes: DataFrame | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, limit: float = 0.5, z: float = 1.645) -> DataFrame:
    """page_id, url, host, path, rule, verdict, reputation for every page.

    outcomes has page_id and bad (boolean or 0/1); a page labelled twice is bad
    if either says so, and null ids or outcomes are left out. Without outcomes
    for a page's host, domain or suffix its verdict is allow. A null url, or one
    without ://, has an empty host and path and is allowed. Very long urls are
    judged whole; repeated rows are judged row by row; an empty table gives no
    rows. Other columns, whatever their names, are dropped.
    """
    seen = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("said", verdict)
    if outcomes is None:
        return seen.select("page_id", "url", "host", "path", "rule", F.coalesce("said", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("reputation"))
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    seen = seen.withColumn("site", site_of(F.col("host")))
    labelled = seen.where("site <> ''").select("page_id", "site").join(known, "page_id").select("site", "bad")
    sites = seen.select("site").where("site <> ''").distinct().withColumn("suffix", suffix_of(F.col("site")))
    sites = sites.withColumn("domain", domain_of(F.col("site"), F.col("suffix")))
    for level, table in zip(("site", "domain", "suffix"), reputations(labelled, z), strict=True):
        sites = sites.join(small(table.select(F.col("name").alias(level), F.col("bound").alias(f"by_{level}"))), level, "left")
    sites = checkpoint(sites.select(F.col("site").alias("of"), F.coalesce("by_site", "by_domain", "by_suffix").alias("reputation")))
    out = seen.join(small(sites), seen["site"] == sites["of"], "left")
    judged = F.coalesce("said", F.when(F.col("reputation") > limit, "block").otherwise("allow"))
    return out.select("page_id", "url", "host", "path", "rule", judged.alias("verdict"), "reputation")

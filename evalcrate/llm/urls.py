"""Operator 6: URL filter with rules and empirical-Bayes host reputation.

A url is judged by the longest rule that fits it, else by its host's reputation:
the share of bad outcomes among labelled pages (by default the pages the rules
judge: block is bad, allow is good), shrunk through beta-binomial priors from
public suffix to registered domain to host.  The strength of each level's prior
is estimated from the labelled groups themselves (their intraclass correlation),
and a host is blocked when the lower posterior bound, ``z`` standard deviations
below the mean, is above ``threshold``; a host without evidence stays allowed
unless its parents' prior says otherwise.

Only host counts are joined back to the pages; the counts are partial sums, so a
host with a third of all pages adds one row a task.

Edge cases: a null url or one without ``://`` has host and path empty and is
judged by the prior alone; repeated rows count as often as they occur; an empty
table gives no rows; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the rules of the contract (verdict, host, path prefix)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# fixed values: second-level names that belong to the suffix below a two-letter country name
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (null where none does)."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def with_parents(df: DataFrame) -> DataFrame:
    """Add ``domain`` (registered domain) and ``suffix`` of ``host``."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    second = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    k = F.when(second, F.lit(2)).otherwise(F.lit(1))

    def tail(m):
        return F.when(n >= m, F.array_join(F.slice(parts, n - m + 1, m), ".")).otherwise(F.col("host"))
    return df.withColumn("suffix", tail(k)).withColumn("domain", tail(k + 1))


def _strength(groups: DataFrame) -> DataFrame:
    """One row ``m``: prior strength from the intraclass correlation of labelled groups (n, bad)."""
    g = groups.where("n > 0")
    s = g.agg(F.sum("n").cast("double").alias("N"), F.sum("bad").cast("double").alias("K"),
              F.count("*").cast("double").alias("G"), F.sum(F.col("n") * F.col("n")).cast("double").alias("N2"),
              F.sum(F.col("bad").cast("decimal(38,12)") * F.col("bad") / F.col("n")).cast("double").alias("Q"))
    p = F.expr("K / N")
    return s.select(F.expr("""CASE WHEN N IS NULL OR K = 0 OR K = N OR N - N2 / N - (G - 1) <= 0 THEN 1D ELSE
        1 / greatest(0.01D, least(0.99D, (Q - K * K / N - (K / N) * (1 - K / N) * (G - 1))
        / ((K / N) * (1 - K / N) * (N - N2 / N - (G - 1))))) - 1 END""").alias("m"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """``outcomes(host, bad)`` (bad 0/1, null: not labelled) to one row per host: posterior mean and sd."""
    hosts = with_parents(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad")))
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    world = suffixes.agg(((F.sum("sb") + 1) / (F.sum("sn") + 2)).alias("p0"))
    strength = [_strength(g.select(F.col(n).alias("n"), F.col(b).alias("bad"))).scalar()
                for g, n, b in ((suffixes, "sn", "sb"), (domains, "dn", "db"), (hosts, "n", "bad"))]
    ps = (F.col("sb") + strength[0] * world.scalar()) / (F.col("sn") + strength[0])
    pd = (F.col("db") + strength[1] * F.col("ps")) / (F.col("dn") + strength[1])
    parents = domains.join(suffixes.withColumn("ps", ps), "suffix").withColumn("pd", pd).select("suffix", "domain", "pd")
    a = F.col("bad") + strength[2] * F.col("pd")
    b = F.col("n") - F.col("bad") + strength[2] * (1 - F.col("pd"))
    return (hosts.join(parents, ["suffix", "domain"]).withColumns({"a": a, "b": b})
            .select("host", F.expr("a / (a + b)").alias("mean"),
                    F.expr("sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))").alias("sd")))


def filter_urls(pages: DataFrame, rules=RULES, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """Per page: ``page_id, host, path, rule, verdict``."""
    host, path = host_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "given": verdict})
    bad = F.when(F.col("given") == "block", 1).when(F.col("given") == "allow", 0)
    judged = host_reputation(rows.select("host", bad.alias("bad"))).select(
        "host", F.when(F.col("mean") - F.lit(z) * F.col("sd") > threshold, "block").otherwise("allow").alias("by_host"))
    return rows.join(judged, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("given", "by_host").alias("verdict"))

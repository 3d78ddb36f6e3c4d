"""Operator 1, URL filter: empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix.  Each level's bad rate is shrunk towards its parent's through a
beta-binomial prior: corpus -> suffix -> registered domain -> host.  The prior's
weight (how many labelled pages it counts for) is estimated from the counts
themselves, by the method of moments, one number per level.  A host is blocked
when the lower bound of its posterior bad rate exceeds ``max_bad_rate``; a host
without labelled pages stands on its domain's or suffix's prior.  Explicit
rules override the verdict.

Defined results: a null url, or one without ``://``, has an empty host and path,
is never matched by a rule and is judged like any host.  Without labelled pages
no host is blocked by the method.  Repeated rows are
judged alike and all returned; an empty table gives an empty result; outcomes
that are null count as unlabelled.  Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnchorus.llm.common import ascii_lower, materialize

URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Suffixes of more than one label under which names are registered.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method.

    z: width of the posterior bound in standard deviations (1.645: one-sided 95 %).
    max_bad_rate: a host is blocked when the lower bound lies above.
    least_weight, most_weight: range of the estimated prior weights.
    """

    z: float = 1.645
    max_bad_rate: float = 0.3
    least_weight: float = 2.0
    most_weight: float = 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL_PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null.

    ``rules`` are (``host/path`` string, verdict) pairs: a short list kept in the
    expression.  A rule fits its host and all subdomains when the url's path
    starts with the rule's path.  Of two fitting rules of one length the first wins.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    if len(rules) > 1000:
        raise ValueError("rules are kept in the expression: at most 1000")
    fits = []
    for i, (rule, verdict) in enumerate(rules):
        rule_host, slash, rest = rule.partition("/")
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(-i).alias("order"),
                                         F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def _weight(children: DataFrame, params: Reputation) -> float:
    """Prior weight at one level by moments; ``children`` has n, k, parent (key) and parent_n, parent_k.

    The one aggregated row that comes to the driver holds five numbers.
    """
    p, q = F.col("k") / F.col("n"), F.col("parent_k") / F.col("parent_n")
    row = children.filter("n > 0").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"),
        F.sum(F.col("n") * (p - q) * (p - q)).alias("between"),
        F.sum(F.col("n") * p * (1 - p)).alias("within"),
        F.sum(F.col("n") * F.col("n") / F.col("parent_n")).alias("even"),
        F.count_distinct("parent").alias("parents")).first()
    c, n, groups = row["c"], row["n"] or 0, row["parents"]
    if c <= groups or n <= c:
        return params.most_weight
    between, within = row["between"] / (c - groups), row["within"] / (n - c)
    size = (n - row["even"]) / (c - groups)
    share = between + (size - 1) * within
    rho = (between - within) / share if share > 0 else 0.0
    return params.most_weight if rho <= 0 else min(params.most_weight, max(params.least_weight, (1 - rho) / rho))


def host_reputation(pages: DataFrame, params: Reputation | None = None) -> DataFrame:
    """One row per host with the posterior of its bad rate.

    ``pages`` has host and bad (true, false or null for unlabelled).  Counting is a
    grouped sum with partial aggregation, so a host with a third of all pages costs
    one row per task; what follows works on one row per host.
    """
    params = params or Reputation()
    hosts = materialize(
        pages.groupBy("host").agg(F.count("bad").alias("n"),
                                  F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))),
        "url-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n_all, k_all = total["n"] or 0, total["k"] or 0
    rate = (k_all + 0.1) / (n_all + 1.0)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("domain_n"), F.sum("k").alias("domain_k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("domain_n").alias("suffix_n"), F.sum("domain_k").alias("suffix_k"))
    w_suffix = _weight(suffixes.select(
        F.col("suffix_n").alias("n"), F.col("suffix_k").alias("k"), F.lit(0).alias("parent"),
        F.lit(max(n_all, 1)).alias("parent_n"), F.lit(k_all).alias("parent_k")), params)
    upper = domains.join(suffixes, "suffix")
    w_domain = _weight(upper.select(
        F.col("domain_n").alias("n"), F.col("domain_k").alias("k"), F.col("suffix").alias("parent"),
        F.col("suffix_n").alias("parent_n"), F.col("suffix_k").alias("parent_k")), params)
    w_host = _weight(hosts.join(domains.drop("suffix"), "domain").select(
        "n", "k", F.col("domain").alias("parent"),
        F.col("domain_n").alias("parent_n"), F.col("domain_k").alias("parent_k")), params)

    upper = upper.withColumn("suffix_rate", (F.col("suffix_k") + w_suffix * rate) / (F.col("suffix_n") + w_suffix))
    upper = upper.withColumn("domain_rate",
                             (F.col("domain_k") + w_domain * F.col("suffix_rate")) / (F.col("domain_n") + w_domain))
    a = F.col("k") + w_host * F.col("domain_rate")
    size = F.col("n") + w_host
    mean = a / size
    low = mean - params.z * F.sqrt(mean * (1 - mean) / (size + 1))
    return (hosts.join(upper.select("domain", "domain_rate"), "domain")
            .select("host", "n", "k", mean.alias("bad_rate"), low.alias("bad_rate_low"),
                    F.when(low > params.max_bad_rate, "block").otherwise("allow").alias("verdict")))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (),
               params: Reputation | None = None) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url).

    ``outcomes`` (url, bad) holds one row per page with its labelled outcome, null
    where it has none; the hosts of both are judged.  Returns page_id, host, path,
    rule and verdict.
    """
    reputation = host_reputation(
        outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("boolean").alias("bad"))
        .unionByName(pages.select(host_of(F.col("url")).alias("host"), F.lit(None).cast("boolean").alias("bad"))),
        params)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    # Large partitions of a hot host are split by the adaptive skew join.
    judged = parts.join(reputation.select("host", F.col("verdict").alias("by_method")), "host", "left")
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                         F.coalesce(F.col("hit.verdict"), F.col("by_method")).alias("verdict"))

"""URL filters: rules first, then empirical-Bayes reputation of the host.

Labelled page outcomes are counted by host. Each level shrinks towards the one above it by a
beta prior whose mean is that level's posterior mean: suffix towards the whole, registered
domain towards its suffix, host towards its domain. How strongly is estimated from the counts:
the overdispersion of beta-binomial outcomes of a level's members about their priors' means.
A host is blocked if even the upper bound of its posterior good rate is too low.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Suffixes of more than one label under which names are registered (fixed values).
LONG_SUFFIXES = ["ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """The public suffix and the registered domain of a host, without its port."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(name, ".", -2)
    long = two.isin(LONG_SUFFIXES)
    suffix = F.when(long, two).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(long, F.substring_index(name, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (verdict, host/path) rule that fits, and its verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{tail}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _strength(counts: DataFrame) -> float:
    """The prior's strength from members' n, k and prior means, by moments of the beta-binomial."""
    off = F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("prior"), F.lit(2)) / (F.col("prior") * (1 - F.col("prior")))
    r = counts.where("n > 0 and prior > 0 and prior < 1").agg(F.sum(off).alias("x"), F.sum("n").alias("n"), F.count("*").alias("m")).first()
    if not r["m"] or r["n"] <= r["m"]:
        return 1.0
    spread = min(max((r["x"] - r["m"]) / (r["n"] - r["m"]), 0.01), 0.9)
    return 1 / spread - 1


def _shrunk(counts: DataFrame, strength: float) -> Column:
    return (F.col("k") + F.col("prior") * strength) / (F.col("n") + strength)


def host_reputation(hosts: DataFrame, few_rows: int = 100_000) -> DataFrame:
    """host, mean and spread of the posterior good rate, from hosts with n outcomes, k of them good.

    hosts has one row for each host (n may be 0). Suffixes, which are few, are joined by
    broadcast if a count shows that they are no more than few_rows.
    """
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = cut(hosts.select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    n, k = whole["n"] or 0, whole["k"] or 0
    rate = (k + 1) / (n + 2)
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(rate))
    suffixes = suffixes.select("suffix", _shrunk(suffixes, _strength(suffixes)).alias("prior"))
    if suffixes.limit(few_rows + 1).count() <= few_rows:
        suffixes = F.broadcast(suffixes)
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    domains = domains.select("domain", _shrunk(domains, _strength(domains)).alias("prior"))
    judged = hosts.join(domains, "domain")
    strength = _strength(judged)
    a = F.col("k") + F.col("prior") * strength
    b = F.col("n") - F.col("k") + (1 - F.col("prior")) * strength
    return judged.select("host", (a / (a + b)).alias("mean"), F.sqrt(a * b / (F.pow(a + b, F.lit(2)) * (a + b + 1))).alias("spread"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], least_rate: float = 0.5, z: float = 1.645, salts: int = 8) -> DataFrame:
    """One row per page: page_id, host, path, rule and verdict, with the host's posterior bound.

    outcomes has page_id and good (0 or 1) of some pages; several of one page all count, nulls
    don't. The verdict is the longest fitting rule's; else `block` if mean + z * spread of the
    host's posterior is under least_rate, else `allow`. A null url, or one without `://`, has an
    empty host, which is judged like any other. Hot hosts are spread over `salts` join keys.
    Repeated pages are judged alike; null page ids are kept.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")).where("good in (0, 1)")
    hosts = parsed.join(known, "page_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    table = host_reputation(hosts)
    table = table.select("host", (F.col("mean") + z * F.col("spread")).alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")
    found = parsed.withColumn("salt", salt).join(table, ["host", "salt"])
    verdict = F.coalesce(said, F.when(F.col("bound") < least_rate, "block").otherwise("allow"))
    return found.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bound")

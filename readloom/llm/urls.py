"""URL filters: explicit host and path rules, else an empirical-Bayes reputation of the host.

Labelled pages give bad and total counts a host. A beta prior is fitted by moments at
each level, and counts are shrunk from suffix to registered domain to host: the posterior
mean of a level is the prior mean of the one below, so a host without labels falls back
on its domain, then its suffix, then all pages. A page is blocked if the lower posterior
bound (mean less `z` standard deviations) of its host's bad rate is over `limit`.

For the reputation alone, user and port are cut off the host; the registered domain is one
label more than the public suffix, which has two labels where the table of such suffixes (a
parameter) holds it and else one; an address in numbers is its own domain.

Rules are a short tuple, which becomes one expression, or a table (verdict, host, path) of any
size, which is joined by host or parent and by the beginning of the path.

Defined cases: a null url, or one without `://`, has empty host and path and no rule;
null or repeated labels count as no label, and once each; of rules of one length the one with
the longer host and then the first by name wins; very long urls are read whole; ids are not
changed and repeated rows stay; an empty table gives an empty result; other columns are not
carried.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm import shared


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: More rules than this are joined as a table.
EXPRESSION_RULES = 200
#: Public suffixes of two labels, those of many registrations. Pass the whole public list for real data.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my",
    "com.sg", "com.tr", "com.tw", "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ne.jp", "net.au", "net.br", "net.cn", "or.jp",
    "or.kr", "org.au", "org.br", "org.cn", "org.nz", "org.uk", "org.za",
)
#: Lower bound of a bad rate that blocks, deviations below the mean, and least and greatest weight of a prior in pages.
LIMIT, Z, WEIGHT = 0.5, 1.64, (2.0, 200.0)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule whose host is this one or a parent of it and whose path begins this one; struct<rule, verdict> or null."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))]
    return F.coalesce(*fits)


def join_rules(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """`parts` (host, path, ...) with r, the struct of matching_rule, from a table of rules.

    Each distinct (host, path) asks for its parents with the beginnings of its path, of the lengths that rules have
    (at most as many as a url has characters): an equality join, in which a rule host of many pages makes no products.
    """
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect())
    asked = parts.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    asked = asked.select("host", "path", F.explode(parents).alias("rule_host"))
    begins = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    asked = asked.select("host", "path", "rule_host", F.explode(begins).alias("n")).withColumn("rule_path", F.substr("path", F.lit(1), F.col("n")))
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").groupBy("rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    name = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(name)).alias("n"), (-F.length("rule_host")).alias("h"), name.alias("rule"), "verdict")
    best = asked.join(listed, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.min(order).alias("best"))
    found = shared.materialize(best.select("host", "path", F.struct("best.rule", "best.verdict").alias("r")), "rules")
    return parts.join(found, ["host", "path"], "left")


def bare(host: Column) -> Column:
    """`host` without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")


def is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}\z") | name.startswith("[")


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix; empty for addresses in numbers."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), "").when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The public suffix and one label more, if there is one; an address as it is."""
    name = bare(host)
    two = F.substring_index(name, ".", -2)
    return F.when(is_address(name), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def level_counts(labelled: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages and bad ones (n, bad) of each host without user and port, registered domain and suffix. Those of hosts are
    written, so pages are read for them once."""
    named = labelled.filter("bad is not null").select(bare(F.col("host")).alias("host"), "bad")
    hosts = named.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = shared.materialize(hosts.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix(F.col("host"), suffixes)), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return hosts, domains, suffixes


def _fit(children: DataFrame, mean: float) -> float:
    """Weight in pages of the beta prior with this mean: moments of the children's rates over what chance alone gives."""
    row = children.agg(F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("n2"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - mean) ** 2).alias("s")).first()
    low, high = WEIGHT
    if not row["n"] or row["k"] < 2 or not 0 < mean < 1:
        return high
    spread = row["n"] - row["n2"] / row["n"]
    between = (row["s"] - (row["k"] - 1) * mean * (1 - mean)) / spread if spread > 0 else 0.0
    return min(high, max(low, mean * (1 - mean) / between - 1)) if between > 0 else high


@dataclass(frozen=True)
class Reputation:
    """Counts at each level and the fitted priors: global mean, and weights of the prior of suffixes, domains and hosts."""

    hosts: DataFrame
    domains: DataFrame
    suffixes: DataFrame
    mean: float
    weights: tuple[float, float, float]
    public: tuple[str, ...] = SUFFIXES


def fit(labelled: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> Reputation:
    """Fit priors on `labelled` (host, bad 0 or 1 or null). A few sums a level reach the driver, never the hosts."""
    hosts, domains, tops = level_counts(labelled, suffixes)
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total["bad"] + 0.5) / (total["n"] + 1) if total["n"] else 0.0
    return Reputation(hosts, domains, tops, mean, (_fit(tops, mean), _fit(domains, mean), _fit(hosts, mean)), suffixes)


def score(pages: DataFrame, rep: Reputation, z: float = Z) -> DataFrame:
    """`pages` (with host) and bad_rate, its posterior mean, and bound, the lower posterior bound.

    Counts are joined to the distinct hosts first, so a host with a third of the pages is one row there.
    """
    own = F.col("host")
    hosts = pages.select("host").distinct().select("host", bare(own).alias("bare"), registered_domain(own, rep.public).alias("domain"), suffix(own, rep.public).alias("suffix"))
    counts = lambda df, key, name: df.select(key, F.col("n").alias(f"n_{name}"), F.col("bad").alias(f"bad_{name}"))
    hosts = hosts.join(counts(rep.hosts.withColumnRenamed("host", "bare"), "bare", "h"), "bare", "left").join(counts(rep.domains, "domain", "d"), "domain", "left").join(counts(rep.suffixes, "suffix", "s"), "suffix", "left")
    ws, wd, wh = rep.weights
    got = lambda name: (F.coalesce(f"bad_{name}", F.lit(0.0)), F.coalesce(f"n_{name}", F.lit(0.0)))
    mean: Column = F.lit(rep.mean)
    for name, weight in (("s", ws), ("d", wd)):
        bad, n = got(name)
        mean = (bad + mean * weight) / (n + weight)
    bad, n = got("h")
    hosts = hosts.withColumn("a", bad + mean * wh).withColumn("m", n + wh).withColumn("bad_rate", F.col("a") / F.col("m"))
    hosts = hosts.select("host", "bad_rate", (F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("m") + 1))).alias("bound"))
    # written, so that Spark may split the pages of a host that many share
    return pages.join(shared.materialize(hosts, "reputations"), "host", "left")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[UrlRule, ...] | DataFrame = RULES, limit: float = LIMIT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, bad_rate, bound.

    `labels`: page_id, bad (0 or 1).
    """
    if isinstance(rules, tuple) and len(rules) > EXPRESSION_RULES:
        rules = pages.sparkSession.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    outcome = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    rep = fit(parts.join(outcome, "page_id").select("host", "bad"), suffixes)
    scored = score(parts, rep)
    scored = join_rules(scored, rules) if isinstance(rules, DataFrame) else scored.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    by_bound = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_bound).alias("verdict"), "bad_rate", "bound")

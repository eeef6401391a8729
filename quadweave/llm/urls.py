"""URL filters by hashed host-suffix and path-prefix expressions.

Every rule is one expression, its host and path written together. A url is expanded into the
expressions that could name a rule: its host and each parent domain, each with prefixes of its path.
Both sides are hashed; the join is on a short prefix of the hash, the full digest confirms, and of the
rules that fit, the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import lower_ascii, others

BROADCAST_RULES = 200_000
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as written, the host in lower case; both empty without ``://`` or for null."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_HEX)


def compile_rules(rules: DataFrame) -> DataFrame:
    """(host, path, verdict) as unique expressions: prefix, digest, rule, verdict and length.

    Null hosts and paths count as empty; rows without a verdict are left out; of two verdicts for one
    expression, block wins.
    """
    host, path = (F.coalesce(F.col(c), F.lit("")) for c in ("host", "path"))
    clean = rules.filter(F.col("verdict").isNotNull()).select(
        lower_ascii(host).alias("r_host"), path.alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    clean = clean.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    rule = F.concat("r_host", "r_path")
    return clean.select(
        rule.alias("rule"),
        F.sha2(rule, 256).alias("digest"),
        _prefix(F.sha2(rule, 256)).alias("prefix"),
        F.col("r_verdict").alias("verdict"),
        F.length(rule).alias("rule_length"),
        F.size(F.split("r_host", r"\.")).alias("labels"),
        F.length("r_path").alias("path_length"),
    )


def expressions(sites: DataFrame, labels: list[int], path_lengths: list[int]) -> DataFrame:
    """One row for each expression of ``host`` and ``path`` whose shape some rule has."""
    parts = F.split("host", r"\.")
    ends = F.array(*[F.lit(k) for k in labels]).cast("array<int>")
    cuts = F.array(*[F.lit(k) for k in path_lengths]).cast("array<int>")
    hosts = F.transform(
        F.filter(ends, lambda k: k <= F.size(parts)),
        lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
    )
    paths = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    spread = sites.select("host", "path", F.explode(both).alias("expression"))
    digest = F.sha2("expression", 256)
    return spread.select("host", "path", digest.alias("digest"), _prefix(digest).alias("prefix"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's path. Without a
    fitting rule, ``rule`` is null and the verdict is ``default``. Columns of ``pages`` with one of the
    four names are replaced. Null urls and urls without ``://`` have an empty host and path and are
    judged like any other. Repeated urls are judged once; every row gets the answer. An empty table
    gives an empty result, an empty rule list gives the default everywhere.

    Rules up to a checked number are broadcast; a longer list is joined by shuffle, on expressions of
    distinct (host, path) pairs, where adaptive execution splits a prefix shared by many hosts.
    """
    names = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host.alias("host"), path.alias("path"))
    rules = compile_rules(rules)
    shape = rules.agg(
        F.array_sort(F.collect_set("labels")).alias("labels"),
        F.array_sort(F.collect_set("path_length")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    if not shape.n:
        return rows.select(*others(pages, names), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    sites = rows.select("host", "path").distinct()
    found = expressions(sites, shape.labels, shape.lengths)
    side = rules.select("prefix", F.col("digest").alias("r_digest"), "rule", "verdict", "rule_length")
    side = F.broadcast(side) if shape.n <= BROADCAST_RULES else side
    hits = found.join(side, "prefix").filter(F.col("digest") == F.col("r_digest"))
    best = hits.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(F.struct("rule_length", "rule", "verdict")).alias("best"))
    joined = rows.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    verdict = F.coalesce("best.verdict", F.lit(default))
    return joined.select(*others(pages, names), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))

"""URL filter: rules first, then trust and distrust that spread over the links between hosts.

A rule is a host and the start of a path; it fits the host, its subdomains and urls whose path starts so; the longest
fitting rule decides. Hosts with allowed pages are trusted seeds and hosts with blocked pages are blocked seeds, each by
its share of the two. Trust is the personalised PageRank of the trusted seeds along the links; distrust is that of the
blocked seeds against them, so a host that links to blocked hosts is distrusted. What a host without links passes on
returns to the seeds. That makes the rank a multiple of what the seeds' mass adds up to as it moves along the links, a
factor ``damping`` less each step, so a step is one join and one sum, and the sums are scaled to 1 in the end. Steps go
on until what is left to move is below ``tolerance`` of the mass. A host is blocked if its distrust exceeds ``ratio``
times its trust; pages without a fitting rule get their host's verdict. All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and is allowed; a host that no seed
reaches is allowed; links to the page's own host and links without a host are no edges; a null html has no links; rows that
repeat are judged each by itself and count each as a page; columns that are not named are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A link with a host, with or without a scheme; possessive, so long blanks take one pass.
LINK = r"""(?i)\bhref\s*+=\s*+["']?+\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#"'\s<>]*+)"""
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A table with a row per host is broadcast up to this many hosts.
BROADCAST_ROWS = 200_000


def host_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: tuple[tuple[str, str], ...], host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((F.col(host) == rule[:at]) | F.col(host).endswith("." + rule[:at])) & F.col(path).startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): absolute links from one host to another."""
    links = pages.select(host_of(url).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", UPPER, LOWER)).where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst")))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, check: int = 5) -> DataFrame:
    """(host, kind, score) of every host that a seed reaches: kind ``t`` along the edges, kind ``d`` against them.

    ``seeds`` has (host, kind, seed). Every step is cut off with a checkpoint and used once for the next, so plans don't
    grow; what is left to move is looked at every ``check`` steps.
    """
    both = edges.select(F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n"), F.struct(F.lit("d").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))).alias("e")).select("e.*")
    out = checkpoint(both.groupBy("kind", "host").agg(F.sum("n").alias("total")))
    both = checkpoint(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("total") * damping).alias("w")))
    total = F.broadcast(seeds.groupBy("kind").agg(F.sum("seed").alias("all")))  # a row per kind
    moving = checkpoint(seeds.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("all")).alias("score")))
    parts, step, some = [moving], 0, not both.isEmpty()
    while some:
        rows = F.broadcast(moving) if moving.count() <= BROADCAST_ROWS else moving
        moving = checkpoint(both.join(rows, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("w")).alias("score")))
        parts.append(moving)
        step += 1
        if step % check == 0:
            some = (moving.groupBy("kind").agg(F.sum("score").alias("m")).agg(F.max("m")).first()[0] or 0.0) * damping / (1 - damping) > tolerance
        if len(parts) > 16:  # so many tables are added up at once
            parts = [checkpoint(added(parts))]
    rank = checkpoint(added(parts))
    whole = F.broadcast(rank.groupBy("kind").agg(F.sum("score").alias("all")))  # a row per kind
    return rank.join(whole, "kind").select("host", "kind", (F.col("score") / F.col("all")).alias("score"))


def added(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("kind", "host").agg(F.sum("score").alias("score"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules: tuple[tuple[str, str], ...] = RULES, damping: float = 0.85, tolerance: float = 1e-9, ratio: float = 1.0) -> DataFrame:
    """key, host, path, rule and verdict of every page."""
    seen = pages.select(F.col(key), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("r", rule_of(rules))
    ruled = seen.where("host <> '' and r is not null").groupBy("host").agg(F.avg(F.when(F.col("r.verdict") == "allow", 1.0).otherwise(0.0)).alias("t"))
    seeds = ruled.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("t").alias("seed")), F.struct(F.lit("d").alias("kind"), (F.lit(1.0) - F.col("t")).alias("seed")))).alias("s")).select("host", "s.*").where("seed > 0")
    rank = spread(checkpoint(host_edges(pages, url, html)), seeds, damping, tolerance)
    score = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    hosts = rank.groupBy("host").agg(score("t").alias("trust"), score("d").alias("distrust"))
    blocked = checkpoint(hosts.where(F.round(F.col("distrust") - ratio * F.col("trust"), 8) > 0).select("host", F.lit("block").alias("spread")))
    if blocked.count() <= BROADCAST_ROWS:
        blocked = F.broadcast(blocked)
    verdict = F.coalesce(F.col("r.verdict"), F.col("spread"), F.lit("allow"))
    return seen.join(blocked, "host", "left").select(key, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))

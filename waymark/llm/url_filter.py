"""URL filters: explicit rules first, then link-graph propagation over hosts.

1. A url gives a host and a path. Of the rules that fit both, the longest decides.
2. Every link in the pages' html gives an edge between hosts (links within a host are left out); repeated
   links add up. A host of which the rules block more than half of the pages is a blocked seed, one of which
   they allow more than half is a trusted seed; more seeds can be given.
3. Trust is the personalised PageRank from the trusted seeds along the links. Distrust is the same from the
   blocked seeds against the links: who links to blocked hosts shares their distrust. Both run as one
   join and one aggregate a round, each round written to the shared folder, until they move less than a
   hundredth of the rank that blocks a host. The movement shrinks by the damping each round, so no cap is needed.
4. A host whose distrust is at least `least` times the mean rank (1 / hosts) and more than twice its trust is
   blocked; pages that no rule fits get their host's verdict.

Only DataFrame functions: html is parsed by the JVM, no Python runs on the executors.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed; repeated
rows are judged each; a null page_id stays; null or empty html has no links; other columns are ignored. Equally
long rules: the one with the longer host.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop, materialize

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""
DAMPING, FEW = 0.85, 100_000
MOVED, ROUNDING = 1e-6, 1e-12  # movement that ends the rounds at most; below the other, only rounding moves ranks


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict); null if none fits."""
    known = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("m"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    fit = F.filter(known, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    best = F.array_max(fit)
    return F.when(F.size(fit) > 0, F.struct(F.concat(best["host"], best["path"]).alias("rule"), best["verdict"].alias("verdict")))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; pages: host and html."""
    links = pages.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("to"))
    to = lower(F.regexp_replace("to", r"^.*@", ""))
    return links.select(F.col("host").alias("src"), to.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = MOVED) -> DataFrame:
    """(kind, host, rank): personalised PageRank, kind 0 along the edges and kind 1 against them.

    seeds: kind, host, weight (each kind sums to 1). The rank of hosts without links goes back to the seeds.
    """
    spark = edges.sparkSession
    both = edges.select(F.lit(0).alias("kind"), "src", "dst", "n").union(edges.select(F.lit(1), "dst", "src", "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    arcs, arcs_path = materialize(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "arcs")
    now, path = materialize(seeds.select("kind", "host", "weight", F.col("weight").alias("rank")), "ranks")
    while True:
        flow = now.join(arcs, ["kind", "host"]).groupBy("kind", "dst").agg(F.sum(F.col("rank") * F.col("share")).alias("flow")).withColumnRenamed("dst", "host")
        new = now.join(flow, ["kind", "host"], "full").select("kind", "host", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("rank", F.lit(0.0)).alias("old"), (damping * F.coalesce("flow", F.lit(0.0))).alias("flow"))
        new, got = materialize(new, "flow")
        sums = {r["kind"]: r["f"] for r in new.groupBy("kind").agg(F.sum("flow").alias("f")).collect()}  # two rows
        lost = F.create_map(*(x for k in (0, 1) for x in (F.lit(k), F.lit(1 - sums.get(k, 0.0)))))
        ranked, to = materialize(new.select("kind", "host", "weight", "old", (F.col("flow") + lost[F.col("kind")] * F.col("weight")).alias("rank")), "ranks")
        moved = ranked.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0
        drop(spark, path, got)
        now, path = ranked.drop("old"), to
        if moved < max(tolerance, ROUNDING):
            break
    drop(spark, arcs_path)
    return now.select("kind", "host", "rank")


def blocked_hosts(judged: DataFrame, edges: DataFrame, trusted=(), blocked=(), least: float = 1.0) -> DataFrame:
    """(host) of the hosts that distrust outweighs; judged: host and fit of all pages."""
    spark = judged.sparkSession
    hosts, _ = materialize(judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("fit.verdict") == "allow").cast("int")).alias("allow"), F.sum((F.col("fit.verdict") == "block").cast("int")).alias("block")), "hosts")
    known = spark.createDataFrame([(0, h) for h in trusted] + [(1, h) for h in blocked], "kind int, host string")
    seeds = hosts.where("2 * allow > n").select(F.lit(0).alias("kind"), "host").union(hosts.where("2 * block > n").select(F.lit(1), "host")).union(known).distinct()
    sizes = {r["kind"]: r["count"] for r in seeds.groupBy("kind").count().collect()}  # two rows
    if not sizes.get(1):
        return spark.createDataFrame([], "host string")
    weight = F.create_map(*(x for k in (0, 1) for x in (F.lit(k), F.lit(1 / max(1, sizes.get(k, 0))))))
    every = hosts.select("host").union(edges.select("src")).union(edges.select("dst")).distinct().count()
    ranks = propagate(edges, seeds.withColumn("weight", weight[F.col("kind")]), tolerance=min(MOVED, least / max(1, every) / 100))
    rank = lambda k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(rank(0).alias("trust"), rank(1).alias("distrust")).where((F.col("distrust") >= least / every) & (F.col("distrust") > 2 * F.col("trust"))).select("host")


def judge(pages: DataFrame, rules=RULES, trusted=(), blocked=(), least: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    host, path = host_path(F.col("url"))
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.col("html"))
    found = found.withColumn("fit", fitting(F.col("host"), F.col("path"), rules))
    edges, _ = materialize(host_edges(found), "edges")
    bad, _ = materialize(blocked_hosts(found.select("host", "fit"), edges, trusted, blocked, least).withColumn("bad", F.lit(True)), "blocked")
    few = bad.limit(FEW + 1).count() <= FEW  # host names have at most 255 bytes: under 25 MB
    out = found.drop("html").join(F.broadcast(bad) if few else bad.hint("merge"), "host", "left")
    verdict = F.coalesce("fit.verdict", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"))

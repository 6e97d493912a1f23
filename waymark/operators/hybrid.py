"""Reciprocal rank fusion of label, section and vector hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def ranked(hits: DataFrame, number: int, score: str) -> DataFrame:
    """A list's hits with their rank from 1; each list is already cut to its limit."""
    r = F.row_number().over(Window.orderBy(F.desc(score), "entity_id"))  # one task: a list has `limit` rows
    return hits.where("entity_id <> 0").select(F.lit(number).alias("list"), r.alias("rank"), "entity_id", "title", "article_id", "snippet", "code", "type")


def fuse(lists: list[DataFrame], limit: int = 10) -> DataFrame:
    """entity_id, rrf, power, n_lists, type and the merged fields, best first.

    Fields come from the first list (in the order given) that has them; a snippet gives way to a later one
    that is marked, or to a longer one while it isn't marked itself.
    """
    both = lists[0]
    for x in lists[1:]:
        both = both.unionByName(x)
    active = both.agg(F.count_distinct("list").alias("active"))  # one row
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("list")))
    rows = F.sort_array(F.collect_list(F.struct("list", "snippet")))  # at most a row a list
    one = both.groupBy("entity_id").agg(
        F.sum(1.0 / (K + F.col("rank"))).alias("rrf"), F.count("*").alias("n_lists"), F.min_by("type", "list").alias("first_type"),
        F.min_by("title", "list").alias("title"), F.min_by("code", "list").alias("code"), first("article_id", F.col("article_id") != 0).alias("article"), rows.alias("rows"),
    )
    marked = lambda s: F.contains(s, F.lit("<mark>"))
    better = lambda old, new: marked(new) | (~marked(old) & (F.octet_length(new) > F.octet_length(old)))
    text = F.aggregate("rows", F.lit(""), lambda old, x: F.when(better(old, F.coalesce(x["snippet"], F.lit(""))), x["snippet"]).otherwise(old))
    top = one.orderBy(F.desc("rrf"), "entity_id").limit(limit)
    return top.crossJoin(F.broadcast(active)).select("entity_id", "rrf", (F.col("rrf") / (F.col("active") / 61.0) * 100).alias("power"), "n_lists", F.when(F.col("n_lists") > 1, "H").otherwise(F.col("first_type")).alias("type"), "title", "code", F.coalesce("article", F.lit(0).cast("long")).alias("article_id"), text.alias("snippet")).orderBy(F.desc("rrf"), "entity_id")

"""Upserts, first-wins and last-wins dedupe, pruning and link resolution as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.tiles import filled


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row a key, the first in `order`."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def first_times(times: DataFrame) -> DataFrame:
    """One row per (entity_id, julian_day, prop_code), partial dates before full ones."""
    return first_by(times, ["entity_id", "julian_day", "prop_code"], "year", "month", "day").select("entity_id", "prop_code", "year", "month", "day", "julian_day")


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return first_by(rows, keys, F.desc(sequence))


def upsert_keep_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities from a dump: a title that isn't empty stays, the description is always the new one's. One row an id:
    of several new rows the smallest (title, description)."""
    new = new.groupBy("id").agg(F.min(F.struct("title", "description")).alias("n")).select("id", "n.title", "n.description")
    a, b = old.alias("a"), new.alias("b")
    fresh = F.col("b.id").isNotNull()
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(
        F.coalesce("a.id", "b.id").alias("id"),
        F.col("a.article_id").alias("article_id"),
        F.when(fresh, F.coalesce(F.nullif("a.title", F.lit("")), "b.title")).otherwise(F.col("a.title")).alias("title"),
        F.when(fresh, F.col("b.description")).otherwise(F.col("a.description")).alias("description"),
    )


def upsert_overwrite_title(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities from articles: article and title are the new ones, the description stays. One row an id: of several
    new rows the largest (article_id, title)."""
    new = new.groupBy("id").agg(F.max(F.struct("article_id", "title")).alias("n")).select("id", "n.article_id", "n.title")
    a, b = old.alias("a"), new.alias("b")
    fresh = F.col("b.id").isNotNull()
    return a.join(b, F.col("a.id") == F.col("b.id"), "full").select(
        F.coalesce("a.id", "b.id").alias("id"),
        F.when(fresh, F.col("b.article_id")).otherwise(F.col("a.article_id")).alias("article_id"),
        F.when(fresh, F.col("b.title")).otherwise(F.col("a.title")).alias("title"),
        F.col("a.description").alias("description"),
    )


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, each key once, replace those of old."""
    new = new.dropDuplicates([key])
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*(c for c in old.columns if c in new.columns)), allowMissingColumns=True)


def prune_range(places: DataFrame) -> DataFrame:
    return places.where(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))


def prune_unnamed(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Rows whose entity has a title."""
    return rows.join(entities.where("title <> ''").select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def resolve_links(links: DataFrame, places: DataFrame) -> DataFrame:
    """Places that entities take over from those they link to."""
    at = places.select(F.col("entity_id").alias("value"), "latitude", "longitude", "precision")
    return links.join(at, "value").select(F.col("id").alias("entity_id"), F.col("code").alias("prop_code"), "latitude", "longitude", "precision").distinct()


def put_settings(settings: DataFrame, new: DataFrame, sequence: str | None = None) -> DataFrame:
    """New values replace old ones; of several new values of a key the one with the largest `sequence` wins, without
    such a column the largest value."""
    best = new.groupBy("key").agg(F.max_by("value", sequence or "value").alias("value"))
    return settings.join(best.select("key"), "key", "left_anti").unionByName(best)


def flat_settings(json: DataFrame, prefix: str = "map_") -> DataFrame:
    """A row a key of the JSON object in column `json`; values that aren't strings stay JSON."""
    got = json.select(F.explode(F.from_json("json", "map<string,string>")).alias("k", "value"))
    return got.select(F.concat(F.lit(prefix), "k").alias("key"), "value")


def with_default_column(rows: DataFrame, name: str, value) -> DataFrame:
    """Copies from older stores lack some columns."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(value))


def map_config(settings: DataFrame) -> DataFrame:
    """One row: minzoom, maxzoom (14 where it is missing) and the centre's lon, lat and zoom."""
    pick = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    row = settings.agg(pick("map_minzoom").alias("a"), pick("map_maxzoom").alias("b"), pick("map_center").alias("c"))
    c = F.split("c", ",")
    return row.select(F.coalesce(F.col("a").cast("int"), F.lit(0)).alias("minzoom"), F.coalesce(F.col("b").cast("int"), F.lit(14)).alias("maxzoom"), *(F.get(c, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("lon", "lat", "zoom"))))


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    """The value, as one row; raises if the key is missing."""
    got = settings.where(F.col("key") == key).agg(F.max("value").alias("value"))
    return got.select(F.coalesce("value", F.raise_error(F.lit(f"no setting {key}"))).alias("value"))


def latest_title(title, section_title):
    return F.coalesce(filled(title, section_title), F.lit("Untitled"))

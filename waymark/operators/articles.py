"""Articles assembled from their sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.merge import latest_title


def assembled(sections: DataFrame, entities: DataFrame) -> DataFrame:
    """entity_id, article_id, title and the sections in the order of their ids, of every entity with sections."""
    rows = F.sort_array(F.collect_list(F.struct("id", "title", "content", "pow")))
    s = sections.groupBy("entity_id").agg(F.min_by("title", "id").alias("section_title"), rows.alias("sections"))
    e = entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"), "article_id")
    return s.join(e, "entity_id", "left").select("entity_id", "article_id", latest_title(F.col("entity_title"), F.col("section_title")).alias("title"), "sections")


def get(sections: DataFrame, entities: DataFrame, number: int) -> DataFrame:
    """The article of an entity id, else of an article id: one row, or none."""
    known = entities.where((F.col("id") == number) | (F.col("article_id") == number)).select(F.col("id").alias("entity_id"), (F.col("id") != number).cast("int").alias("by"))
    mine = known.union(sections.where(F.col("entity_id") == number).select("entity_id", F.lit(0)).limit(1)).distinct()
    own = assembled(sections.join(mine.select("entity_id").distinct(), "entity_id", "left_semi"), entities)
    first = own.join(mine.groupBy("entity_id").agg(F.min("by").alias("by")), "entity_id").orderBy("by", "entity_id").limit(1)
    return first.select(F.when(F.col("by") == 1, F.lit(number).cast("long")).otherwise(F.col("entity_id")).alias("id"), "entity_id", "article_id", "title", "sections")


def markdown(articles: DataFrame) -> DataFrame:
    """entity_id and the article as Markdown."""
    part = lambda s: F.concat(F.when(s["title"] != "", F.concat(F.lit("## "), s["title"], F.lit("\n"))).otherwise(""), s["content"], F.lit("\n\n"))
    body = F.array_join(F.transform("sections", part), "")
    return articles.select("entity_id", F.concat(F.lit("# "), "title", F.lit(" (ID: "), F.col("entity_id").cast("string"), F.lit(")\n\n"), body).alias("markdown"))


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row; empty texts and zeros are left out."""
    from pyspark.sql.types import NumericType, StringType

    cols = []
    for f in rows.schema:
        c = F.col(f.name)
        cols.append(F.nullif(c, F.lit("")).alias(f.name) if isinstance(f.dataType, StringType) else F.when(c != 0, c).alias(f.name) if isinstance(f.dataType, NumericType) else c)
    return rows.select(F.to_json(F.struct(*cols)).alias("json"))

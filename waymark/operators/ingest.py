"""Entity dumps and articles into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.time import julian_day, parse_time
from waymark.functions.tiles import entity_number
from waymark.functions.vector import floats
from waymark.operators.merge import first_times, prune_range, prune_unnamed, replaced, resolve_links, upsert_keep_title, upsert_overwrite_title, with_default_column
from waymark.sources.lines import kept

#: Properties that hold dates, coordinates and links to places, with their labels
TIME_PROPERTIES = {
    569: "Date of birth",
    570: "Date of death",
    571: "Inception",
    575: "Time of discovery",
    576: "Dissolution date",
    577: "Publication date",
    580: "Start time",
    582: "End time",
    585: "Point in time",
    729: "Service entry",
    730: "Service retirement",
    746: "Date of disappearance",
    1191: "Date of first performance",
    1249: "Time of earliest written record",
    1319: "Earliest date",
    1326: "Latest date",
    1619: "Date of official opening",
    2031: "Work period start",
    2032: "Work period end",
    2669: "Discontinued date",
    2754: "Production date",
    3999: "Date of official closure",
    5204: "Floruit",
    6949: "Announcement date",
    7124: "Date of first flight",
    7125: "Date of latest flight",
    7588: "Commissioning",
    7589: "Decommissioning",
    9667: "Combat start",
    10135: "Combat end",
}
PLACE_PROPERTIES = {625: "Coordinate location"}
LINK_PROPERTIES = {19: "Place of birth", 20: "Place of death"}
RELEVANT = sorted([*TIME_PROPERTIES, *PLACE_PROPERTIES, *LINK_PROPERTIES])

SCHEMA = "id string, claims map<string, array<struct<mainsnak: struct<datavalue: struct<value: string>>>>>, labels map<string, struct<value: string>>, descriptions map<string, struct<value: string>>"


def records(lines: DataFrame) -> DataFrame:
    """One JSON text a line, without the array's brackets and commas."""
    v = F.regexp_replace(F.trim("value"), r",\s*$", "")
    return lines.select(v.alias("value")).where("value not in ('', '[', ']')")


def relevant(json: DataFrame) -> DataFrame:
    """Lines that name a property we use; cheaper than parsing them."""
    return json.where(F.col("value").rlike('"P(' + "|".join(map(str, RELEVANT)) + ')"'))


def parsed(json: DataFrame) -> DataFrame:
    """id, title, description and the first claim's value of each property; claims whose value can't be used and lines
    without a usable label go, so an entity without any usable claim has no row."""
    p = json.select(F.from_json("value", SCHEMA).alias("e")).select("e.*")
    title, description = label_pick(F.col("labels"), F.col("descriptions"))
    out = p.select(entity_number(F.col("id")).alias("id"), title.alias("title"), description.alias("description"), F.explode(first_claims(F.col("claims"))).alias("prop_code", "value"))
    return out.where((F.col("title") != "") & (F.col("id") > 0) & usable(F.col("prop_code"), F.col("value")))


#: How a date begins, and the globe that is ours
TIME, EARTH = r"^[+-]\d{4,9}-\d{2}-\d{2}", "http://www.wikidata.org/entity/Q2"


def usable(code: Column, value: Column) -> Column:
    """A date, a place on earth, or a link to an entity."""
    field = lambda k: F.get_json_object(value, f"$.{k}")
    place = F.coalesce(field("globe"), F.lit("")).isin("", EARTH) & field("latitude").isNotNull() & field("longitude").isNotNull()
    known = lambda c: code.isin(list(c))
    return F.coalesce((known(TIME_PROPERTIES) & field("time").rlike(TIME)) | (known(PLACE_PROPERTIES) & place) | (known(LINK_PROPERTIES) & entity_number(field("id")).isNotNull()), F.lit(False))


def first_claims(claims: Column) -> Column:
    """Map from property number to its first claim's value, of the relevant properties."""
    known = F.map_filter(claims, lambda k, v: k.isin([f"P{c}" for c in RELEVANT]))
    return F.transform_values(F.transform_keys(known, lambda k, v: F.substring(k, 2, 10).cast("int")), lambda k, v: F.get(v, F.lit(0))["mainsnak"]["datavalue"]["value"])


def label_pick(labels: Column, descriptions: Column) -> tuple[Column, Column]:
    """English if it isn't blank, else the first language (by code) with a label, trimmed; and its description."""
    usable = F.array_sort(F.map_keys(F.map_filter(labels, lambda k, v: F.trim(v["value"]) != "")))
    lang = F.when(F.trim(labels["en"]["value"]) != "", "en").otherwise(F.get(usable, F.lit(0)))
    text = labels[lang]["value"]
    return F.when(lang == "en", text).otherwise(F.trim(text)), descriptions[lang]["value"]


def entities(claims: DataFrame) -> DataFrame:
    """One row an id; of several lines of one id the smallest (title, description)."""
    return claims.groupBy("id").agg(F.min(F.struct("title", "description")).alias("e")).select("id", "e.title", "e.description")


def times(claims: DataFrame) -> DataFrame:
    """Dates, the year 0 included."""
    got = claims.where(F.col("prop_code").isin(list(TIME_PROPERTIES))).select("id", "prop_code", F.get_json_object("value", "$.time").alias("t"))
    y, m, d = parse_time(F.col("t"))
    rows = got.select(F.col("id").alias("entity_id"), "prop_code", y.alias("year"), m.alias("month"), d.alias("day"))
    return first_times(rows.withColumn("julian_day", julian_day(F.col("year"), F.col("month"), F.col("day"))))


def places(claims: DataFrame) -> DataFrame:
    """Coordinates on earth."""
    p = F.from_json("value", "latitude double, longitude double, precision double")
    got = claims.where(F.col("prop_code").isin(list(PLACE_PROPERTIES))).select("id", "prop_code", p.alias("p"))
    return got.select(F.col("id").alias("entity_id"), "prop_code", "p.latitude", "p.longitude", "p.precision")


def links(claims: DataFrame) -> DataFrame:
    return claims.where(F.col("prop_code").isin(list(LINK_PROPERTIES))).select("id", F.col("prop_code").alias("code"), entity_number(F.get_json_object("value", "$.id")).alias("value"))


def import_entities(lines: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The whole import of a dump: parse, upsert entities, add dates and places, take over the places of linked
    entities, prune. old and the result: entities, entity_times, entity_places."""
    claims = kept(parsed(relevant(records(lines))), "claims")  # four tables are made of them
    named = upsert_keep_title(old["entities"], entities(claims).withColumn("article_id", F.lit(None).cast("long")))
    all_times = first_times(old["entity_times"].unionByName(times(claims)))
    own = places(claims)
    here = old["entity_places"].drop("id").unionByName(own, allowMissingColumns=True)
    here = here.unionByName(resolve_links(links(claims), here))
    if old["entities"].isEmpty() and claims.isEmpty():  # no entity, nothing to prune by
        return {"entities": named, "entity_times": all_times, "entity_places": numbered_places(here)}
    here = numbered_places(prune_unnamed(prune_range(here), named))
    return {"entities": named, "entity_times": prune_unnamed(all_times, named), "entity_places": here}


def numbered_places(places_: DataFrame) -> DataFrame:
    """id: a hash of the row, so an import can be repeated; equal rows are one."""
    row = ["entity_id", "prop_code", "latitude", "longitude", "precision"]
    return places_.select(F.xxhash64(*row).alias("id"), *row).distinct()


def import_articles(lines: DataFrame, old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The whole import of an article archive: entities with their articles, and the sections of their texts."""
    found = articles(lines)
    one = found.groupBy(F.col("entity_id").alias("id")).agg(F.max(F.struct("article_id", "title", "html")).alias("a")).select("id", "a.*")
    named = upsert_overwrite_title(old["entities"], one.select("id", "article_id", "title"))
    fresh = sections(one.select(F.col("id").alias("entity_id"), "title", "html"))
    kept = old["sections"].join(fresh.select("id"), "id", "left_anti")
    return {"entities": named, "sections": kept.unionByName(fresh)}


def import_store(store: dict[str, DataFrame], old: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An existing store of articles, sections, vectors and settings (tables `articles`, `sections`, `setup`, and
    `vectors` where it has them) merged into ours: settings, entities, sections, vectors."""
    a = store["articles"].where("entity like 'Q%'").select(F.expr("try_cast(substring(entity, 2) as bigint)").alias("entity_id"), F.col("id").alias("article_id"), "title").where("entity_id is not null")
    one = a.groupBy(F.col("entity_id").alias("id")).agg(F.max(F.struct("article_id", "title")).alias("a")).select("id", "a.article_id", "a.title")
    s = with_default_column(store["sections"], "pow", 0).join(a.select("article_id", "entity_id"), "article_id").select("id", "entity_id", "title", "content", F.coalesce(F.col("pow"), F.lit(0)).cast("int").alias("pow"))
    setup = store["setup"].where(F.col("key").isin(*STORE_SETTINGS)).select("key", F.col("value").cast("string").alias("value"))
    out = {"entities": upsert_overwrite_title(old["entities"], one), "sections": replaced(old["sections"], s, "id"), "settings": replaced(old["settings"], setup, "key")}
    if "vectors" in store:
        v = store["vectors"]
        if v.schema["embedding"].dataType.simpleString() == "binary":
            v = v.withColumn("embedding", floats(F.col("embedding")))
        out["vectors"] = replaced(old["vectors"], v.select("id", "embedding"), "id")
    return out


#: The settings taken over from an existing store
STORE_SETTINGS = ("model", "annSize", "modelPrefixSearch", "modelPrefixSave")


def properties(spark) -> DataFrame:
    return spark.createDataFrame(sorted((TIME_PROPERTIES | PLACE_PROPERTIES | LINK_PROPERTIES).items()), "prop_code int, label string")


def with_label(rows: DataFrame, kind: str = "Event") -> DataFrame:
    """label of each prop_code; unknown ones are named by their number."""
    named = rows.join(F.broadcast(properties(rows.sparkSession)), "prop_code", "left")  # 33 rows
    return named.withColumn("label", F.coalesce("label", F.concat(F.lit(f"{kind} P"), F.col("prop_code").cast("string"))))


ARTICLE = "identifier long, name string, main_entity struct<identifier: string>, article_body struct<html: string>"


def articles(lines: DataFrame) -> DataFrame:
    """article_id, entity_id, title, html of articles with a text and an entity."""
    a = lines.select(F.from_json("value", ARTICLE).alias("a")).select("a.*")
    out = a.select(F.col("identifier").alias("article_id"), entity_number(F.col("main_entity.identifier")).alias("entity_id"), F.col("name").alias("title"), F.col("article_body.html").alias("html"))
    return out.where("html <> '' and entity_id > 0")


def sections(articles_: DataFrame) -> DataFrame:
    """id, entity_id, title, content, pow of all sections; the id is a hash of the entity and the section's number,
    so an import can be repeated."""
    from waymark.sources.html import sections_of

    cut = F.pandas_udf(sections_of, "array<struct<title: string, content: string, pow: int>>")
    got = articles_.select("entity_id", F.posexplode(cut("html")).alias("n", "s"))
    return got.select(F.xxhash64("entity_id", "n").alias("id"), "entity_id", "s.*")

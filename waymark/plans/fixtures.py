"""The domain's tables as views over the test tables; the same SQL text serves Spark and the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymark.functions.time import julian_day
from waymark.sources.batches import spread


def _literal(sql: str) -> str:
    """Braces of JSON in the text stay; only {customer} is a table's name."""
    return sql.replace("{", "{{").replace("}", "}}").replace("{{customer}}", "{customer}")


#: {name} stands for a base table
VIEWS = {
    "entities": """select c_custkey+1 as id,
  case when c_custkey%4=0 then cast(null as bigint) else 500000+c_custkey end as article_id,
  case when c_custkey%17=0 then '' else c_name end as title,
  case when c_custkey%6=0 then cast(null as string) else c_mktsegment end as description
from {customer}""",
    "entity_places": """select c_custkey+1 as id, c_custkey+1 as entity_id, 625 as prop_code,
  cast((c_custkey*7919)%18001 as double)/100.0-90.0 as latitude,
  cast((c_custkey*104729)%36001 as double)/100.0-180.0 as longitude,
  cast(c_custkey%3 as double)/10.0 as precision
from {customer}
union all
select 1000000+c_custkey, c_custkey+1, 19,
  cast((c_nationkey*1543)%18001 as double)/100.0-90.0,
  cast((c_nationkey*6151)%36001 as double)/100.0-180.0,
  cast(c_custkey%2 as double)
from {customer} where c_custkey%3=0""",
    "raw_times": """select o_custkey+1 as entity_id,
  case o_orderstatus when 'F' then 569 when 'O' then 571 else 585 end as prop_code,
  case when o_custkey%5=0 then cast(year(o_orderdate) as int)-2045 else cast(year(o_orderdate) as int) end as year,
  case when o_orderkey%7=0 then 0 else cast(month(o_orderdate) as int) end as month,
  case when o_orderkey%7=0 or o_orderkey%11=0 then 0 else cast(day(o_orderdate) as int) end as day
from {orders}""",
    "sections": """select doc_id+1 as id, cast(floor(doc_id/4.0) as bigint)+1 as entity_id,
  source as title, text as content, cast(doc_id%6 as int)+1 as pow
from {documents}""",
    "vectors": "select vec_id+1 as id, embedding from {embeddings}",
    "dump": _literal("""select '{"id":"Q' || c_custkey || '","claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}}]' ||
  case when c_custkey%3=0 then ',"P569":[{"mainsnak":{"datavalue":{"value":{"time":"' || case when c_custkey%21=0 then 'unknown value' else case when c_custkey%2=0 then '+' else '-' end || lpad(cast(c_custkey%2000 as string), 4, '0') || '-' || lpad(cast(c_custkey%13 as string), 2, '0') || '-' || lpad(cast(c_custkey%29 as string), 2, '0') || 'T00:00:00Z' end || '"}}}},{"mainsnak":{"datavalue":{"value":{"time":"+1900-01-01T00:00:00Z"}}}}]' else '' end ||
  case when c_custkey%4=0 then ',"P625":[{"mainsnak":{"datavalue":{"value":{"latitude":' || (c_custkey%90) || '.5,"longitude":-' || (c_custkey%180) || '.25,"precision":0.' || (c_custkey%3+1) || ',"globe":"' || case when c_custkey%8=0 then 'http://www.wikidata.org/entity/Q2' when c_custkey%12=0 then '' else 'http://www.wikidata.org/entity/Q111' end || '"}}}}]' else '' end ||
  case when c_custkey%5=0 then ',"P19":[{"mainsnak":{"datavalue":{"value":{"id":"' || case when c_custkey%10=0 then 'Q' || (c_custkey%97+1) else 'none' end || '"}}}}]' else '' end ||
  '},"labels":{' || case when c_custkey%11=0 then '' when c_custkey%7=0 then '"en":{"value":"  "},"fr":{"value":" Nom ' || c_custkey || ' "},"it":{"value":"Nome"}' else '"fr":{"value":"Autre"},"en":{"value":"Name ' || c_custkey || '"}' end ||
  '},"descriptions":{"en":{"value":"about ' || c_custkey || '"},"fr":{"value":"de ' || c_custkey || '"}}},' as value, c_custkey as k from {customer}"""),
    "links": "select c_custkey+1 as id, 19 as code, cast(1+c_nationkey as bigint) as value from {customer}",
}
#: Fixed values of the settings table
SETTINGS = (("map_minzoom", "0"), ("map_maxzoom", "14"), ("map_center", "12.49,41.90,4"), ("map_bounds", "-180,-85,180,85"))
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "entity_times":
        from waymark.operators.merge import first_times

        t = view(spark, sf_dir, "raw_times")
        return first_times(t.withColumn("julian_day", julian_day(t["year"], t["month"], t["day"])))
    if name == "settings":
        return spark.createDataFrame(SETTINGS, "key string, value string")
    if name in BASE:
        return base(spark, sf_dir, name)
    if name == "dump":  # a line is long work for a short row
        return spark.sql(VIEWS[name], customer=spread(base(spark, sf_dir, "customer").select("c_custkey")))
    return spark.sql(VIEWS[name].format_map({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in BASE}))


class Tables:
    """tables.entities and so on for one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def jdn_sql(y: str, m: str, d: str) -> str:
    """The Julian day number in the check's SQL dialect."""
    m, d = f"(case when {m}=0 then 1 else {m} end)", f"(case when {d}=0 then 1 else {d} end)"
    a = f"((14-{m})//12)"
    yy = f"({y}+4800-{a})"
    return f"cast({d}+(153*({m}+12*{a}-3)+2)//5+365*{yy}+{yy}//4-{yy}//100+{yy}//400-32045 as bigint)"


def km_sql(lat1, lon1, lat2, lon2) -> str:
    h = f"greatest(0.0, least(1.0, pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))"
    return f"(2*6371.0*atan2(sqrt({h}), sqrt(1-{h})))"


def with_sql(body: str, *names: str) -> str:
    """body with the named views as common table expressions."""
    parts = []
    for n in names:
        if n == "entity_times":
            parts += [f"raw_times as ({VIEWS['raw_times']})", f"timed as (select *, {jdn_sql('year', 'month', 'day')} as julian_day from raw_times)", "entity_times as (select entity_id, prop_code, year, month, day, julian_day from (select *, row_number() over (partition by entity_id, julian_day, prop_code order by year, month, day) rn from timed) where rn=1)"]
        elif n == "settings":
            parts.append("settings(key, value) as (values " + ", ".join(f"('{k}','{v}')" for k, v in SETTINGS) + ")")
        else:
            parts.append(f"{n} as ({VIEWS[n]})")
    return ("with " + ",\n".join(p.format_map({t: t for t in BASE}) for p in parts) + "\n" + body) if parts else body

"""Every query over the test tables, beside the SQL that must give the same rows.

A query is a function of Tables; its SQL, where there is some, stands next to it. Numbers from floating-point
arithmetic are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo, vector
from waymark.functions import text as T
from waymark.functions import tiles as X
from waymark.functions import time as tm
from waymark.operators import articles, hybrid, ingest, lexical, maps, merge, semantic
from waymark.operators import events as ev
from waymark.plans.fixtures import Tables, jdn_sql, km_sql, with_sql
from waymark.sources import lines
from waymark.sources.batches import bound_batches

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}
LAT, LON, RADIUS = 41.9028, 12.4964, 2500.0
NEAR = ev.Near(LAT, LON, RADIUS)
WORDS = "the with"


def query(sql: str | None = None, *names: str):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_sql(sql, *names)
        return f
    return put


def dealt(t: Tables, values: tuple[str, ...], name: str) -> DataFrame:
    """k and one of the values, for every customer."""
    return t.customer.select(F.col("c_custkey").alias("k"), F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int")).alias(name))


def dealt_sql(values: tuple[str, ...], name: str) -> str:
    """The same rows in SQL."""
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"(select c_custkey as k, ([{quoted}])[c_custkey % {len(values)} + 1] as {name} from customer)"


r6 = lambda c: F.round(c, 6)
long = lambda c: F.col(c).cast("long").alias(c)

# --- dates ---


@query(f"select entity_id, year, month, day, {jdn_sql('year', 'month', 'day')} as julian_day from raw_times", "raw_times")
def julian_day(t: Tables) -> DataFrame:
    return t.raw_times.select("entity_id", "year", "month", "day", tm.julian_day(F.col("year"), F.col("month"), F.col("day")).alias("julian_day"))


@query(f"""select entity_id, year, month, day, {jdn_sql('year', 'month', 'case when month=0 then 0 else day end')} as low,
case when month=0 then {jdn_sql('year', '12', '31')} when day<>0 then {jdn_sql('year', 'month', 'day')}
else case when month=12 then {jdn_sql('(year+1)', '1', '1')} else {jdn_sql('year', '(month+1)', '1')} end - 1 end as high from raw_times""", "raw_times")
def jd_bounds(t: Tables) -> DataFrame:
    low, high = tm.jd_bounds(F.col("year"), F.col("month"), F.col("day"))
    return t.raw_times.select("entity_id", "year", "month", "day", low.alias("low"), high.alias("high"))


@query("""select entity_id, year, month, day, case when year=0 and month=0 and day=0 then '' else
(case when year<0 then '-' else '' end) || printf('%04d', abs(year)) || (case when month>0 then printf('-%02d', month) else '' end) || (case when month>0 and day>0 then printf('-%02d', day) else '' end) end as date from raw_times""", "raw_times")
def format_partial_date(t: Tables) -> DataFrame:
    return t.raw_times.select("entity_id", "year", "month", "day", tm.format_partial_date(F.col("year"), F.col("month"), F.col("day")).alias("date"))


_TOKENS = ("lt", " LTE ", "<", "<=", "-1", "gt", "GTE", ">", ">=", "+1", "1", "", "eq", "0")


@query("select k, token, case when lower(trim(token)) in ('lt','lte','<','<=','-1') then -1 when lower(trim(token)) in ('gt','gte','>','>=','+1','1') then 1 else 0 end as direction from " + dealt_sql(_TOKENS, "token"))
def parse_range(t: Tables) -> DataFrame:
    return dealt(t, _TOKENS, "token").select("k", "token", tm.parse_range(F.col("token")).alias("direction"))


@query("""select month, day, case when month between 1 and 12 then month else 0 end as m, case when day between 1 and 31 then day else 0 end as d
from (select cast(c_custkey%15 as int)-1 as month, cast(c_custkey%35 as int)-1 as day from customer)""")
def clamp_month_day(t: Tables) -> DataFrame:
    c = t.customer.select((F.col("c_custkey") % 15 - 1).cast("int").alias("month"), (F.col("c_custkey") % 35 - 1).cast("int").alias("day"))
    m, d = tm.clamp_month_day(F.col("month"), F.col("day"))
    return c.select("month", "day", m.alias("m"), d.alias("d"))


_STAMPS = ("+1879-03-14T00:00:00Z", "-0044-03-15T00:00:00Z", "+2001-00-00T00:00:00Z", "-13798000000-00-00T00:00:00Z", "-99999-01-02T00:00:00Z", "bad", "")


@query("select k, stamp, coalesce(try_cast(regexp_extract(stamp, '^([+-]?\\d+)-(\\d{2})-(\\d{2})', 1) as int), 0) as year, coalesce(try_cast(regexp_extract(stamp, '^([+-]?\\d+)-(\\d{2})-(\\d{2})', 2) as int), 0) as month, coalesce(try_cast(regexp_extract(stamp, '^([+-]?\\d+)-(\\d{2})-(\\d{2})', 3) as int), 0) as day from " + dealt_sql(_STAMPS, "stamp"))
def entity_time_text(t: Tables) -> DataFrame:
    y, m, d = tm.parse_time(F.col("stamp"))
    return dealt(t, _STAMPS, "stamp").select("k", "stamp", y.alias("year"), m.alias("month"), d.alias("day"))


# --- geography ---


@query(f"select id, round({km_sql(LAT, LON, 'latitude', 'longitude')}, 6) as km from entity_places", "entity_places")
def haversine(t: Tables) -> DataFrame:
    return t.entity_places.select("id", r6(geo.haversine_km(LAT, LON, F.col("latitude"), F.col("longitude"))).alias("km"))


_BOX = """with c as (select c_custkey as id, cast((c_custkey*7919)%18001 as double)/100.0-90.0 as lat, cast((c_custkey*104729)%36001 as double)/100.0-180.0 as lon, 50.0+(c_custkey%40)*100.0 as r from customer),
d as (select *, degrees(r/6371.0) as dd, degrees(asin(least(1.0, sin(r/6371.0)/cos(radians(lat))))) as s from c)
"""


@query(_BOX + """select id, round(greatest(lat-dd, -90.0),6) as low_lat, round(least(lat+dd, 90.0),6) as high_lat,
round(case when lat-dd<=-90 or lat+dd>=90 or lon-s<-180 or lon+s>180 then -180.0 else lon-s end,6) as low_lon,
round(case when lat-dd<=-90 or lat+dd>=90 or lon-s<-180 or lon+s>180 then 180.0 else lon+s end,6) as high_lon from d""")
def bbox(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 7919) % 18001).cast("double") / 100.0 - 90.0).alias("lat"), (((F.col("c_custkey") * 104729) % 36001).cast("double") / 100.0 - 180.0).alias("lon"), (50.0 + (F.col("c_custkey") % 40) * 100.0).alias("r"))
    box = geo.bounding_box(F.col("lat"), F.col("lon"), F.col("r"))
    return c.select("id", *(r6(b).alias(n) for b, n in zip(box, ("low_lat", "high_lat", "low_lon", "high_lon"), strict=True)))


_TILE = "cast(least(4095, greatest(0, floor((longitude+180)/360*4096))) as bigint)", "cast(least(4095, greatest(0, floor((1-ln(tan(radians(l))+1/cos(radians(l)))/pi())/2*4096))) as bigint)"


@query(f"select id, {_TILE[0]} as x, {_TILE[1]} as y from (select *, greatest(-85.05112878, least(85.05112878, latitude)) as l from entity_places)", "entity_places")
def latlon_to_tile(t: Tables) -> DataFrame:
    x, y = geo.tile_xy(F.col("latitude"), F.col("longitude"), 12)
    return t.entity_places.select("id", x.alias("x"), y.alias("y"))


@query("select c_custkey as id, round(degrees(atan(sinh(pi()*(1-2*((c_custkey*7)%1024+0.25)/1024)))),6) as lat, round(360.0*((c_custkey*3)%1024+0.5)/1024-180,6) as lon from customer")
def tile_to_latlon(t: Tables) -> DataFrame:
    lat, lon = geo.tile_point(10, (F.col("c_custkey") * 3) % 1024, (F.col("c_custkey") * 7) % 1024, 2048, 1024, 4096)
    return t.customer.select(F.col("c_custkey").alias("id"), r6(lat).alias("lat"), r6(lon).alias("lon"))


@query("select c_custkey as id, cast(1023-c_custkey%1024 as bigint) as row from customer")
def tms_flip(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), geo.tms_flip(F.lit(10), F.col("c_custkey") % 1024).alias("row"))


_HILBERT = """with recursive ids as (select c_custkey*37 as id from customer),
zs as (select id, (select max(k) from range(0,27) r(k) where (pow(4,k)-1)/3 <= id) as z from ids),
w(id, z, k, t, x, y) as (
 select id, z, cast(0 as bigint), cast(id-(pow(4,z)-1)/3 as bigint), cast(0 as bigint), cast(0 as bigint) from zs
 union all
 select id, z, k+1, t//4,
  case when ry=0 then (case when rx=1 then s-1-y else y end) else x end + s*rx,
  case when ry=0 then (case when rx=1 then s-1-x else x end) else y end + s*ry
 from (select *, cast(pow(2,k) as bigint) as s, (t//2)%2 as rx, xor(t%2, (t//2)%2) as ry from w where k < z))
select id, cast(z as int) as z, x, y from w where k=z"""


@query(_HILBERT)
def hilbert_zxy(t: Tables) -> DataFrame:
    c = t.customer.select((F.col("c_custkey") * 37).alias("id"))
    return c.select("id", geo.hilbert_zxy(F.col("id")).alias("p")).select("id", "p.z", "p.x", "p.y")


_V = "greatest(0.0, least(65535.99, e+32768))"


@query(f"select id, cast(floor(floor({_V})/256) as int) as red, cast(floor({_V})%256 as int) as green, cast(floor(({_V}-floor({_V}))*256) as int) as blue from (select c_custkey as id, cast((c_custkey*997)%80000-40000 as double)+0.25 as e from customer)")
def terrarium(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 997) % 80000 - 40000).cast("double") + 0.25).alias("e"))
    r, g, b = geo.terrarium(F.col("e"))
    return c.select("id", r.alias("red"), g.alias("green"), b.alias("blue"))


_GRID = "select (p_partkey-1)%40 as gx, (p_partkey-1)//40 as gy, cast(p_size*37%500 as double) as value from part"


@query(f"""with grid as ({_GRID}), h as (select max(gy)+1 as h from grid), p as (select c_custkey as id, (cast((c_custkey*104729)%36001 as double)/100.0)/360*40 as fx, greatest(0.0, least((180-cast((c_custkey*7919)%18001 as double)/100.0)/180*h, h-1.0)) as fy from customer, h),
s as (select id, floor(fx) as x0, floor(fy) as y0, fx-floor(fx) as wx, fy-floor(fy) as wy from p),
c as (select id, (cast(x0 as bigint)+i+40)%40 as gx, greatest(0, least((select h-1 from h), cast(y0 as bigint)+j)) as gy, (case when i=1 then wx else 1-wx end)*(case when j=1 then wy else 1-wy end) as w from s, (values (0,0),(0,1),(1,0),(1,1)) k(i,j))
select id, round(sum(w*value),6) as elevation from c join grid using (gx, gy) group by id""")
def bilinear(t: Tables) -> DataFrame:
    k = F.col("p_partkey") - 1
    grid = t.part.select((k % 40).alias("gx"), F.floor(k / 40).alias("gy"), ((F.col("p_size") * 37) % 500).cast("double").alias("value"))
    height = grid.agg(F.max("gy")).first()[0] + 1  # one number
    points = t.customer.select(F.col("c_custkey").alias("id"), (((F.col("c_custkey") * 7919) % 18001).cast("double") / 100.0 - 90.0).alias("lat"), (((F.col("c_custkey") * 104729) % 36001).cast("double") / 100.0 - 180.0).alias("lon"))
    return maps.bilinear(grid, points, 40, height).select("id", r6("elevation").alias("elevation"))


@query("""with c as (select c_custkey as centre_id, cast((c_custkey*7919)%12001 as double)/100.0-60.0 as lat, cast((c_custkey*104729)%30001 as double)/100.0-150.0 as lon from customer),
b as (select *, degrees(200/6371.0) as dd, degrees(asin(sin(200/6371.0)/cos(radians(lat)))) as s from c),
e as (select centre_id, cast(floor((lon-s+180)/360*64) as bigint) x0, cast(floor((lon+s+180)/360*64) as bigint) x1,
 cast(floor((1-ln(tan(radians(lat+dd))+1/cos(radians(lat+dd)))/pi())/2*64) as bigint) y0, cast(floor((1-ln(tan(radians(lat-dd))+1/cos(radians(lat-dd)))/pi())/2*64) as bigint) y1 from b)
select centre_id, 6 as zoom, x, y from e, range(0,64) r(x), range(0,64) q(y) where x between x0 and x1 and y between y0 and y1""")
def tile_cover(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("centre_id"), (((F.col("c_custkey") * 7919) % 12001).cast("double") / 100.0 - 60.0).alias("lat"), (((F.col("c_custkey") * 104729) % 30001).cast("double") / 100.0 - 150.0).alias("lon"))
    return maps.tile_cover(c, 200.0, 6)


@query("select round(latitude,4) as lat, round(longitude,4) as lon, count(*) as n from entity_places group by 1, 2", "entity_places")
def marker_clusters(t: Tables) -> DataFrame:
    return ev.marker_clusters(t.entity_places)


@query("""with c as (select c_custkey as id, radians(cast((c_custkey*7919)%18001 as double)/100.0-90.0) as la, radians(cast((c_custkey*104729)%36001 as double)/100.0-180.0) as lo, (50.0+(c_custkey%40)*10.0)/6371.0 as d from customer),
p as (select *, k % 64 * 2 * pi() / 64 as b from c, range(0, 65) r(k)), q as (select *, asin(greatest(-1.0, least(1.0, sin(la)*cos(d)+cos(la)*sin(d)*cos(b)))) as lat from p)
select id, cast(k as int) as k, round(degrees(lo + atan2(sin(b)*sin(d)*cos(la), cos(d)-sin(la)*sin(lat))), 4) as lon, round(degrees(lat), 4) as lat from q""")
def circle_polygon(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    c = t.customer.select(k.alias("id"), (((k * 7919) % 18001).cast("double") / 100.0 - 90.0).alias("lat"), (((k * 104729) % 36001).cast("double") / 100.0 - 180.0).alias("lon"), (50.0 + (k % 40) * 10.0).alias("radius_km"))
    return geo.circles(c).select("id", "k", F.round("lon", 4).alias("lon"), F.round("lat", 4).alias("lat"))


# --- events ---

_LABEL = "coalesce(e.title, 'T' || h.entity_id) as title, coalesce(e.description, '') as description, coalesce(e.article_id, 0) as article_id"
_KM = km_sql(LAT, LON, "latitude", "longitude")


def _events(hits: DataFrame, entities: DataFrame, *cols: str) -> DataFrame:
    out = ev.labelled(hits, entities)
    return out.select("entity_id", "prop_code", "title", "description", "article_id", *(r6(c).alias(c) if c == "distance_km" else c for c in cols))


@query(f"""select h.entity_id, h.prop_code, h.latitude, h.longitude, round(h.km,6) as distance_km, {_LABEL} from (
select * from (select *, row_number() over (partition by entity_id order by km, id) rn from (select *, {_KM} as km from entity_places) where km <= {RADIUS}) where rn=1 order by km, entity_id limit 50) h
left join entities e on e.id=h.entity_id""", "entities", "entity_places")
def events_radius(t: Tables) -> DataFrame:
    return _events(ev.by_place(t.entity_places, NEAR, 50), t.entities, "latitude", "longitude", "distance_km")


@query("select id, entity_id from entity_places where latitude between 30 and 50 and longitude between -20 and 40", "entity_places")
def events_bbox(t: Tables) -> DataFrame:
    box = tuple(F.lit(float(x)) for x in (30, 50, -20, 40))
    return t.entity_places.where(geo.in_box(F.col("latitude"), F.col("longitude"), box)).select("id", "entity_id")


_JD = lambda y, m, d: ev.When._jd(y, m, d)


def _timed(where: str, diff: str, order: str, limit: int = 100) -> str:
    return f"""select h.entity_id, h.prop_code, h.year, h.month, h.day, h.julian_day, cast({diff} as bigint) as time_diff, {_LABEL} from (
select * from (select *, row_number() over (partition by entity_id order by {order}, julian_day, prop_code) rn from entity_times where {where}) where rn=1 order by {order}, entity_id limit {limit}) h
left join entities e on e.id=h.entity_id"""


def _time_query(name: str, when: ev.When, where: str, diff: str, order: str) -> None:
    def run(t: Tables) -> DataFrame:
        return _events(ev.by_time(t.entity_times, when), t.entities, "year", "month", "day", "julian_day", "time_diff")

    QUERIES[name], SQL[name] = run, with_sql(_timed(where, diff, order), "entities", "entity_times")


_A, _B = _JD(1998, 1, 1), _JD(1998, 12, 31)
_time_query("events_time_year", ev.When(1998), f"julian_day between {_A} and {_B}", f"abs(julian_day-{_A})", f"abs(julian_day-{_A})")
_time_query("events_time_bce", ev.When(-45), f"julian_day between {_JD(-45, 1, 1)} and {_JD(-45, 12, 31)}", f"abs(julian_day-{_JD(-45, 1, 1)})", f"abs(julian_day-{_JD(-45, 1, 1)})")
_time_query("events_time_month_of_year", ev.When(1998, 2), f"julian_day between {_JD(1998, 2, 1)} and {_JD(1998, 2, 28)}", f"abs(julian_day-{_JD(1998, 2, 1)})", f"abs(julian_day-{_JD(1998, 2, 1)})")
_time_query("events_time_exact", ev.When(1998, 5, 17), f"julian_day = {_JD(1998, 5, 17)}", f"abs(julian_day-{_JD(1998, 5, 17)})", f"abs(julian_day-{_JD(1998, 5, 17)})")
_time_query("events_before", ev.When(1998, direction=-1), f"julian_day <= {_A}", f"abs(julian_day-{_A})", "julian_day desc")
_time_query("events_after", ev.When(1998, direction=1), f"julian_day >= {_B}", f"abs(julian_day-{_B})", "julian_day")
_time_query("events_month_day", ev.When(month=5, day=17), "month=5 and day=17", "0", "year desc")
_time_query("events_month", ev.When(month=5), "month=5", "0", "year desc")
_time_query("events_day", ev.When(day=17), "day=17", "0", "year desc")


@query(f"""select h.entity_id, h.prop_code, h.latitude, h.longitude, round(h.km,6) as distance_km, h.year, h.julian_day, h.time_diff, {_LABEL} from (
select * from (select *, row_number() over (partition by entity_id order by km, time_diff, julian_day, prop_code, place_id) rn from (
select p.entity_id, p.id as place_id, latitude, longitude, {_KM} as km, t.prop_code, year, julian_day, abs(julian_day-{_A}) as time_diff from entity_places p join entity_times t on t.entity_id=p.entity_id where julian_day between {_A} and {_B}) where km <= {RADIUS}) where rn=1 order by km, time_diff, entity_id limit 100) h
left join entities e on e.id=h.entity_id""", "entities", "entity_places", "entity_times")
def events_space_time(t: Tables) -> DataFrame:
    return _events(ev.by_place_and_time(t.entity_places, t.entity_times, NEAR, ev.When(1998)), t.entities, "latitude", "longitude", "distance_km", "year", "julian_day", "time_diff")


@query(f"""select c.id as centre_id, p.id as place_id, round({km_sql('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')},6) as distance_km
from entity_places c, entity_places p where {km_sql('c.latitude', 'c.longitude', 'p.latitude', 'p.longitude')} <= 500""", "entity_places")
def radius_join(t: Tables) -> DataFrame:
    p = t.entity_places
    return ev.radius_join(p.select(F.col("id").alias("centre_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), p, 500.0).select("centre_id", "place_id", r6("distance_km").alias("distance_km"))


_DATE = "(case when year<0 then '-' else '' end) || printf('%04d', abs(year)) || (case when month>0 then printf('-%02d', month) else '' end) || (case when month>0 and day>0 then printf('-%02d', day) else '' end)"
_ENVELOPE = f"""select entity_id, first(year order by julian_day, prop_code) as year_begin, first({_DATE} order by julian_day, prop_code) as date_begin, last({_DATE} order by julian_day, prop_code) as date_end,
count(*) as n_times, string_agg(julian_day || ':' || prop_code, ',' order by julian_day, prop_code) as times from entity_times group by entity_id"""


def _flat_times(df: DataFrame) -> DataFrame:
    return df.withColumn("times", F.array_join(F.transform("times", lambda x: F.concat(x["julian_day"].cast("string"), F.lit(":"), x["prop_code"].cast("string"))), ","))


@query(_ENVELOPE, "entity_times")
def entity_time_envelope(t: Tables) -> DataFrame:
    return _flat_times(ev.time_envelope(t.entity_times))


_PICK = f"""select entity_id, first(prop_code order by {_KM}, id) as prop_code, round(first(latitude order by {_KM}, id),6) as latitude, round(first(longitude order by {_KM}, id),6) as longitude, count(*) as n_places from entity_places group by entity_id"""


@query(_PICK, "entity_places")
def entity_place_pick(t: Tables) -> DataFrame:
    return ev.place_pick(t.entity_places, (LAT, LON)).select("entity_id", "prop_code", r6("latitude").alias("latitude"), r6("longitude").alias("longitude"), "n_places")


@query(f"""select coalesce(p.entity_id, m.entity_id) as entity_id, p.prop_code, p.latitude, p.longitude, p.n_places, m.year_begin, m.date_begin, m.date_end, m.n_times, m.times from
(select entity_id, first(prop_code order by case when prop_code=625 then 0 else 1 end, id) as prop_code, first(latitude order by case when prop_code=625 then 0 else 1 end, id) as latitude, first(longitude order by case when prop_code=625 then 0 else 1 end, id) as longitude, count(*) as n_places from entity_places group by entity_id) p
full join ({_ENVELOPE}) m on m.entity_id=p.entity_id""", "entity_places", "entity_times")
def entity_info(t: Tables) -> DataFrame:
    return _flat_times(ev.entity_info(t.entity_times, t.entity_places).drop("places"))


@query(f"select entity_id, last(prop_code order by julian_day, prop_code) as prop_code, last(year order by julian_day, prop_code) as year, max(julian_day) as julian_day from entity_times where julian_day <= {_B} group by entity_id", "entity_times")
def entity_asof_time(t: Tables) -> DataFrame:
    return ev.as_of(t.entity_times, _B).select("entity_id", "prop_code", "year", "julian_day")


# --- text ---

_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_TOKS = f"select id as doc, entity_id, list_concat({_WORDS.format('title')}, {_WORDS.format('content')}) as w from sections"


@query(f"select term, count(*) as n, count(distinct id) as docs from (select id, unnest({_WORDS.format('content')}) as term from sections) group by term", "sections")
def tokenize(t: Tables) -> DataFrame:
    p = lexical.build(t.sections, "id", [F.col("content")]).rows.where("term is not null")
    n, docs = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x), F.size(F.filter("docs", lambda x: x.isNotNull()))
    return p.groupBy("term").agg(F.sum(n).alias("n"), F.sum(docs.cast("long")).alias("docs"))


_ACC = T.ACCENTED + T.ACCENTED.upper().replace("Ÿ", "")
_PLN = T.PLAIN + T.PLAIN[:-1].upper()


@query(f"select id, md5(translate(content, '{_ACC}', '{_PLN}')) as folded from sections", "sections")
def fold_accents(t: Tables) -> DataFrame:
    return t.sections.select("id", F.md5(T.fold_accents(F.col("content")).cast("binary")).alias("folded"))


@query(f"select count(*) as docs, round(avg(len(w)),6) as average, (select count(distinct term) from (select unnest(w) as term from ({_TOKS}))) as terms from ({_TOKS})", "sections")
def bm25_stats(t: Tables) -> DataFrame:
    i = _stored(t)
    return lexical.stats(i).crossJoin(i.terms.agg(F.count_distinct("term").alias("terms"))).select("docs", r6("average").alias("average"), "terms")  # two single rows


def _index(t: Tables) -> lexical.Index:
    return lexical.build(t.sections, "id", [F.col("title"), F.col("content")])


_STORED: dict[tuple[str, str], lexical.Index] = {}


def _stored(t: Tables, name: str = "sections") -> lexical.Index:
    """A written index, made once a session and folder: queries read their own terms' postings only."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _STORED:
        made = _index(t) if name == "sections" else lexical.label_index(t.entities)
        _STORED[key] = lexical.written(made, f"{lines.scratch(t.spark)}/{name}-{len(_STORED)}")
    return _STORED[key]


@query(f"select id as doc from sections where list_contains({_WORDS.format('content')}, 'the')", "sections")
def lexical_unindexed(t: Tables) -> DataFrame:
    """Texts without a stored index: one scan of counting expressions."""
    return lexical.bm25(lexical.scan(t.sections, "id", [F.col("content")]), "the").select("doc")


def _bm25_sql(words: list[str], toks: str = _TOKS) -> str:
    tf = [f"(select doc, count(*) as tf, {k} as phrase from (select doc, unnest(w) as term from toks) where term='{w}' group by doc)" for k, w in enumerate(words)]
    return f"""toks as ({toks}), lens as (select doc, len(w) as len from toks), st as (select count(*) as docs, avg(len) as average from lens),
hits as ({' union all '.join('select * from ' + x for x in tf)}), dfs as (select phrase, count(*) as df from hits group by phrase),
bm as (select doc, sum(greatest(1e-6, ln((docs-df+0.5)/(df+0.5)))*tf*2.2/(tf+1.2*(0.25+0.75*len/average))) as score from hits join dfs using (phrase) join lens using (doc), st group by doc having count(*)={len(words)})"""


def _full(sql: str, ctes: str, *names: str) -> str:
    """Further common table expressions after the views'."""
    base = with_sql("", *names).rstrip()
    return f"{base}, {ctes}\n{sql}"


_TOP = """select h.entity_id, h.doc, coalesce(e.title, h.stitle) as title, coalesce(e.article_id,0) as article_id, round(h.score,6) as score, round((1-exp(-0.1*greatest(0,h.score)))*100,6) as power{code} from (
select * from (select b.doc, b.score, s.entity_id, s.title as stitle{codes}, row_number() over (partition by s.entity_id order by score desc, doc) rn from {bm} b join sections s on s.id=b.doc{joins}) where rn=1 order by score desc, entity_id limit 10) h
left join entities e on e.id=h.entity_id"""


def _lexical(df: DataFrame, *more: str) -> DataFrame:
    return df.select("entity_id", "doc", "title", "article_id", r6("score").alias("score"), r6("power").alias("power"), *more)


@query()
def lexical_bm25(t: Tables) -> DataFrame:
    return _lexical(lexical.search_sections(t.sections, t.entities, _stored(t), WORDS))


SQL["lexical_bm25"] = _full(_TOP.format(code="", codes="", joins="", bm="bm"), _bm25_sql(["the", "with"]), "entities", "sections")


@query()
def lexical_space(t: Tables) -> DataFrame:
    return _lexical(lexical.search_sections(t.sections, t.entities, _stored(t), WORDS, places=t.entity_places, near=NEAR), "code")


SQL["lexical_space"] = _full(_TOP.format(code=", h.code", codes=", n.code", joins=" join near n on n.entity_id=s.entity_id", bm="bm"), _bm25_sql(["the", "with"]) + f", near as (select entity_id, first(prop_code order by {_KM}, id) as code from entity_places where {_KM} <= {RADIUS} group by entity_id)", "entities", "sections", "entity_places")


@query()
def lexical_time(t: Tables) -> DataFrame:
    return _lexical(lexical.search_sections(t.sections, t.entities, _stored(t), WORDS, times=t.entity_times, when=ev.When(1998)), "code")


SQL["lexical_time"] = _full(_TOP.format(code=", h.code", codes=", n.code", joins=" join timed_hits n on n.entity_id=s.entity_id", bm="bm"), _bm25_sql(["the", "with"]) + f", timed_hits as (select entity_id, first(prop_code order by julian_day, prop_code) as code from entity_times where julian_day between {_A} and {_B} group by entity_id)", "entities", "sections", "entity_times")


@query()
def lexical_overfetch(t: Tables) -> DataFrame:
    return _lexical(lexical.search_sections(t.sections, t.entities, _stored(t), WORDS, overfetch=True))


SQL["lexical_overfetch"] = _full(_TOP.format(code="", codes="", joins="", bm="(select * from bm order by score desc, doc limit 60)"), _bm25_sql(["the", "with"]), "entities", "sections")

_LTOKS = f"select id as doc, {_WORDS.format(f"translate(title, '{_ACC}', '{_PLN}')")} as w from entities"


@query()
def label_bm25(t: Tables) -> DataFrame:
    e = t.entities
    return lexical.search_labels(e, _stored(t, "labels"), "Customer#000000007").select("entity_id", "title", "article_id", r6("score").alias("score"), r6("power").alias("power"), "description")


_LP = f"""toks as ({_LTOKS}), lens as (select doc, len(w) as len from toks), st as (select count(*) as docs, avg(len) as average from lens),
hits as (select doc, cast(len(list_filter(list_zip(w, w[2:]), lambda p: p[1]='customer' and p[2]='000000007')) as bigint) as tf from toks), hit as (select * from hits where tf > 0), d as (select count(*) as df from hit)"""
SQL["label_bm25"] = _full("""select doc as entity_id, coalesce(e.title, 'Q' || doc) as title, coalesce(e.article_id,0) as article_id, round(score,6) as score, round((1-exp(-0.1*greatest(0,score)))*100,6) as power, coalesce(e.description,'') as description from (
select doc, greatest(1e-6, ln((docs-df+0.5)/(df+0.5)))*tf*2.2/(tf+1.2*(0.25+0.75*len/average)) as score from hit join lens using (doc), st, d order by score desc, doc limit 10) left join entities e on e.id=doc""", _LP, "entities")


@query("select id, case when length(content) > 160 then substring(content,1,160) || '...' else content end as snippet from sections", "sections")
def snippet_trunc(t: Tables) -> DataFrame:
    return t.sections.select("id", T.truncated(F.col("content")).alias("snippet"))


@query()
def snippet_mark(t: Tables) -> DataFrame:
    return lexical.search_sections(t.sections, t.entities, _stored(t), WORDS).select("entity_id", "doc", "snippet")


#: the hits' snippets: the first run of 32 words, begun at a match, with most different query words
_SNIPS = f"""pick as (select * from (select b.doc, b.score, s.entity_id, s.title as stitle, s.content, row_number() over (partition by s.entity_id order by score desc, doc) rn from bm b join sections s on s.id=b.doc) where rn=1 order by score desc, entity_id limit 10),
piece as (select doc, unnest(ps) as p, generate_subscripts(ps, 1) as spot from (select doc, string_split_regex(trim(content), '\\s+') as ps from pick)),
tok as (select distinct doc, spot, term from (select doc, spot, unnest({_WORDS.format('p')}) as term from piece) where term in ('the', 'with')),
ends as (select doc, max(spot) as n from piece group by doc),
run as (select a.doc, least(a.spot, greatest(1, n-31)) as s, count(distinct b.term) as k from (select distinct doc, spot from tok) a join ends using (doc) join tok b on b.doc=a.doc and b.spot between a.spot and a.spot+31 group by a.doc, a.spot, n),
begun as (select doc, n, coalesce(first(s order by k desc, s), 1) as s from ends left join run using (doc) group by doc, n),
snips as (select doc, case when s>1 then '...' else '' end || string_agg(case when (doc, spot) in (select (doc, spot) from tok) then '<mark>' || p || '</mark>' else p end, ' ' order by spot) || case when s+32<=n then '...' else '' end as snippet from piece join begun using (doc) where spot between s and s+31 group by doc, s, n)"""
SQL["snippet_mark"] = _full("select entity_id, doc, snippet from pick join snips using (doc)", ", ".join([_bm25_sql(["the", "with"]), _SNIPS]), "entities", "sections")


@query("select entity_id, id, pow from (select *, row_number() over (partition by entity_id order by pow desc, id) rn from sections) where rn=1", "sections")
def dedupe_entity(t: Tables) -> DataFrame:
    return merge.first_by(t.sections, ["entity_id"], F.desc("pow"), "id").select("entity_id", "id", "pow")


@query("select word, len(list_filter(string_split_regex(lower(word), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as tokens from (values ('the'), ('foo-bar'), ('\"q\"'), ('--')) v(word)")
def fts_sanitize(t: Tables) -> DataFrame:
    rows = [(w, sum(len(p) for p in T.query_phrases(w))) for w in ("the", "foo-bar", '"q"', "--")]
    return t.spark.createDataFrame(rows, "word string, tokens long")


# --- vectors ---

_QV = "(select list_transform(embedding, lambda x: cast(x as double)) as q from embeddings where vec_id=7)"
_D = "list_transform(embedding, lambda x: cast(x as double))"


def _query_vector(t: Tables, size: int = 64):
    row = t.embeddings.where("vec_id = 7").select("embedding").first()  # one vector, the query
    return semantic.query_vector([float(x) for x in row[0]], size)


@query(f"select id, round(list_dot_product({_D}, q),6) as cosine from vectors, {_QV}", "vectors")
def vec_dot(t: Tables) -> DataFrame:
    q = t.embeddings.where("vec_id = 7").select(F.col("embedding").alias("q"))  # one row
    return t.vectors.crossJoin(F.broadcast(q)).select("id", r6(vector.dot(F.col("embedding"), F.col("q"))).alias("cosine"))


_UNIT = "list_transform(v, lambda x: round(x/sqrt(list_dot_product(v,v)),6))"
_JOINED = "array_to_string(list_transform({0}, lambda x: cast(cast(round(x*1000) as bigint) as varchar)), ',')"


@query(f"select id, round(list_sum({_UNIT}),4) as total from (select id, list_transform(embedding, lambda x: cast(x as double)*3) as v from vectors)", "vectors")
def vec_l2norm(t: Tables) -> DataFrame:
    v = vector.normalized(F.transform(vector.doubles(F.col("embedding")), lambda x: x * 3))
    return t.vectors.select("id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.round(x, 6)), 4).alias("total"))


@query(f"select id, len(v) as size, round(v[1]/sqrt(list_dot_product(v,v)),6) as first from (select id, list_transform(embedding, lambda x: cast(x as double))[1:16] as v from vectors)", "vectors")
def mrl_truncate(t: Tables) -> DataFrame:
    v = semantic.prepared(t.vectors, 16)
    return v.select("id", F.size("v").cast("long").alias("size"), r6(F.col("v")[0]).alias("first"))


@query("with n as (select id, row_number() over (order by id)-1 as r, count(*) over () as c from vectors) select cast(i as int) as cluster, id from n, range(0,5) k(i) where r = i*c//5".replace("with n as", "select * from (with n as") + ")", "vectors")
def ann_seeds(t: Tables) -> DataFrame:
    return semantic.seeds(semantic.prepared(t.vectors), 5).select("cluster", "id")


def _fixed_centroids(t: Tables):
    import numpy as np

    rows = t.embeddings.where("vec_id < 5").orderBy("vec_id").select("embedding").collect()  # five centroids
    return np.array([semantic.query_vector([float(x) for x in r[0]]) for r in rows])


_ASSIGN = f"select id, cast(first(c.vec_id order by list_dot_product({_D}, c.u) desc, c.vec_id) as int) as cluster from vectors, (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as u from embeddings where vec_id < 5) c group by id"


@query(_ASSIGN, "vectors")
def ann_assign(t: Tables) -> DataFrame:
    return semantic.assign(semantic.prepared(t.vectors), _fixed_centroids(t)).select("id", "cluster")


@query(f"select cluster, cast(rn//20 as int) as chunk, cast(rn%20 as int) as position, id from (select *, row_number() over (partition by cluster order by id)-1 as rn from ({_ASSIGN}))", "vectors")
def ann_chunks(t: Tables) -> DataFrame:
    return semantic.inverted_lists(semantic.assign(semantic.prepared(t.vectors), _fixed_centroids(t)), 20).drop("v")


@query()
def ann_centroids(t: Tables) -> DataFrame:
    c = semantic.fit(t.vectors, 64, 100)
    return t.spark.createDataFrame([(i, k, round(float(x), 6)) for i, r in enumerate(c) for k, x in enumerate(r)], "id int, k int, value double")


def _kmeans_sql(rounds: int) -> str:
    """Spherical k-means from strided seeds, a round a pair of common table expressions."""
    steps = [f"""unit as materialized (select id, list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) as v from (select id, {_D}[1:64] as v from vectors) where len(v)=64 and list_dot_product(v, v)>0),
size as (select count(*) as n, greatest(1, count(*)//100) as k from unit),
c0 as materialized (select i, v from (select v, row_number() over (order by id)-1 as r from unit) join (select n, k, unnest(range(k)) as i from size) on r = i*n//k)"""]
    for r in range(1, rounds + 1):
        steps.append(f"""a{r} as materialized (select u.id, arg_max(c.i, {{'d': list_dot_product(u.v, c.v), 'i': -c.i}}) as i from unit u, c{r-1} c group by u.id),
s{r} as (select a.i, j, sum(u.v[j]) as s from a{r} a join unit u using (id), range(1, 65) q(j) group by a.i, j),
c{r} as materialized (select o.i, coalesce(m.v, o.v) as v from c{r-1} o left join (select i, list(s/sqrt(z) order by j) as v from s{r} join (select i, sum(s*s) as z from s{r} group by i) using (i) group by i) m on m.i=o.i)""")
    return ", ".join(steps)


SQL["ann_centroids"] = _full(f"select cast(i as int) as id, cast(j-1 as int) as k, round(v[j], 6) as value from c{semantic.ROUNDS}, range(1, 65) q(j)", _kmeans_sql(semantic.ROUNDS), "vectors")


@query(f"select cast(vec_id as int) as cluster from embeddings, {_QV} where vec_id < 5 order by list_dot_product({_D}, q) desc limit 3")
def ann_probe(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in semantic.probes(_query_vector(t), _fixed_centroids(t))], "cluster int")


@query(f"select id, round(list_dot_product(list_transform(embedding, lambda x: cast(x as double)), q),6) as cosine from vectors join ({_ASSIGN}) a using (id), {_QV} where a.cluster in (select vec_id from embeddings, {_QV} where vec_id < 5 order by list_dot_product({_D}, q) desc limit 3) order by cosine desc, id limit 10", "vectors")
def ann_search(t: Tables) -> DataFrame:
    c = _fixed_centroids(t)
    return semantic.search(semantic.assign(semantic.prepared(t.vectors), c), _query_vector(t), c).select("id", r6("cosine").alias("cosine"))


_SEM = f"select id as doc, list_dot_product({_D}, q) as score from vectors, {_QV}"


@query(f"""select h.entity_id, h.doc, coalesce(e.title, h.stitle) as title, coalesce(e.article_id,0) as article_id, round(h.score,6) as cosine, round(greatest(0,least(100,(h.score+1)/2*100)),4) as power from (
select * from (select b.doc, b.score, s.entity_id, s.title as stitle, row_number() over (partition by s.entity_id order by score desc, doc) rn from ({_SEM}) b join sections s on s.id=b.doc) where rn=1 order by score desc, entity_id limit 10) h
left join entities e on e.id=h.entity_id""", "vectors", "entities", "sections")
def semantic_topk(t: Tables) -> DataFrame:
    hits = semantic.exact(t.vectors, _query_vector(t))
    return semantic.search_sections(hits, t.sections, t.entities).select("entity_id", "doc", "title", "article_id", r6("cosine").alias("cosine"), F.round("power", 4).alias("power"))


@query("select s.id, s.entity_id from sections s where not exists (select 1 from vectors v where v.id=s.id)", "sections", "vectors")
def pending_sections_anti(t: Tables) -> DataFrame:
    return semantic.pending(t.sections, t.vectors).select("id", "entity_id")


@query("select s.id, md5('save: ' || coalesce(e.title, s.title, '') || chr(10) || chr(10) || s.content) as input from sections s left join entities e on e.id=s.entity_id", "sections", "entities")
def embed_input(t: Tables) -> DataFrame:
    return semantic.embedding_input(t.sections, t.entities, "save: ").select("id", F.md5(F.col("input").cast("binary")).alias("input"))


@query()
def embed_hash(t: Tables) -> DataFrame:
    made = semantic.embed(semantic.embedding_input(t.sections, t.entities))
    return made.select("id", F.posexplode("embedding").alias("k", "value")).withColumn("value", r6(F.col("value").cast("double")))


# crc32 byte by byte, of each distinct word once
SQL["embed_hash"] = _full("select o.id, cast(k as int) as k, round(cast(cast(coalesce(s, 0)/sqrt(greatest(1, z)) as float) as double), 6) as value from (select id, unnest(range(64)) as k from input) o left join sums using (id, k) left join (select id, sum(s*s) as z from sums group by id) using (id)", """
input as materialized (select s.id, lower(coalesce(e.title, s.title, '') || chr(10) || chr(10) || coalesce(s.content, '')) as t from sections s left join entities e on e.id=s.entity_id),
used as materialized (select id, w, count(*) as n from (select id, unnest(string_split_regex(t, '\\s+')) as w from input) where w <> '' group by id, w),
crcs as (select list(v order by n) as tab from (select n, list_reduce(list_prepend(n, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(n))),
marks as materialized (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(w))), lambda i: cast('0x' || substr(hex(encode(w)), 2*i+1, 2) as bigint))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) as h from (select distinct w from used), crcs),
sums as materialized (select id, h % 64 as k, sum(case when h >= 2147483648 then n else -n end) as s from used join marks using (w) group by id, h % 64)""", "entities", "sections")


# --- hybrid ---


def _lists(t: Tables) -> list[DataFrame]:
    e = t.entities
    lab = lexical.search_labels(e, _stored(t, "labels"), "Customer#000000007")
    lex = lexical.search_sections(t.sections, e, _stored(t), WORDS)
    sem = semantic.search_sections(semantic.exact(t.vectors, _query_vector(t)), t.sections, e)
    return [hybrid.ranked(lab, 0, "score"), hybrid.ranked(lex, 1, "score"), hybrid.ranked(sem, 2, "cosine")]


_L0 = "select 0 as list, doc as entity_id, score from (select doc, greatest(1e-6, ln((docs-df+0.5)/(df+0.5)))*tf*2.2/(tf+1.2*(0.25+0.75*len/average)) as score from hit join llens using (doc), lst, d order by score desc, doc limit 10)"
_BEST = "select {n} as list, entity_id, score from (select * from (select s.entity_id, score, row_number() over (partition by s.entity_id order by score desc, doc) rn from ({b}) b join sections s on s.id=b.doc) where rn=1 order by score desc, entity_id limit 10)"
_LP2 = _LP.replace("toks as", "ltoks as").replace("from toks", "from ltoks").replace("lens as", "llens as").replace("from lens", "from llens").replace("st as (", "lst as (").replace("hits as", "lhits as").replace("from hits", "from lhits")
_FUSED = f"fused as (select *, row_number() over (partition by list order by score desc, entity_id) as rk from ({_L0} union all {_BEST.format(n=1, b='select * from bm')} union all {_BEST.format(n=2, b=_SEM)}))"


@query()
def hybrid_rrf(t: Tables) -> DataFrame:
    return hybrid.fuse(_lists(t), 20).select("entity_id", r6("rrf").alias("rrf"), r6("power").alias("power"), "n_lists")


SQL["hybrid_rrf"] = _full("select entity_id, round(sum(1.0/(60+rk)),6) as rrf, round(sum(1.0/(60+rk))/((select count(distinct list) from fused)/61.0)*100,6) as power, count(*) as n_lists from fused group by entity_id order by sum(1.0/(60+rk)) desc, entity_id limit 20", ", ".join([_LP2, _bm25_sql(["the", "with"]), _FUSED]), "entities", "sections", "vectors")


@query()
def hybrid_merge_fields(t: Tables) -> DataFrame:
    return hybrid.fuse(_lists(t), 20).select("entity_id", "type", "title", "article_id", "snippet")


_FIELDS = f"""spick as (select * from (select b.doc, s.entity_id, s.title as stitle, s.content, row_number() over (partition by s.entity_id order by score desc, doc) rn from ({_SEM}) b join sections s on s.id=b.doc) where rn=1),
shown as (select f.list, f.entity_id, case f.list when 0 then 'T' when 1 then 'L' else 'S' end as kind, coalesce(e.title, p.stitle, q.stitle) as title, coalesce(e.article_id, 0) as article_id,
 case f.list when 0 then coalesce(nullif(e.description,''), '<mark>' || e.title || '</mark>') when 1 then p.snippet else case when length(q.content)>160 then substring(q.content,1,160) || '...' else q.content end end as snippet
 from fused f left join entities e on e.id=f.entity_id left join (pick join snips using (doc)) p on f.list=1 and p.entity_id=f.entity_id left join spick q on f.list=2 and q.entity_id=f.entity_id),
best20 as (select entity_id from fused group by entity_id order by sum(1.0/(60+rk)) desc, entity_id limit 20),
wide as (select entity_id, case when count(*)>1 then 'H' else min(kind) end as type, first(title order by list) as title, max(article_id) as article_id, coalesce(max(snippet) filter (list=0),'') as s0, coalesce(max(snippet) filter (list=1),'') as s1, coalesce(max(snippet) filter (list=2),'') as s2 from shown join best20 using (entity_id) group by entity_id),
two as (select *, case when contains(s1,'<mark>') or (not contains(s0,'<mark>') and strlen(s1)>strlen(s0)) then s1 else s0 end as s01 from wide)"""
SQL["hybrid_merge_fields"] = _full("select entity_id, type, title, article_id, case when contains(s2,'<mark>') or (not contains(s01,'<mark>') and strlen(s2)>strlen(s01)) then s2 else s01 end as snippet from two", ", ".join([_LP2, _bm25_sql(["the", "with"]), _SNIPS, _FUSED, _FIELDS]), "entities", "sections", "vectors")


# --- merges and ingestion ---

#: what the generated dump's lines (view `dump`, k the customer's number) must give by the rules of the import
_TITLE = "case when k%11=0 then null when k%7=0 then 'Nom ' || k else 'Name ' || k end"
_HAS_TIME, _HAS_PLACE, _HAS_LINK = "(k%3=0 and k%21<>0)", "(k%4=0 and (k%8=0 or k%12=0))", "(k%10=0)"
_YEAR = "cast(case when k%2=0 then k%2000 else -(k%2000) end as int)"


def _claims(t: Tables) -> DataFrame:
    return ingest.parsed(ingest.relevant(ingest.records(t.dump)))


@query("select count(*) as lines, count(*) filter (k%3=0 or k%4=0 or k%5=0) as relevant from dump", "dump")
def entity_prefilter(t: Tables) -> DataFrame:
    rows = ingest.records(t.dump)
    hit = F.col("value").rlike('"P(' + "|".join(map(str, ingest.RELEVANT)) + ')"')
    return rows.agg(F.count("*").alias("lines"), F.sum(hit.cast("long")).alias("relevant"))


@query(f"select k as id, {_TITLE} as title, case when k%7=0 then 'de ' || k else 'about ' || k end as description from dump where k%11<>0 and ({_HAS_TIME} or {_HAS_PLACE} or {_HAS_LINK})", "dump")
def entity_parse(t: Tables) -> DataFrame:
    return ingest.entities(_claims(t))


@query(f"select k as entity_id, 625 as prop_code, k%90+0.5 as latitude, -(k%180+0.25) as longitude, (k%3+1)/10.0 as precision from dump where k%11<>0 and {_HAS_PLACE}".replace("k%90+0.5", "cast(k%90+0.5 as double)").replace("-(k%180+0.25)", "cast(-(k%180+0.25) as double)").replace("(k%3+1)/10.0", "cast((k%3+1)/10.0 as double)"), "dump")
def entity_places_parsed(t: Tables) -> DataFrame:
    return ingest.places(_claims(t))


@query(f"select k as entity_id, 569 as prop_code, {_YEAR} as year, cast(k%13 as int) as month, cast(k%29 as int) as day, {jdn_sql(_YEAR, '(k%13)', '(k%29)')} as julian_day from dump where k%11<>0 and {_HAS_TIME}", "dump")
def entity_times_parsed(t: Tables) -> DataFrame:
    return ingest.times(_claims(t))


@query(f"select k as id, 19 as code, k%97+1 as value from dump where k%11<>0 and {_HAS_LINK}", "dump")
def entity_links_parsed(t: Tables) -> DataFrame:
    return ingest.links(_claims(t))


@query(f"select k as id, {_TITLE} as title from dump", "dump")
def label_pick(t: Tables) -> DataFrame:
    e = ingest.records(t.dump).select(F.from_json("value", ingest.SCHEMA).alias("e")).select("e.*")
    title, _ = ingest.label_pick(F.col("labels"), F.col("descriptions"))
    return e.select(X.entity_number(F.col("id")).alias("id"), F.nullif(title, F.lit("")).alias("title"))


def _own(t: Tables) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in ("entities", "entity_times", "entity_places", "sections", "settings", "vectors")}


_IMPORTED = f"""fresh as (select k as id, {_TITLE} as title, case when k%7=0 then 'de ' || k else 'about ' || k end as description from dump where k%11<>0 and ({_HAS_TIME} or {_HAS_PLACE} or {_HAS_LINK})),
named as (select coalesce(o.id, n.id) as id, o.article_id, case when n.id is null then o.title when o.title is not null and o.title<>'' then o.title else n.title end as title, case when n.id is null then o.description else n.description end as description from entities o full join fresh n on n.id=o.id),
own as (select entity_id, prop_code, latitude, longitude, precision from entity_places union all select k, 625, cast(k%90+0.5 as double), cast(-(k%180+0.25) as double), cast((k%3+1)/10.0 as double) from dump where k%11<>0 and {_HAS_PLACE}),
linked as (select * from own union all select distinct d.k, 19, p.latitude, p.longitude, p.precision from dump d join own p on p.entity_id=d.k%97+1 where d.k%11<>0 and {_HAS_LINK.replace("k%", "d.k%")})"""


@query()
def import_entities(t: Tables) -> DataFrame:
    return ingest.import_entities(t.dump, _own(t))["entities"]


SQL["import_entities"] = with_sql("", "entities", "entity_places", "dump").rstrip() + f", {_IMPORTED} select * from named"


@query()
def import_places(t: Tables) -> DataFrame:
    return ingest.import_entities(t.dump, _own(t))["entity_places"].drop("id")


SQL["import_places"] = with_sql("", "entities", "entity_places", "dump").rstrip() + f", {_IMPORTED} select distinct l.* from linked l join named n on n.id=l.entity_id where n.title<>'' and latitude between -90 and 90 and longitude between -180 and 180"


@query("select qid, try_cast(substring(qid,2) as bigint) as id from (select 'Q' || c_custkey as qid from customer union all select 'Qx' union all select '')")
def qid_cast(t: Tables) -> DataFrame:
    q = t.customer.select(F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid")).union(t.spark.createDataFrame([("Qx",), ("",)], "qid string"))
    return q.select("qid", X.entity_number(F.col("qid")).alias("id"))


_NEW = "new as (select c_custkey+750 as id, cast(900000+c_custkey as bigint) as article_id, 'New ' || c_custkey as title, case when c_custkey%3=0 then null else 'fresh' end as description from customer)"


def _new(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select((k + 750).alias("id"), (k + 900000).alias("article_id"), F.concat(F.lit("New "), k.cast("string")).alias("title"), F.when(k % 3 != 0, "fresh").alias("description"))


@query()
def upsert_keep_title(t: Tables) -> DataFrame:
    return merge.upsert_keep_title(t.entities, _new(t))


SQL["upsert_keep_title"] = _full("select coalesce(o.id, n.id) as id, o.article_id, case when n.id is null then o.title when o.title is not null and o.title<>'' then o.title else n.title end as title, case when n.id is null then o.description else n.description end as description from entities o full join new n on n.id=o.id", _NEW, "entities")


@query()
def upsert_overwrite_title(t: Tables) -> DataFrame:
    return merge.upsert_overwrite_title(t.entities, _new(t))


SQL["upsert_overwrite_title"] = _full("select coalesce(o.id, n.id) as id, case when n.id is null then o.article_id else n.article_id end as article_id, case when n.id is null then o.title else n.title end as title, o.description from entities o full join new n on n.id=o.id", _NEW, "entities")


@query("select * from entity_times", "entity_times")
def times_dedup(t: Tables) -> DataFrame:
    return t.entity_times


@query("select event_type, user_id, event_id from (select *, row_number() over (partition by event_type, user_id order by event_id desc) rn from events) where rn=1")
def replace_last_wins(t: Tables) -> DataFrame:
    return merge.last_wins(t.events, ["event_type", "user_id"], "event_id").select("event_type", "user_id", "event_id")


@query("select id from (select id, latitude*1.2 as latitude, longitude*1.1 as longitude from entity_places) where latitude between -90 and 90 and longitude between -180 and 180", "entity_places")
def places_prune_range(t: Tables) -> DataFrame:
    p = t.entity_places
    return merge.prune_range(p.withColumns({"latitude": p["latitude"] * 1.2, "longitude": p["longitude"] * 1.1})).select("id")


@query("select id, entity_id from entity_places where entity_id in (select id from entities where title is not null and title<>'')", "entity_places", "entities")
def places_prune_semi(t: Tables) -> DataFrame:
    return merge.prune_unnamed(t.entity_places, t.entities).select("id", "entity_id")


@query("select distinct l.id as entity_id, l.code as prop_code, p.latitude, p.longitude, p.precision from links l join entity_places p on p.entity_id=l.value", "links", "entity_places")
def link_places_distinct(t: Tables) -> DataFrame:
    return merge.resolve_links(t.links, t.entity_places)


def _store(t: Tables) -> dict[str, DataFrame]:
    """Another store's tables: articles by entity (some of none), sections without `pow`, vectors, settings."""
    k = F.col("c_custkey")
    a = t.customer.select((k + 5000).alias("id"), F.when(k % 9 == 0, "X1").otherwise(F.concat(F.lit("Q"), (k + 700).cast("string"))).alias("entity"), F.concat(F.lit("Other "), k.cast("string")).alias("title"))
    s = t.documents.select((F.col("doc_id") + 40).alias("id"), (F.col("doc_id") % 150 + 5001).alias("article_id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return {"articles": a, "sections": s, "setup": t.settings.union(t.spark.createDataFrame([("model", "m"), ("other", "x")], "key string, value string")), "vectors": t.vectors.select((F.col("id") + 100).alias("id"), "embedding")}


_STORE = """arts as (select c_custkey+5000 as id, 'Q' || (c_custkey+700) as entity, c_custkey+700 as entity_id, 'Other ' || c_custkey as title from customer where c_custkey%9<>0),
secs as (select d.doc_id+40 as id, a.entity_id, d.source as title, d.text as content, 0 as pow from documents d join arts a on a.id=d.doc_id%150+5001)"""


@query()
def import_compat(t: Tables) -> DataFrame:
    return ingest.import_store(_store(t), _own(t))["sections"].withColumn("content", F.md5(F.col("content").cast("binary")))


SQL["import_compat"] = _full("select id, entity_id, title, md5(content) as content, pow from secs union all select id, entity_id, title, md5(content), pow from sections where id not in (select id from secs)", _STORE, "sections")


@query()
def import_compat_entities(t: Tables) -> DataFrame:
    return ingest.import_store(_store(t), _own(t))["entities"]


SQL["import_compat_entities"] = _full("select coalesce(o.id, n.entity_id) as id, coalesce(n.id, o.article_id) as article_id, case when n.id is null then o.title else n.title end as title, o.description from entities o full join arts n on n.entity_id=o.id", _STORE, "entities")


@query("select key, value from settings union all select 'model', 'm'", "settings")
def import_compat_settings(t: Tables) -> DataFrame:
    return ingest.import_store(_store(t), _own(t))["settings"]


_META = '{"name":"demo","minzoom":"0","maxzoom":14,"bounds":[1,2],"nested":{"a":1}}'


@query(f"""select 'map_' || key as key, case when type='VARCHAR' then json_extract_string(value,'$') else cast(value as varchar) end as value from json_each('{_META}')""")
def json_flatten(t: Tables) -> DataFrame:
    return merge.flat_settings(t.spark.createDataFrame([(_META,)], "json string"))


@query("select count(*) as n from entities", "entities")
def entity_count(t: Tables) -> DataFrame:
    return t.entities.agg(F.count("*").alias("n"))


@query("select coalesce(max(case when key='map_minzoom' then cast(value as int) end),0) as minzoom, coalesce(max(case when key='map_maxzoom' then cast(value as int) end),14) as maxzoom, cast(split_part(max(case when key='map_center' then value end),',',1) as double) as lon, cast(split_part(max(case when key='map_center' then value end),',',2) as double) as lat, cast(split_part(max(case when key='map_center' then value end),',',3) as double) as zoom from (select * from settings)".replace("cast(value as int)", "try_cast(value as int)"), "settings")
def map_config(t: Tables) -> DataFrame:
    return merge.map_config(t.settings)


@query("select value from settings where key='map_bounds'", "settings")
def settings_get(t: Tables) -> DataFrame:
    return merge.get_setting(t.settings, "map_bounds")


@query("select key, value from settings where key<>'map_maxzoom' union all select 'map_maxzoom', '12' union all select 'extra', 'x'", "settings")
def settings_put(t: Tables) -> DataFrame:
    return merge.put_settings(t.settings, t.spark.createDataFrame([("map_maxzoom", "12"), ("extra", "x")], "key string, value string"))


@query("select prop_code, case prop_code when 569 then 'Date of birth' when 571 then 'Inception' when 585 then 'Point in time' else 'Event P' || prop_code end as label, count(*) as n from (select prop_code from entity_times union all select 4242) group by 1, 2", "entity_times")
def property_label(t: Tables) -> DataFrame:
    codes = t.entity_times.select("prop_code").union(t.spark.createDataFrame([(4242,)], "prop_code int"))
    return ingest.with_label(codes.groupBy("prop_code").agg(F.count("*").alias("n"))).select("prop_code", "label", "n")


# --- maps, models, articles ---


@query("select cast(c_custkey%8 as int) as zoom, cast(c_custkey as int) as col, cast(c_nationkey as int) as row, 'blob ' || c_nationkey as tile_data from customer")
def tiles_view(t: Tables) -> DataFrame:
    data, shallow = maps.blob_dedup(_tiles(t))
    return maps.tiles_view(shallow, data)


def _tiles(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") % 8).cast("int").alias("zoom"), F.col("c_custkey").cast("int").alias("col"), F.col("c_nationkey").cast("int").alias("row"), F.col("c_nationkey").alias("offset"), F.concat(F.lit("blob "), F.col("c_nationkey").cast("string")).alias("tile_data"))


@query("select distinct c_nationkey as tile_data_id, 'blob ' || c_nationkey as tile_data from customer")
def tile_blob_dedup(t: Tables) -> DataFrame:
    return maps.blob_dedup(_tiles(t))[0]


@query("select cast(sum(least(1+p_size, 30000-p_partkey*20)) as bigint) as tiles from part where p_partkey*20 < 30000")
def tile_run_count(t: Tables) -> DataFrame:
    return maps.run_count(t.part.select((F.col("p_partkey") * 20).alias("tile_id"), (F.col("p_size") + 1).cast("long").alias("run_length")), 30000)


@query("select cast(c_custkey%8 as int) as zoom, cast(c_custkey as int) as col, cast(c_nationkey as int) as row from customer where c_custkey%8=5 and c_custkey=13 and c_nationkey=31-(select 31-max(c_nationkey) from customer where c_custkey=13)")
def tile_fetch(t: Tables) -> DataFrame:
    row = t.customer.where("c_custkey = 13").first()["c_nationkey"]  # one row
    return maps.fetch(_tiles(t), 5, 13, 31 - row).select("zoom", "col", "row")


_PROPS = "select c_custkey as raw, 'layer' || c_nationkey as layer, case when c_custkey%3=0 then null when c_custkey%3=1 then '' else 'k' || c_custkey%7 end as kind, case when c_custkey%5=0 then 'd' when c_custkey%5=1 then '' end as detail from customer"


@query(f"select raw, raw || ':' || layer || case when nullif(detail,'') is not null then ':' || coalesce(nullif(kind,''),'') || ':' || detail when nullif(kind,'') is not null then ':' || kind else '' end as id from ({_PROPS})")
def composite_id(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    c = t.customer.select(k.alias("raw"), F.concat(F.lit("layer"), F.col("c_nationkey").cast("string")).alias("layer"), F.when(k % 3 == 1, "").when(k % 3 == 2, F.concat(F.lit("k"), (k % 7).cast("string"))).alias("kind"), F.when(k % 5 == 0, "d").when(k % 5 == 1, "").alias("detail"))
    return c.select("raw", X.composite_id(F.col("raw"), F.col("layer"), X.filled(F.col("kind")), X.filled(F.col("detail"))).alias("id"))


_HEIGHTS = ("12", "12 m", "3.5M", " 7m ", "x", "", "1e2")


@query("select k, raw, try_cast(regexp_replace(trim(raw), '\\s*[mM]$', '') as double) as metres from " + dealt_sql(_HEIGHTS, "raw"))
def parse_height(t: Tables) -> DataFrame:
    return dealt(t, _HEIGHTS, "raw").select("k", "raw", X.metres(F.col("raw")).alias("metres"))


@query("select entity_id as id, round(avg(latitude),6) as lat, round(avg(longitude),6) as lon, min(latitude) as min_lat, max(latitude) as max_lat, min(longitude) as min_lon, max(longitude) as max_lon from entity_places group by entity_id", "entity_places")
def centroid_box(t: Tables) -> DataFrame:
    f = t.entity_places.groupBy(F.col("entity_id").alias("id")).agg(F.array(F.collect_list(F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))).alias("geometry"))
    return maps.centroid_box(f).withColumns({"lat": r6("lat"), "lon": r6("lon")})


@query(f"select entity_id as id from entity_places group by entity_id having min({_KM}) <= {RADIUS}", "entity_places")
def feature_radius(t: Tables) -> DataFrame:
    f = t.entity_places.groupBy(F.col("entity_id").alias("id")).agg(F.array(F.collect_list(F.struct(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")))).alias("geometry"))
    return f.where(maps.within(F.col("geometry"), LAT, LON, RADIUS)).select("id")


@query("select c_custkey as n, case when c_custkey%2=0 then c_custkey//2 else -(c_custkey+1)//2 end as value from customer")
def zigzag(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("n"), X.zigzag(F.col("c_custkey")).alias("value"))


@query("select dims, cast(split_part(dims,',',1) as bigint) as d0, cast(split_part(dims,',',2) as bigint) as d1 from (select c_custkey || ',' || c_nationkey as dims from customer)")
def tensor_dims(t: Tables) -> DataFrame:
    c = t.customer.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")).alias("dims"))
    return c.select("dims", X.dims(F.col("dims"))[0].alias("d0"), X.dims(F.col("dims"))[1].alias("d1"))


_TENSORS = ("token_embd.weight", "blk.0.attn_q.weight", "blk.27.ffn_up.weight", "output_norm.weight", "output.weight", "rope")


@query("select k, name, case when name like 'token_embd%' then -1 when name like 'blk.%' then cast(split_part(name,'.',2) as int) when name like 'output_norm%' then 99 else 999 end as layer from " + dealt_sql(_TENSORS, "name"))
def tensor_layer(t: Tables) -> DataFrame:
    return dealt(t, _TENSORS, "name").select("k", "name", X.tensor_layer(F.col("name")).alias("layer"))


@query("select id, substring(content, 5, 12) as piece from sections", "sections")
def blob_slice(t: Tables) -> DataFrame:
    from waymark.sources.lines import slice_blob

    return slice_blob(t.sections.select("id", F.col("content").alias("piece")), "piece", 4, 12)


@query("select e.id, e.id as entity_id, e.article_id, coalesce(nullif(e.title,''),'Untitled') as title, (select count(*) from sections where entity_id=7) as n_sections from entities e where e.id=7", "entities", "sections")
def article_get(t: Tables) -> DataFrame:
    return articles.get(t.sections, t.entities, 7).select("id", "entity_id", "article_id", "title", F.size("sections").cast("long").alias("n_sections"))


@query("select md5('# ' || title || ' (ID: ' || entity_id || ')' || chr(10) || chr(10) || body) as markdown, entity_id from (select s.entity_id, coalesce(nullif(max(e.title),''), nullif(first(s.title order by s.id),''), 'Untitled') as title, string_agg(case when s.title<>'' then '## ' || s.title || chr(10) else '' end || s.content || chr(10) || chr(10), '' order by s.id) as body from sections s left join entities e on e.id=s.entity_id group by s.entity_id)", "entities", "sections")
def article_markdown(t: Tables) -> DataFrame:
    return articles.markdown(articles.assembled(t.sections, t.entities)).select("entity_id", F.md5(F.col("markdown").cast("binary")).alias("markdown"))


@query("""select '{' || concat_ws(',', '"id":' || id, '"article_id":' || article_id, '"title":"' || nullif(title, '') || '"', '"description":"' || nullif(description, '') || '"') || '}' as json from entities""", "entities")
def json_output(t: Tables) -> DataFrame:
    return articles.as_json(t.entities)


@query("select page_id, cast(len(regexp_extract_all(html, '<h1>')) as bigint) as n from pages where regexp_matches(html, '<h1>')")
def html_headings(t: Tables) -> DataFrame:
    from waymark.sources.html import sections_of

    cut = F.pandas_udf(sections_of, "array<struct<title: string, content: string, pow: int>>")
    p = t.pages.select("page_id", F.explode(cut("html")).alias("s")).where("s.pow = 1")
    return p.groupBy("page_id").agg(F.count("*").alias("n"))


#: text of a piece of html: no tags, references as characters, trimmed
_PLAIN_HTML = "trim(replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13))"
_JOINED = "array_to_string(list_filter(list_transform({0}, lambda x: " + _PLAIN_HTML.format("x") + "), lambda x: x <> ''), chr(10) || chr(10))"


# the test pages have list items before their only heading, and paragraphs after it
@query(f"""with body as (select page_id, regexp_replace(html, '(?is)<!--.*?-->|<style.*?</style>|<script.*?</script>', '', 'g') as h from pages),
cut as (select page_id, regexp_extract_all(h, '(?s)<li>(.*?)</li>', 1) as items, replace(regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1), '&amp;', '&') as title, string_split_regex(regexp_extract(h, '(?s)</h1>(.*?)</article>', 1), '</?p>') as parts from body),
found as (select page_id as entity_id, '' as title, {_JOINED.format('items')} as content, 0 as pow from cut union all select page_id, title, {_JOINED.format('parts')}, 1 from cut)
select * from found where content <> ''""")
def html_sections(t: Tables) -> DataFrame:
    a = t.pages.select(F.col("page_id").alias("entity_id"), F.lit("").alias("title"), "html")
    return ingest.sections(a).select("entity_id", "title", "content", "pow")


def _sample_tiles(t: Tables) -> DataFrame:
    from waymark.sources import samples

    square = [[(0, 0), (400, 0), (400, 400), (0, 400)]]
    blobs = [(14, x, 2**14 - 1 - y, samples.tile([(7, 3, square, {"kind": "park", "height": "12 m"}), (x + 1, 1, [[(2048, 2048)]], {"class": "cafe", "ele": 3.5})], zipped=bool(x % 2))) for x in range(8752, 8766) for y in range(6085, 6099)]
    return t.spark.createDataFrame(blobs, "zoom int, col int, row int, tile_data binary")


_TILE_POINT = "round(({x}) / 16384.0 * 360 - 180, 6) as lon, round(degrees(atan(sinh(pi() * (1 - 2 * ({y}) / 16384.0)))), 6) as lat"


@query(f"""with t as (select x, y from range(8752, 8766) a(x), range(6085, 6099) b(y))
select '7:places:park' as id, cast(7 as bigint) as raw_id, 'places' as layer, 12.0::double as height, null::double as elevation, cast(5 as int) as vertices, {_TILE_POINT.format(x='x', y='y')} from t
union all select (x + 1) || ':places:cafe', x + 1, 'places', null, 3.5::double, 1, {_TILE_POINT.format(x='x + 0.5', y='y + 0.5')} from t""")
def map_features(t: Tables) -> DataFrame:
    from waymark.sources.vector_tiles import features

    f = maps.named(features(_sample_tiles(t))).withColumn("p", F.flatten("geometry"))
    return f.select("id", "raw_id", "layer", "height", "elevation", F.size("p").alias("vertices"), r6(F.col("p")[0]["lon"]).alias("lon"), r6(F.col("p")[0]["lat"]).alias("lat"))


#: the sample's features around the centre as SQL: cover (x, y) and corner (id, raw_id, kind, x, y, j, lon, lat)
_NEAR_TILES = f"""b as (select {LAT} as lat, {LON} as lon, degrees(3/6371.0) as dd, degrees(asin(sin(3/6371.0)/cos(radians({LAT})))) as s),
cover as (select x, y from b, range(8752, 8766) a(x), range(6085, 6099) q(y) where x between floor((lon-s+180)/360*16384) and floor((lon+s+180)/360*16384)
 and y between floor((1-ln(tan(radians(lat+dd))+1/cos(radians(lat+dd)))/pi())/2*16384) and floor((1-ln(tan(radians(lat-dd))+1/cos(radians(lat-dd)))/pi())/2*16384)),
spot as (select '7:places:park' as id, 7 as raw_id, 'park' as kind, x, y, j, x + u/4096.0 as px, y + v/4096.0 as py from cover, (values (0,0,0), (1,400,0), (2,400,400), (3,0,400), (4,0,0)) c(j,u,v)
 union all select (x+1) || ':places:cafe', x + 1, 'cafe', x, y, 0, x + 0.5, y + 0.5 from cover),
corner as (select id, cast(raw_id as bigint) as raw_id, kind, x, y, j, px/16384*360-180 as lon, degrees(atan(sinh(pi()*(1-2*py/16384)))) as lat from spot)"""


@query(f"""with {_NEAR_TILES}, hit as (select id, x, y from corner group by all having min({km_sql(LAT, LON, 'lat', 'lon')}) <= 3)
select id, 'places' as layer, case when min(kind)='park' then 'Polygon' else 'Point' end as kind, case when min(kind)='park' then 12.0::double end as height, case when min(kind)='cafe' then 3.5::double end as elevation,
 round(avg(lat),6) as lat, round(avg(lon),6) as lon, round(min(lat),6) as min_lat, round(max(lat),6) as max_lat, round(min(lon),6) as min_lon, round(max(lon),6) as max_lon
from corner join hit using (id, x, y) group by id order by id limit 50""")
def map_centroids(t: Tables) -> DataFrame:
    found = maps.centroids(_sample_tiles(t), LAT, LON, 3000, 14, 50)
    return found.drop("props").withColumns({c: r6(c) for c in ("lat", "lon", "min_lat", "max_lat", "min_lon", "max_lon")})


@query(f"""with {_NEAR_TILES}
select id, raw_id, 'places' as layer, 'Polygon' as kind, 12.0::double as height, cast(row_number() over (order by x, y, j) - 1 as int) as k, round(lon,6) as lon, round(lat,6) as lat from corner where id='7:places:park'""")
def map_feature(t: Tables) -> DataFrame:
    found = maps.feature_by_id(_sample_tiles(t), LAT, LON, "7:places:park", 3000, 14)
    corners = found.select("id", "raw_id", "layer", "kind", "height", F.posexplode(F.flatten("geometry")).alias("k", "p"))
    return corners.select("id", "raw_id", "layer", "kind", "height", "k", r6(F.col("p.lon")).alias("lon"), r6(F.col("p.lat")).alias("lat"))


@query("select 'p' || p_partkey as name, cast(k as int) as k, cast(p_size / 4.0 * (k - 16) as double) as value from part, range(0, 32) r(k)")
def dequant_q8(t: Tables) -> DataFrame:
    import struct

    from waymark.sources.model_file import Q8_0, dequantized

    block = F.pandas_udf(lambda s: s.map(lambda v: struct.pack("<e32b", v / 4, *range(-16, 16))), "binary")
    rows = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.lit(Q8_0).alias("dtype"), block("p_size").alias("data"))
    return dequantized(rows).select("name", F.posexplode("values").alias("k", "value")).withColumn("value", F.col("value").cast("double"))


#: a byte's number: printable bytes first
_BYTE = "case when b between 33 and 126 then b-33 when b between 161 and 172 then b-67 when b>=174 then b-68 when b<=32 then b+188 when b<=160 then b+94 else 255 end"
# none of the four merges' letters meet another merge's, so the pieces are the longest words among them
_PIECES = """case when {0} is not null then array_to_string(list_append(flatten(list_transform(regexp_extract_all({0}, 'the|th|and|an|[\\s\\S]'),
 lambda g: case g when 'th' then [256] when 'the' then [257] when 'an' then [258] when 'and' then [259]
 else list_transform(list_transform(range(octet_length(encode(g))), lambda i: cast('0x' || substr(hex(encode(g)), 2*i+1, 2) as int)), lambda b: {1}) end)), 260), ' ') end"""


@query(f"select id, {_PIECES.format('title', _BYTE)} as title_ids, {_PIECES.format('content', _BYTE)} as ids from sections", "sections")
def bpe_encode(t: Tables) -> DataFrame:
    import numpy as np

    from waymark.sources.model_file import BytePairs, byte_letters

    letters = list(byte_letters().values())
    merges = ["t h", "th e", "a n", "an d"]
    vocabulary = {w: i for i, w in enumerate([*letters, *(m.replace(" ", "") for m in merges), "<end>"])}
    codec = BytePairs(vocabulary, merges, ("<end>",), vocabulary["<end>"])
    bound_batches(t.spark)  # of whole texts
    encode = F.pandas_udf(lambda s: s.map(lambda x: np.array(codec.encode(x), np.int32), na_action="ignore"), "array<int>")
    return t.sections.select("id", *(F.array_join(encode(c).cast("array<string>"), " ").alias(n) for c, n in (("title", "title_ids"), ("content", "ids"))))


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value),4) as total from events group by 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    from waymark.streaming.sync import windowed_counts as counts

    return counts(t.events)


# --- plain SQL, inherited from the engine's SQL entry ---


@query("select l_returnflag, l_linestatus, round(sum(l_quantity),2) as qty, count(*) as n from lineitem group by rollup (l_returnflag, l_linestatus)")
def facet_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("select event_type, cast(user_id%3 as bigint) as g, count(*) as n from events group by cube (event_type, cast(user_id%3 as bigint))")
def facet_cube(t: Tables) -> DataFrame:
    return t.events.withColumn("g", F.col("user_id") % 3).cube("event_type", "g").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

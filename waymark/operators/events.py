"""Event search by place, date or both; the entity's times and places; joins by radius."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.time import format_partial_date
from waymark.operators.merge import first_by


@dataclass(frozen=True)
class When:
    """A date known to the year, month or day; direction -1: up to it, 0: at it, 1: from it on."""

    year: int | None = None
    month: int | None = None
    day: int | None = None
    direction: int = 0

    @staticmethod
    def _jd(y: int, m: int, d: int) -> int:
        a = (14 - m) // 12
        y = y + 4800 - a
        q = lambda n, k: int(n / k) if n < 0 else n // k  # noqa: E731  towards zero
        return d + (153 * (m + 12 * a - 3) + 2) // 5 + 365 * y + q(y, 4) - q(y, 100) + q(y, 400) - 32045

    @staticmethod
    def _days(y: int, m: int) -> int:
        leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
        return 29 if m == 2 and leap else 28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31

    def bounds(self) -> tuple[int, int]:
        y, m, d = self.year or 0, self.month or 0, self.day or 0
        if not m:
            return self._jd(y, 1, 1), self._jd(y, 12, 31)
        return (self._jd(y, m, d), self._jd(y, m, d)) if d else (self._jd(y, m, 1), self._jd(y, m, self._days(y, m)))

    def target(self) -> int:
        """What distances in time are measured from: the end of the period for dates from it on (February: 28)."""
        y, m, d = self.year or 0, self.month or 0, self.day or 0
        if self.direction > 0:
            m = m or 12
            d = d or (28 if m == 2 else self._days(y, m))
        return self._jd(y, m or 1, d or 1)

    def predicate(self) -> Column:
        """Constants are worked out here, so that the filter reaches the scan."""
        if self.year:
            low, high = self.bounds()
            if self.direction < 0:
                return F.col("julian_day") <= low
            if self.direction > 0:
                return F.col("julian_day") >= high
            return F.col("julian_day").between(low, high) if low != high else F.col("julian_day") == low
        out = F.lit(True)
        if self.month:
            out &= F.col("month") == self.month
        if self.day:
            out &= F.col("day") == self.day
        return out

    def given(self) -> bool:
        return bool(self.year or self.month or self.day)

    def order(self) -> list[Column]:
        if not self.year:
            return [F.desc("year")]
        if self.direction:
            return [F.desc("julian_day") if self.direction < 0 else F.asc("julian_day")]
        return [F.abs(F.col("julian_day") - self.target())]


@dataclass(frozen=True)
class Near:
    lat: float
    lon: float
    radius_km: float = 100.0

    def places(self, places: DataFrame) -> DataFrame:
        """Places in the circle with distance_km; the box is what the scan can use."""
        km = geo.haversine_km(self.lat, self.lon, F.col("latitude"), F.col("longitude"))
        box = geo.bounding_box(self.lat, self.lon, self.radius_km)
        return places.where(geo.in_box(F.col("latitude"), F.col("longitude"), box)).withColumn("distance_km", km).where(F.col("distance_km") <= self.radius_km)


def labelled(hits: DataFrame, entities: DataFrame, letter: str = "T") -> DataFrame:
    """title, description and article_id of the few rows that are left."""
    e = entities.select(F.col("id").alias("entity_id"), "title", "description", "article_id")
    return hits.join(e, "entity_id", "left").withColumns({
        "title": F.coalesce("title", F.concat(F.lit(letter), F.col("entity_id").cast("string"))),
        "description": F.coalesce("description", F.lit("")),
        "article_id": F.coalesce("article_id", F.lit(0).cast("long")),
    })


def by_place(places: DataFrame, near: Near, limit: int = 100) -> DataFrame:
    hit = near.places(places).select("entity_id", "prop_code", "latitude", "longitude", "distance_km", "id")
    best = hit.groupBy("entity_id").agg(F.min_by(F.struct("prop_code", "latitude", "longitude", "distance_km"), F.struct("distance_km", "id")).alias("b"))
    return best.select("entity_id", "b.*").orderBy("distance_km", "entity_id").limit(limit)


def by_time(times: DataFrame, when: When, limit: int = 100) -> DataFrame:
    diff = F.abs(F.col("julian_day") - when.target()) if when.year else F.lit(0).cast("long")
    hit = times.where(when.predicate())
    order = [*when.order(), "julian_day", "prop_code"]
    return first_by(hit, ["entity_id"], *order).withColumn("time_diff", diff).orderBy(*when.order(), "entity_id").limit(limit)


def by_place_and_time(places: DataFrame, times: DataFrame, near: Near, when: When, limit: int = 100) -> DataFrame:
    p = near.places(places).select("entity_id", "latitude", "longitude", "distance_km", F.col("id").alias("place_id"))
    diff = F.abs(F.col("julian_day") - when.target()) if when.year else F.lit(0).cast("long")
    both = p.join(times.where(when.predicate()), "entity_id").withColumn("time_diff", diff)
    order = [F.col("distance_km"), F.col("time_diff")] if not when.direction or not when.year else when.order()
    return first_by(both, ["entity_id"], *order, "distance_km", "julian_day", "prop_code", "place_id").drop("place_id").orderBy(*order, "entity_id").limit(limit)


def search(places: DataFrame, times: DataFrame, entities: DataFrame, near: Near | None = None, when: When | None = None, limit: int = 100) -> DataFrame | None:
    """One row per entity in rank order; None without a place and a date."""
    timed = when is not None and when.given()
    if near and timed:
        order = [F.col("distance_km"), F.col("time_diff")] if not when.direction or not when.year else when.order()
        return labelled(by_place_and_time(places, times, near, when, limit), entities).orderBy(*order, "entity_id")
    if near:
        return labelled(by_place(places, near, limit), entities).orderBy("distance_km", "entity_id")
    return labelled(by_time(times, when, limit), entities).orderBy(*when.order(), "entity_id") if timed else None


def time_envelope(times: DataFrame) -> DataFrame:
    """First and last date of each entity and all its times in order."""
    date = format_partial_date(F.col("year"), F.col("month"), F.col("day"))
    row = F.struct("julian_day", "prop_code", "year", "month", "day", date.alias("date"))
    key = F.struct("julian_day", "prop_code")
    return times.groupBy("entity_id").agg(
        F.min_by("year", key).alias("year_begin"), F.min_by(date, key).alias("date_begin"), F.max_by(date, key).alias("date_end"),
        F.count("*").alias("n_times"), F.sort_array(F.collect_list(row)).alias("times"),
    )


def place_pick(places: DataFrame, target: tuple[float, float] | None = None) -> DataFrame:
    """Each entity's place: nearest to the target, else property 625, else the first."""
    if target and target != (0.0, 0.0):
        key = F.struct(geo.haversine_km(*target, F.col("latitude"), F.col("longitude")).alias("km"), "id")
    else:
        key = F.struct(F.when(F.col("prop_code") == 625, 0).otherwise(1).alias("k"), "id")
    return places.groupBy("entity_id").agg(F.min_by(F.struct("prop_code", "latitude", "longitude"), key).alias("p"), F.count("*").alias("n_places"), F.sort_array(F.collect_list(F.struct("id", "prop_code", "latitude", "longitude"))).alias("places")).select("entity_id", "p.*", "n_places", "places")


def entity_info(times: DataFrame, places: DataFrame, target: tuple[float, float] | None = None) -> DataFrame:
    """Place and time of every entity that has either: one join instead of two look-ups a hit."""
    return place_pick(places, target).join(time_envelope(times), "entity_id", "full")


def as_of(times: DataFrame, julian_day: int) -> DataFrame:
    """Each entity's last time up to a day."""
    key = F.struct("julian_day", "prop_code")
    return times.where(F.col("julian_day") <= julian_day).groupBy("entity_id").agg(F.max_by(F.struct("prop_code", "year", "month", "day", "julian_day"), key).alias("t")).select("entity_id", "t.*")


def radius_join(centres: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """(centre_id, place_id, distance_km) of all places within the radius of each centre.

    centres: centre_id, lat, lon. The globe is cut in latitude bands as high as the radius and cells as wide as
    the radius at the band's pole-side edge; a centre goes to the cells that its circle's box meets, places to
    their one cell, and the two meet by an equi-join that can be shuffled and split. Bands in which a circle
    can reach round a pole have one cell.
    """
    step = radius_km / geo.EARTH_KM * 180 / 3.141592653589793
    band = lambda lat: F.floor((lat + 90) / step)

    def cells(b: Column) -> Column:
        """Cells of a band."""
        edge = F.greatest(F.abs(b * step - 90), F.abs((b + 1) * step - 90))
        return F.greatest(F.lit(1), F.when(edge >= 90, 1).otherwise(F.floor(360 * F.cos(F.radians(edge)) / step))).cast("long")

    cell = lambda lon, b: F.floor((lon + 180) / 360 * cells(b)).cast("long") % cells(b)
    p = places.select(F.col("id").alias("place_id"), "latitude", "longitude", band(F.col("latitude")).alias("band"))
    p = p.withColumn("cell", cell(F.col("longitude"), F.col("band")))
    low, high, west, east = geo.bounding_box(F.col("lat"), F.col("lon"), radius_km)
    c = centres.withColumns({"west": west, "east": east, "band": F.explode(F.sequence(band(low), band(high)))})
    first, last = F.floor((F.col("west") + 180) / 360 * cells(F.col("band"))), F.floor((F.col("east") + 180) / 360 * cells(F.col("band")))
    c = c.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda k: (k % cells(F.col("band"))).cast("long")))))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    # never broadcast: Spark expects few rows of a small file, but a centre has one for each of its cells
    return c.join(p.hint("merge"), ["band", "cell"]).withColumn("distance_km", km).where(F.col("distance_km") <= radius_km).select("centre_id", "place_id", "distance_km")


def marker_clusters(places: DataFrame) -> DataFrame:
    """Places at the same coordinates, to four decimals."""
    return places.groupBy(F.round("latitude", 4).alias("lat"), F.round("longitude", 4).alias("lon")).agg(F.count("*").alias("n"))

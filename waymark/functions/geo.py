"""Distances, bounding boxes and map tiles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.sources.batches import spread

EARTH_KM = 6371.0
#: Latitudes beyond this have no Web Mercator tile
MERCATOR_LAT = 85.05112878


def _c(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), a))
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bounding_box(lat, lon, radius_km) -> tuple[Column, Column, Column, Column]:
    """(low lat, high lat, low lon, high lon) that hold a circle; all longitudes if it meets a pole or the date line."""
    lat, lon, radius_km = map(_c, (lat, lon, radius_km))
    d = radius_km / EARTH_KM
    low, high = F.greatest(lat - F.degrees(d), F.lit(-90.0)), F.least(lat + F.degrees(d), F.lit(90.0))
    spread = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(d) / F.cos(F.radians(lat)))))
    all_round = (lat - F.degrees(d) <= -90) | (lat + F.degrees(d) >= 90) | (d >= math.pi / 2) | (lon - spread < -180) | (lon + spread > 180)
    return low, high, F.when(all_round, -180.0).otherwise(lon - spread), F.when(all_round, 180.0).otherwise(lon + spread)


def in_box(lat: Column, lon: Column, box: tuple[Column, Column, Column, Column]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def tile_xy(lat, lon, zoom) -> tuple[Column, Column]:
    lat, lon = _c(lat), _c(lon)
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    r = F.radians(F.greatest(F.lit(-MERCATOR_LAT), F.least(F.lit(MERCATOR_LAT), lat)))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n)
    keep = lambda v: F.greatest(F.lit(0), F.least(v, (n - 1).cast("long"))).cast("long")
    return keep(x), keep(y)


def tile_point(zoom, x, y, px, py, extent) -> tuple[Column, Column]:
    """Latitude and longitude of a place (px, py of extent) in a tile."""
    n = F.pow(F.lit(2.0), _c(zoom))
    wx, wy = (_c(x) + _c(px) / _c(extent)) / n, (_c(y) + _c(py) / _c(extent)) / n
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * wy)))), 360 * wx - 180


def tms_flip(zoom: Column, y: Column) -> Column:
    return F.pow(F.lit(2.0), zoom).cast("long") - 1 - y


def first_tile_id(zoom: Column) -> Column:
    """Tiles of all smaller zooms."""
    return ((F.pow(F.lit(4.0), zoom) - 1) / 3).cast("long")


def hilbert_zxy(tile_id: Column) -> Column:
    """struct(z, x, y) of a Hilbert-ordered tile id (zoom 0 to 26)."""
    zooms = F.sequence(F.lit(0), F.lit(26))
    z = F.array_max(F.filter(zooms, lambda k: first_tile_id(k) <= tile_id))
    start = F.struct((tile_id - first_tile_id(z)).alias("t"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))

    def step(s: Column, k: Column) -> Column:
        side = F.pow(F.lit(2.0), k).cast("long")
        rx = (F.floor(s["t"] / 2) % 2).cast("long")
        ry = (s["t"] % 2).bitwiseXOR(rx).cast("long")
        fx = F.when((ry == 0) & (rx == 1), side - 1 - s["x"]).otherwise(s["x"])
        fy = F.when((ry == 0) & (rx == 1), side - 1 - s["y"]).otherwise(s["y"])
        nx, ny = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        return F.struct(F.floor(s["t"] / 4).cast("long").alias("t"), (nx + side * rx).alias("x"), (ny + side * ry).alias("y"))

    levels = F.when(z > 0, F.sequence(F.lit(0), z - 1)).otherwise(F.array().cast("array<int>"))
    got = F.aggregate(levels, start, step)
    return F.struct(z.cast("int").alias("z"), got["x"].alias("x"), got["y"].alias("y"))


def terrarium(elevation: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of an elevation in metres."""
    v = F.greatest(F.lit(0.0), F.least(F.lit(65535.99), elevation + 32768))
    whole = F.floor(v)
    return F.floor(whole / 256).cast("int"), (whole % 256).cast("int"), F.floor((v - whole) * 256).cast("int")


def _at(lat: Column, radius_km: Column) -> tuple[Column, Column, Column, Column]:
    """Sine and cosine of a centre's latitude and of its circle's radius."""
    d = radius_km / EARTH_KM
    return F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(d), F.cos(d)


def _corner_lat(sin_lat, cos_lat, sin_d, cos_d, b: Column) -> Column:
    """In radians, like all here: of the place in direction b."""
    return F.asin(sin_lat * cos_d + cos_lat * sin_d * F.cos(b))


def _corner_lon(sin_lat, cos_lat, sin_d, cos_d, lon, b: Column, corner_lat: Column) -> Column:
    return lon + F.atan2(F.sin(b) * sin_d * cos_lat, cos_d - sin_lat * F.sin(corner_lat))


def circles(centres: DataFrame, points: int = 64) -> DataFrame:
    """id, k, lon, lat: the places k of a closed polygon around each centre (id, lat, lon, radius_km). A row a place
    from the start: places in an array would be worked out one by one, without compiled code."""
    at = [a.alias(f"a{i}") for i, a in enumerate(_at(F.col("lat"), F.col("radius_km")))]
    rows = spread(centres).select("id", F.radians("lon").alias("lo"), *at).select("*", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("k"))
    at = [F.col(f"a{i}") for i in range(4)]
    rows = rows.withColumn("b", F.col("k") % points * (2 * math.pi / points)).withColumn("la", _corner_lat(*at, F.col("b")))
    return rows.select("id", "k", F.degrees(_corner_lon(*at, F.col("lo"), F.col("b"), F.col("la"))).alias("lon"), F.degrees("la").alias("lat"))


def circle(lat, lon, radius_km, points: int = 64) -> Column:
    """A closed polygon of `points` places around a centre."""
    at, lon = _at(*map(_c, (lat, radius_km))), F.radians(_c(lon))
    step = 2 * math.pi / points

    def place(i: Column) -> Column:
        la = _corner_lat(*at, i * step)
        return F.struct(F.degrees(_corner_lon(*at, lon, i * step, la)).alias("lon"), F.degrees(la).alias("lat"))

    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(points - 1)), F.array(F.lit(0))), place)


def view_radius_km(span_lat: Column, span_lon: Column) -> Column:
    """Search radius of a map view, in degrees: 0.8 of its smaller span, 0.01 at least."""
    return F.greatest(F.lit(0.01), 0.8 * F.least(span_lat, span_lon))

"""Map tiles: cover of a circle, features, centroids, tile tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.tiles import composite_id, filled, metres


def tile_cover(centres: DataFrame, radius_km: float, zoom: int) -> DataFrame:
    """(centre_id, zoom, x, y) of the tiles that a circle's box meets; centres: centre_id, lat, lon."""
    low, high, west, east = geo.bounding_box(F.col("lat"), F.col("lon"), radius_km)
    x0, y0 = geo.tile_xy(high, west, zoom)
    x1, y1 = geo.tile_xy(low, east, zoom)
    c = centres.select("centre_id", F.explode(F.sequence(x0, x1)).alias("x"), y0.alias("y0"), y1.alias("y1"))
    return c.select("centre_id", F.lit(zoom).alias("zoom"), "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def tiles_view(shallow: DataFrame, data: DataFrame) -> DataFrame:
    """Tiles with their blobs: equal blobs are stored once."""
    return shallow.join(data, "tile_data_id").select("zoom", "col", "row", "tile_data")


def blob_dedup(tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tile_data_id, tile_data) once each, and (zoom, col, row, tile_data_id); tiles: zoom, col, row, offset, tile_data."""
    data = tiles.groupBy(F.col("offset").alias("tile_data_id")).agg(F.first("tile_data").alias("tile_data"))
    return data, tiles.select("zoom", "col", "row", F.col("offset").alias("tile_data_id"))


def fetch(tiles: DataFrame, zoom: int, x: int, y: int) -> DataFrame:
    """A tile by the row number counted from the north."""
    return tiles.where((F.col("zoom") == zoom) & (F.col("col") == x) & (F.col("row") == 2**zoom - 1 - y))


def run_count(entries: DataFrame, most: int) -> DataFrame:
    """Tiles with ids below `most`; entries: tile_id, run_length."""
    return entries.where(F.col("tile_id") < most).agg(F.coalesce(F.sum(F.least(F.col("run_length"), most - F.col("tile_id"))), F.lit(0)).cast("long").alias("tiles"))


def within(geometry: Column, lat: float, lon: float, radius_km: float) -> Column:
    """Whether any vertex lies in the circle; geometry: rings of (lon, lat)."""
    return F.exists(F.flatten(geometry), lambda p: geo.haversine_km(lat, lon, p["lat"], p["lon"]) <= radius_km)


def centroid_box(features: DataFrame) -> DataFrame:
    """Mean of all vertices and the box of each feature; features: id, geometry."""
    p = features.select("id", F.explode(F.flatten("geometry")).alias("p"))
    lat, lon = F.col("p.lat"), F.col("p.lon")
    return p.groupBy("id").agg(F.avg(lat).alias("lat"), F.avg(lon).alias("lon"), F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"))


def named(features: DataFrame) -> DataFrame:
    """Raw features (raw_id, layer, kind, props, geometry, zoom, x, y) with their composite ids and numbers."""
    p = lambda *names: filled(*(F.col("props")[n] for n in names))
    raw = F.coalesce(F.when(F.col("raw_id") > 0, F.col("raw_id")), *(F.when(p(n).try_cast("long") > 0, p(n).try_cast("long")) for n in ("osm_id", "id", "@id")), F.lit(0).cast("long"))
    return features.withColumns({
        "raw_id": raw, "id": composite_id(raw, F.col("layer"), p("kind", "class"), p("kind_detail", "subclass")),
        "height": F.coalesce(metres(p("height")), metres(p("render_height"))), "elevation": F.coalesce(metres(p("elevation")), metres(p("ele"))),
    })


def merged(features: DataFrame) -> DataFrame:
    """Parts of a feature in several tiles as one: geometries in the order of tiles, the rest from the first."""
    rows = F.sort_array(F.collect_list(F.struct("x", "y", "geometry")))
    key = F.struct("x", "y")
    return features.groupBy("id").agg(*(F.min_by(c, key).alias(c) for c in ("raw_id", "layer", "kind", "props", "height", "elevation")), F.flatten(F.transform(rows, lambda r: r["geometry"])).alias("geometry"))


def around(tiles: DataFrame, lat: float, lon: float, radius_km: float, zoom: int) -> DataFrame:
    """Decoded features of the tiles around a place, not yet filtered; tiles: zoom, col, row, tile_data."""
    from waymark.sources.vector_tiles import features

    low, high, west, east = geo.bounding_box(F.lit(lat), F.lit(lon), radius_km)
    (x0, y0), (x1, y1) = geo.tile_xy(high, west, zoom), geo.tile_xy(low, east, zoom)
    flip = lambda y: geo.tms_flip(F.lit(zoom), y)
    # constants once folded: the filter reaches the scan, whatever the number of tiles in the box
    return named(features(tiles.where((F.col("zoom") == zoom) & F.col("col").between(x0, x1) & F.col("row").between(flip(y1), flip(y0)))))


def centroids(tiles: DataFrame, lat: float, lon: float, radius_m: float = 1000, zoom: int = 14, limit: int = 50) -> DataFrame:
    """Features with a vertex in the circle: id, layer, centre and box."""
    near = around(tiles, lat, lon, radius_m / 1000, zoom).where(within(F.col("geometry"), lat, lon, radius_m / 1000))
    whole = merged(near)
    return centroid_box(whole).join(whole.select("id", "layer", "kind", "height", "elevation", "props"), "id").orderBy("id").limit(limit)


def feature_by_id(tiles: DataFrame, lat: float, lon: float, number: str, radius_m: float = 1000, zoom: int = 14) -> DataFrame:
    """A feature by its composite id or its number, whatever its distance within the tiles."""
    raw = int(number) if number.isdigit() and int(number) else None
    hit = F.col("id") == number
    return merged(around(tiles, lat, lon, radius_m / 1000, zoom).where(hit if raw is None else hit | (F.col("raw_id") == raw)))


def bilinear(grid: DataFrame, points: DataFrame, width: int, height: int) -> DataFrame:
    """Elevation at points by the four grid samples around: x wraps, y stops at the edges; a sample stands at its
    cell's corner.

    grid: gx, gy, value (row 0 at the north); points: id, lat, lon. Two equi-joins, no grid is broadcast.
    """
    fx = (F.col("lon") + 180) / 360 * width
    fy = F.greatest(F.lit(0.0), F.least((90 - F.col("lat")) / 180 * height, F.lit(height - 1.0)))
    p = points.select("id", fx.alias("fx"), fy.alias("fy"))
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    part = []
    for i, j in corners:
        x, y = F.floor("fx") + i, F.floor("fy") + j
        wx, wy = F.col("fx") - F.floor("fx"), F.col("fy") - F.floor("fy")
        part.append(F.struct(F.pmod(x, F.lit(width)).cast("long").alias("gx"), F.greatest(F.lit(0), F.least(y, F.lit(height - 1))).cast("long").alias("gy"), ((wx if i else 1 - wx) * (wy if j else 1 - wy)).alias("w")))
    spots = p.select("id", F.explode(F.array(*part)).alias("s")).select("id", "s.*")
    return spots.join(grid, ["gx", "gy"]).groupBy("id").agg(F.sum(F.col("w") * F.col("value")).alias("elevation"))

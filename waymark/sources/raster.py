"""Elevation rasters (TIFF and BigTIFF) and elevation tiles."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources import ranges

#: Struct codes of the field types
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tags(source) -> tuple[dict[int, tuple], str]:
    """The first directory's fields and the byte order, of a URI or of bytes."""
    w = ranges.window(source)
    take = lambda code, at: struct.unpack(code, w.bytes(at, struct.calcsize(code)))
    order = {b"II": "<", b"MM": ">"}[w.bytes(0, 2)]
    big = take(order + "H", 2)[0] == 43
    word, width, entry = ("Q", 8, 20) if big else ("I", 4, 12)
    at = take(order + word, 8 if big else 4)[0]
    n = take(order + ("Q" if big else "H"), at)[0]
    at += 8 if big else 2
    out = {}
    for i in range(n):
        tag, kind, count = take(order + "HH" + word, at + i * entry)
        code = TYPES.get(kind)
        if code is None:
            continue
        size, spot = struct.calcsize(order + code) * count, at + i * entry + (12 if big else 8)
        if size > width:
            spot = take(order + word, spot)[0]
        out[tag] = take(order + f"{count}{code}", spot)
    return out, order


def block(raw: bytes, compression: int, predictor: int, dtype: np.dtype, order: str, rows: int, cols: int) -> np.ndarray:
    """Samples of a strip or tile."""
    if compression in (8, 32946):
        raw = zlib.decompress(raw)
    elif compression != 1:
        raise ValueError(f"compression {compression}")
    size = dtype.itemsize
    flat = np.frombuffer(raw, np.uint8)
    rows = min(rows, len(flat) // (cols * size))
    flat = flat[: rows * cols * size]
    if predictor == 3:
        planes = np.cumsum(flat.reshape(rows, -1), axis=1, dtype=np.uint8).reshape(rows, size, cols)
        return planes.transpose(0, 2, 1).copy().view(dtype.newbyteorder(">")).reshape(rows, cols).astype(dtype)
    out = flat.view(dtype.newbyteorder(order)).reshape(rows, cols).astype(dtype)
    return np.cumsum(out, axis=1, dtype=dtype) if predictor == 2 else out


def layout(source) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """What is needed to decode, and (row, column, offset, bytes) of each strip or tile."""
    t, order = tags(source)
    width, height = t[256][0], t[257][0]
    kind, bits = t.get(339, (1,))[0], t.get(258, (1,))[0]
    dtype = {(1, 16): "u2", (2, 16): "i2", (3, 32): "f4", (2, 32): "i4"}[kind, bits]
    tiled = 322 in t
    w, h = (t[322][0], t[323][0]) if tiled else (width, t.get(278, (height,))[0])
    across = -(-width // w)
    spots, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
    form = {"width": width, "height": height, "dtype": dtype, "order": order, "w": w, "h": h, "compression": t.get(259, (1,))[0], "predictor": t.get(317, (1,))[0]}
    return form, [((i // across) * h, (i % across) * w, o, n) for i, (o, n) in enumerate(zip(spots, sizes, strict=True))]


def decoded(raw: bytes, form: dict, r: int, c: int) -> np.ndarray:
    """Samples of a strip or tile, bad ones as 0."""
    got = block(raw, form["compression"], form["predictor"], np.dtype(form["dtype"]), form["order"], form["h"], form["w"])[: form["height"] - r, : form["width"] - c].astype(float)
    return np.where(np.isfinite(got) & (got >= -12000) & (got <= 9000), got, 0.0)


def samples(raw: bytes):
    """(row, column, array) of each strip or tile of a file at hand."""
    form, parts = layout(raw)
    for r, c, o, n in parts:
        yield r, c, decoded(raw[o : o + n], form, r, c)


def parts(spark: SparkSession, path: str) -> DataFrame:
    """path, form (JSON), r, c, offset, length of every strip and tile, dealt over tasks; only directories are read."""

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                form, got = layout(p)
                yield pd.DataFrame([(p, json.dumps(form), *x) for x in got], columns=["path", "form", "r", "c", "offset", "length"])

    return ranges.table(spark, path).select("path").mapInPandas(run, "path string, form string, r long, c long, offset long, length long").repartition("path", "r", "c")


def _decode(batches):
    for pdf in batches:
        for p, form, r, c, o, n in pdf.itertuples(index=False):
            yield r, c, decoded(ranges.read(p, o, n), json.loads(form), r, c)


def grid(spark: SparkSession, path: str) -> DataFrame:
    """gx, gy, value of every sample; each strip or tile is read by offset in a task of its own."""

    def run(batches):
        for r, c, a in _decode(batches):
            y, x = np.mgrid[r : r + a.shape[0], c : c + a.shape[1]]
            yield pd.DataFrame({"gx": x.ravel().astype(np.int64), "gy": y.ravel().astype(np.int64), "value": a.ravel()})

    return parts(spark, path).mapInPandas(run, "gx long, gy long, value double")


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB image."""
    h, w, _ = rgb.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def elevation_tiles(pixels: DataFrame, size: int = 256) -> DataFrame:
    """zoom, col, row (from the south) and the tile's image; pixels: zoom, x, y, px, py, elevation. A tile is one group of
    size * size rows at most."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((size, size))
        v[pdf["py"], pdf["px"]] = pdf["elevation"]
        return _image(pdf, v)

    return pixels.groupBy("zoom", "x", "y").applyInPandas(draw, TILE)


TILE = "zoom int, col int, row int, tile_data binary"


def _image(pdf: pd.DataFrame, v: np.ndarray) -> pd.DataFrame:
    t = np.clip(v + 32768, 0, 65535.99)
    whole = np.floor(t)
    rgb = np.stack([whole // 256, whole % 256, np.floor((t - whole) * 256)], -1)
    z, x, y = (int(pdf[c].iloc[0]) for c in ("zoom", "x", "y"))
    return pd.DataFrame({"zoom": [z], "col": [x], "row": [2**z - 1 - y], "tile_data": [png(rgb)]})


def spots(width: int, height: int, world: int) -> tuple[np.ndarray, ...]:
    """Of a world of so many pixels a side: left and right column and the right one's weight, upper and lower row and
    the lower one's weight. Columns wrap, rows stop at the edges."""
    at = np.arange(world)
    fx = at / world * width
    lat = np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * at / world))))
    fy = np.clip((90 - lat) / 180 * height, 0, height - 1)
    x, y = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    return x, (x + 1) % width, fx - x, y, np.minimum(y + 1, height - 1), fy - y


def pyramid(spark: SparkSession, path: str, most: int = 7, size: int = 256) -> DataFrame:
    """Elevation tiles of the zooms 0 to `most` of a raster of the whole globe, by the four samples around each pixel.

    Rows of the raster are put together (a row is bounded by its width), meet the rows of pixels that need them by an
    equi-join, are resampled across and cut at tiles; a tile is one group of 2 * size pieces.
    """
    (source, _), *_ = ranges.files(spark, path)
    form, _ = layout(source)  # the directory only
    width, height = form["width"], form["height"]
    need = []
    for z in range(most + 1):
        _, _, _, top, low, part = spots(width, height, size << z)
        need += [(z, v, int(g), float(w)) for v, (a, b, p) in enumerate(zip(top, low, part, strict=True)) for g, w in ((a, 1 - p), (b, p)) if w]
    need = spark.createDataFrame(pd.DataFrame(need, columns=["zoom", "v", "gy", "weight"]), "zoom int, v int, gy long, weight double")  # 2 rows a row of pixels

    def lines(batches):
        for r, c, a in _decode(batches):
            yield pd.DataFrame({"gy": np.arange(r, r + len(a)), "c": np.full(len(a), c), "a": list(a)})

    pieces = parts(spark, source).mapInPandas(lines, "gy long, c long, a array<double>")
    rows = pieces.groupBy("gy").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "a"))), lambda x: x["a"])).alias("a"))

    def across(batches):
        for pdf in batches:
            for z, v, w, a in pdf.itertuples(index=False):
                left, right, part, *_ = spots(width, height, size << z)
                a = np.asarray(a)
                got = ((a[left] * (1 - part) + a[right] * part) * w).reshape(-1, size)
                yield pd.DataFrame({"zoom": z, "x": np.arange(len(got)), "y": v // size, "py": v % size, "a": list(got)})

    cut = need.join(rows, "gy").select("zoom", "v", "weight", "a").mapInPandas(across, "zoom int, x int, y int, py int, a array<double>")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((size, size))
        np.add.at(v, pdf["py"].to_numpy(), np.stack(pdf["a"].to_numpy()))
        return _image(pdf, v)

    return cut.groupBy("zoom", "x", "y").applyInPandas(draw, TILE)

"""Single-file tile archives (version 3): header, directories of runs, tiles."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.geo import hilbert_zxy, tms_flip
from waymark.sources import ranges
from waymark.sources.vector_tiles import packed

HEADER = struct.Struct("<7sB11Q6B")
HEADER_BYTES = HEADER.size


def header(raw: bytes) -> dict:
    magic, version, *rest = HEADER.unpack_from(raw)
    if magic != b"PMTiles" or version != 3:
        raise ValueError("not a version 3 tile archive")
    names = ("root_offset", "root_length", "metadata_offset", "metadata_length", "leaf_offset", "leaf_length", "data_offset", "data_length", "addressed", "entries", "contents", "clustered", "internal_compression", "tile_compression", "tile_type", "min_zoom", "max_zoom")
    return dict(zip(names, rest, strict=True))


def unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 2:
        return gzip.decompress(raw)
    if compression in (0, 1):
        return raw
    raise ValueError(f"compression {compression}")


def directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(tile id, run length, offset, length); a run length of 0 is a leaf directory."""
    v = packed(raw)
    n = v[0]
    ids, last = [], 0
    for d in v[1 : 1 + n]:
        last += d
        ids.append(last)
    runs, lengths, offsets = v[1 + n : 1 + 2 * n], v[1 + 2 * n : 1 + 3 * n], []
    for i, o in enumerate(v[1 + 3 * n : 1 + 4 * n]):
        offsets.append(offsets[-1] + lengths[i - 1] if o == 0 and i else o - 1)
    return list(zip(ids, runs, offsets, lengths, strict=True))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """path, tile_id, run_length, offset, length of all tiles: the roots, then the leaf directories by separate tasks,
    each read by offset and length."""

    def roots(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                h = header(ranges.read(p, 0, HEADER_BYTES))
                for t, run, o, n in directory(unpacked(ranges.read(p, h["root_offset"], h["root_length"]), h["internal_compression"])):
                    rows.append((p, t, run, o, n, h["leaf_offset"], h["internal_compression"]))
            yield pd.DataFrame(rows, columns=["path", "tile_id", "run_length", "offset", "length", "leaves", "compression"])

    def leaves(batches):
        for pdf in batches:
            for p, base, o, n, c in zip(pdf["path"], pdf["leaves"], pdf["offset"], pdf["length"], pdf["compression"], strict=True):
                todo = [(o, n)]
                while todo:
                    o, n = todo.pop()
                    got = directory(unpacked(ranges.read(p, base + o, n), c))
                    todo += [(o2, n2) for _, run, o2, n2 in got if not run]
                    yield pd.DataFrame([(p, *e) for e in got if e[1]], columns=["path", "tile_id", "run_length", "offset", "length"])

    flat = "path string, tile_id long, run_length long, offset long, length long"
    top = ranges.table(spark, path).select("path").mapInPandas(roots, flat + ", leaves long, compression int")
    direct = top.where("run_length > 0").select("path", "tile_id", "run_length", "offset", "length")
    below = top.where("run_length = 0").repartition("path", "offset").mapInPandas(leaves, flat)
    return direct.union(below)


PIECE = 1 << 16


def coordinates(entries_: DataFrame, most: int | None = None) -> DataFrame:
    """path, zoom, col, row (from the south), offset, length: a row a tile of each run, ids below `most` only. A run
    is cut in pieces of PIECE tiles first, so no row holds a long run."""
    last = F.col("tile_id") + F.col("run_length") - 1
    last = last if most is None else F.least(last, F.lit(most - 1))
    e = entries_ if most is None else entries_.where(F.col("tile_id") < most)
    e = e.select("path", "offset", "length", "tile_id", last.alias("last")).withColumn("piece", F.explode(F.expr(f"sequence(0L, (last - tile_id) div {PIECE})")))
    begin = F.col("tile_id") + F.col("piece") * PIECE
    e = e.select("path", "offset", "length", F.explode(F.sequence(begin, F.least(begin + PIECE - 1, "last"))).alias("tile_id"))
    e = e.withColumn("at", hilbert_zxy(F.col("tile_id")))
    return e.select("path", F.col("at.z").alias("zoom"), F.col("at.x").cast("int").alias("col"), tms_flip(F.col("at.z"), F.col("at.y")).cast("int").alias("row"), "offset", "length")


def tiles(spark: SparkSession, path: str, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(zoom, col, row, tile_data_id) and (tile_data_id, tile_data): equal offsets are one blob. Blobs that lie within
    the same PART bytes are read by one task."""
    found = entries(spark, path)
    at = coordinates(found, most)
    key = F.concat_ws(":", "path", F.col("offset").cast("string"))
    wanted = (found if most is None else found.where(F.col("tile_id") < most)).select("path", "offset", "length").distinct()

    def cut(batches):
        bases: dict[str, int] = {}
        for pdf in batches:
            for p, o, n in zip(pdf["path"], pdf["offset"], pdf["length"], strict=True):
                if p not in bases:
                    bases[p] = header(ranges.read(p, 0, HEADER_BYTES))["data_offset"]
                yield pd.DataFrame({"tile_data_id": [f"{p}:{o}"], "tile_data": [ranges.read(p, bases[p] + o, n)]})

    near = wanted.withColumn("part", F.floor(F.col("offset") / PART)).repartition("path", "part").sortWithinPartitions("path", "offset").drop("part")
    return at.select("zoom", "col", "row", key.alias("tile_data_id")), near.mapInPandas(cut, "tile_data_id string, tile_data binary")


PART = 64 << 20


def metadata(raw: bytes) -> str:
    h = header(raw)
    return unpacked(raw[h["metadata_offset"] : h["metadata_offset"] + h["metadata_length"]], h["internal_compression"]).decode()


def metadata_of(spark: SparkSession, path: str) -> DataFrame:
    """json: each archive's metadata."""

    def run(batches):
        for pdf in batches:
            heads = [(p, header(ranges.read(p, 0, HEADER_BYTES))) for p in pdf["path"]]
            yield pd.DataFrame({"json": [unpacked(ranges.read(p, h["metadata_offset"], h["metadata_length"]), h["internal_compression"]).decode() for p, h in heads]})

    return ranges.table(spark, path).select("path").mapInPandas(run, "json string")

"""Vector tiles (protocol buffers, plain or gzip) as features with geometries in degrees."""

from __future__ import annotations

import gzip
import math
import struct

import pandas as pd
from pyspark.sql import DataFrame

KINDS = {1: "Point", 2: "LineString", 3: "Polygon"}
SCHEMA = "zoom int, x int, y int, layer string, raw_id long, kind string, props map<string,string>, geometry array<array<struct<lon: double, lat: double>>>"


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def fields(b: bytes):
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(b, at)
        elif wire == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = b[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield number, wire, value


def packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = varint(b, at)
        out.append(v)
    return out


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) else repr(x)


def value_text(b: bytes) -> str | None:
    for number, _, v in fields(b):
        if number == 1:
            return v.decode("utf-8", "replace")
        if number in (2, 3):
            return _number(struct.unpack("<f" if number == 2 else "<d", v)[0])
        if number in (4, 5, 6):
            return str(_signed(v) if number == 4 else v if number == 5 else unzigzag(v))
        if number == 7:
            return "true" if v else "false"
    return None


def paths(commands: list[int], closed: bool) -> list[list[tuple[int, int]]]:
    """Rings or lines in tile units."""
    out: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        op, n = commands[at] & 7, commands[at] >> 3
        at += 1
        for _ in range(n):
            if op == 7:
                if closed and out and out[-1][0] != out[-1][-1]:
                    out[-1].append(out[-1][0])
                continue
            x, y = x + unzigzag(commands[at]), y + unzigzag(commands[at + 1])
            at += 2
            if op == 1:
                out.append([])
            if out:
                out[-1].append((x, y))
    return out


def decode(blob: bytes, zoom: int, x: int, y: int) -> list[dict]:
    raw = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    out = []
    for number, _, layer in fields(raw):
        if number != 3:
            continue
        name, extent, keys, values, found = "", 4096, [], [], []
        for k, _, v in fields(layer):
            if k == 1:
                name = v.decode()
            elif k == 2:
                found.append(v)
            elif k == 3:
                keys.append(v.decode())
            elif k == 4:
                values.append(value_text(v))
            elif k == 5:
                extent = v
        for f in found:
            raw_id, tags, kind, commands = 0, [], 0, []
            for k, _, v in fields(f):
                if k == 1:
                    raw_id = _signed(v)
                elif k == 2:
                    tags = packed(v)
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = packed(v)
            n = 2.0**zoom
            place = lambda px, py: {"lon": 360 * (x + px / extent) / n - 180, "lat": math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + py / extent) / n))))}  # noqa: B023, E731
            out.append({
                "zoom": zoom, "x": x, "y": y, "layer": name, "raw_id": raw_id, "kind": KINDS.get(kind, "Unknown"),
                "props": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=False) if a < len(keys) and b < len(values)},
                "geometry": [[place(*p) for p in ring] for ring in paths(commands, kind == 3)],
            })
    return out


def features(tiles: DataFrame) -> DataFrame:
    """All features of tiles (zoom, col, row from the south, tile_data), one at a time; y counts from the north."""

    def run(batches):
        for pdf in batches:
            rows = [f for z, c, r, b in zip(pdf["zoom"], pdf["col"], pdf["row"], pdf["tile_data"], strict=True) for f in decode(bytes(b), int(z), int(c), 2 ** int(z) - 1 - int(r))]
            if rows:
                yield pd.DataFrame(rows)

    return tiles.select("zoom", "col", "row", "tile_data").mapInPandas(run, SCHEMA)

"""Small files in the binary formats, built in code for tests and demonstrations."""

from __future__ import annotations

import gzip
import io
import json
import struct
import tarfile
import zlib

import numpy as np


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number: int, value) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def zig(n: int) -> int:
    return n * 2 if n >= 0 else -n * 2 - 1


def commands(rings: list[list[tuple[int, int]]], kind: int) -> list[int]:
    out, x, y = [], 0, 0
    for ring in rings:
        for i, (a, b) in enumerate(ring):
            if i == 0:
                out.append(1 | 1 << 3)
            elif i == 1:
                out.append(2 | (len(ring) - 1) << 3)
            out += [zig(a - x), zig(b - y)]
            x, y = a, b
        if kind == 3:
            out.append(7 | 1 << 3)
    return out


def tile(features: list[tuple[int, int, list, dict]], layer: str = "places", zipped: bool = True) -> bytes:
    """A vector tile of one layer; features: id, kind (1 to 3), rings, properties."""
    keys, values, body = [], [], b""
    for fid, kind, rings, props in features:
        tags = []
        for k, v in props.items():
            if k not in keys:
                keys.append(k)
            if isinstance(v, bool):
                raw = field(7, int(v))
            elif isinstance(v, str):
                raw = field(1, v.encode())
            elif isinstance(v, float):
                raw = varint(3 << 3 | 1) + struct.pack("<d", v)
            else:
                raw = varint(6 << 3) + varint(zig(v))
            if raw not in values:
                values.append(raw)
            tags += [keys.index(k), values.index(raw)]
        body += field(2, field(1, fid) + field(2, b"".join(map(varint, tags))) + field(3, kind) + field(4, b"".join(map(varint, commands(rings, kind)))))
    raw = field(3, field(15, 2) + field(1, layer.encode()) + body + b"".join(field(3, k.encode()) for k in keys) + b"".join(field(4, v) for v in values) + field(5, 4096))
    return gzip.compress(raw) if zipped else raw


def directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    out, last = varint(len(entries)), 0
    for t, *_ in entries:
        out, last = out + varint(t - last), t
    out += b"".join(varint(e[1]) for e in entries) + b"".join(varint(e[3]) for e in entries)
    for i, e in enumerate(entries):
        follows = i and e[2] == entries[i - 1][2] + entries[i - 1][3]
        out += varint(0 if follows else e[2] + 1)
    return out


def tile_archive(tiles: list[tuple[int, int, bytes]], leaf: list[tuple[int, int, bytes]] = (), meta: dict | None = None) -> bytes:
    """A version 3 archive; tiles and the leaf directory's tiles: id, run length, blob."""
    data, entries, leaf_entries = b"", [], []
    for group, to in ((tiles, entries), (leaf, leaf_entries)):
        for t, run, blob in group:
            at = data.find(blob)
            if at < 0:
                at, data = len(data), data + blob
            to.append((t, run, at, len(blob)))
    below = gzip.compress(directory(leaf_entries)) if leaf_entries else b""
    if below:
        entries.append((leaf_entries[0][0], 0, 0, len(below)))
    root, info = gzip.compress(directory(sorted(entries))), gzip.compress(json.dumps(meta or {}).encode())
    a = 127
    b = a + len(root)
    c = b + len(info)
    d = c + len(below)
    head = struct.pack("<7sB11Q6B", b"PMTiles", 3, a, len(root), b, len(info), c, len(below), d, len(data), 0, 0, 0, 1, 2, 1, 1, 0, 14)
    return head.ljust(127, b"\0") + root + info + below + data


def tiff(values: np.ndarray, compression: int = 1, predictor: int = 1, tiled: bool = False) -> bytes:
    """A little-endian raster of int16 or float32 samples in strips of one row, or tiles of 16 x 16."""
    h, w = values.shape
    kind, bits = (2, 16) if values.dtype == np.int16 else (3, 32)

    def coded(a: np.ndarray) -> bytes:
        if predictor == 2:
            a = np.diff(a, axis=1, prepend=a.dtype.type(0)).astype(a.dtype)
        raw = np.ascontiguousarray(a).tobytes()
        if predictor == 3:
            planes = np.frombuffer(a.astype(">f4").tobytes(), np.uint8).reshape(a.shape[0], a.shape[1], 4).transpose(0, 2, 1).reshape(a.shape[0], -1)
            raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        return zlib.compress(raw) if compression in (8, 32946) else raw

    if tiled:
        padded = np.zeros((-(-h // 16) * 16, -(-w // 16) * 16), values.dtype)
        padded[:h, :w] = values
        parts = [coded(padded[r : r + 16, c : c + 16]) for r in range(0, h, 16) for c in range(0, w, 16)]
    else:
        parts = [coded(values[r : r + 1]) for r in range(h)]
    data, spots, sizes = b"", [], []
    for p in parts:
        spots.append(8 + len(data))
        sizes.append(len(p))
        data += p
    extra = 8 + len(data)
    longs = lambda v: struct.pack(f"<{len(v)}I", *v)
    data += longs(spots) + longs(sizes)
    where = lambda v, at: v[0] if len(v) == 1 else at
    fields = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, compression), (317, 3, 1, predictor), (339, 3, 1, kind)]
    fields += [(322, 4, 1, 16), (323, 4, 1, 16), (324, 4, len(spots), where(spots, extra)), (325, 4, len(sizes), where(sizes, extra + 4 * len(spots)))] if tiled else [(278, 4, 1, 1), (273, 4, len(spots), where(spots, extra)), (279, 4, len(sizes), where(sizes, extra + 4 * len(spots)))]
    body = b"".join(struct.pack("<HHII", *f) for f in sorted(fields))
    return b"II" + struct.pack("<HI", 42, 8 + len(data)) + data + struct.pack("<H", len(fields)) + body + struct.pack("<I", 0)


def model(meta: dict, tensors: dict[str, tuple[int, list[int], bytes]]) -> bytes:
    """A version 3 model file; tensors: dtype, dims, data."""
    text = lambda s: struct.pack("<Q", len(s.encode())) + s.encode()

    def value(v) -> tuple[int, bytes]:
        if isinstance(v, bool):
            return 7, struct.pack("<?", v)
        if isinstance(v, str):
            return 8, text(v)
        if isinstance(v, float):
            return 6, struct.pack("<f", v)
        if isinstance(v, list):
            inner = [value(x) for x in v]
            return 9, struct.pack("<IQ", inner[0][0], len(v)) + b"".join(x for _, x in inner)
        return 4, struct.pack("<I", v)

    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    for k, v in meta.items():
        kind, raw = value(v)
        head += text(k) + struct.pack("<I", kind) + raw
    data = b""
    for name, (dtype, dims, raw) in tensors.items():
        head += text(name) + struct.pack(f"<I{len(dims)}QIQ", len(dims), *dims, dtype, len(data))
        data += raw + b"\0" * (-len(raw) % 32)
    return head + b"\0" * (-len(head) % 32) + data


def archive(lines: list[str]) -> bytes:
    """A tar.gz with one member of the lines."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        raw = "\n".join(lines).encode()
        info = tarfile.TarInfo("a.ndjson")
        info.size = len(raw)
        t.addfile(info, io.BytesIO(raw))
    return out.getvalue()

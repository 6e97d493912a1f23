"""Model files (GGUF version 3): metadata, tensor directory, dequantised rows; byte-level BPE from its vocabulary."""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.tiles import tensor_layer
from waymark.sources import ranges

#: Struct codes of metadata types
SCALARS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
F32, F16, Q8_0, BF16 = 0, 1, 8, 30


class Reader:
    def __init__(self, source):
        self.source, self.at = ranges.window(source), 0

    def take(self, code: str):
        n = struct.calcsize("<" + code)
        self.at += n
        return struct.unpack("<" + code, self.source.bytes(self.at - n, n))[0]

    def text(self) -> str:
        n = self.take("Q")
        self.at += n
        return self.source.bytes(self.at - n, n).decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.take("I"), self.take("Q")
            return [self.value(inner) for _ in range(n)]
        return self.take(SCALARS[kind])


def tensor_bytes(dtype: int, n: int) -> int:
    if dtype == Q8_0:
        return n // 32 * 34
    return n * {F32: 4, F16: 2, BF16: 2}[dtype]


def head(source) -> tuple[dict, list[dict]]:
    """(metadata, tensors with name, dtype, dims, offset in the file and length), of a URI or of bytes; no tensor is read."""
    r = Reader(source)
    if r.source.bytes(0, 4) != b"GGUF":
        raise ValueError("not a model file")
    r.at = 4
    if r.take("I") != 3:
        raise ValueError("only version 3 is read")
    n_tensors, n_values = r.take("Q"), r.take("Q")
    meta = {}
    for _ in range(n_values):
        key = r.text()
        meta[key] = r.value(r.take("I"))
    heads = []
    for _ in range(n_tensors):
        name, n = r.text(), r.take("I")
        dims = [r.take("Q") for _ in range(n)]
        heads.append({"name": name, "dims": dims, "dtype": r.take("I"), "offset": r.take("Q")})
    step = int(meta.get("general.alignment", 32))
    base = -(-r.at // step) * step
    for t in heads:
        t["offset"] += base
        t["length"] = tensor_bytes(t["dtype"], int(np.prod(t["dims"])))
    return meta, heads


def parse(raw: bytes) -> tuple[dict, list[dict]]:
    """(metadata, tensors with name, dtype, dims and data) of a file at hand."""
    meta, heads = head(raw)
    for t in heads:
        at, n = t.pop("offset"), t.pop("length")
        t["data"] = raw[at : at + n]
    return meta, heads


def dequantize(raw: bytes, dtype: int) -> np.ndarray:
    if dtype == F32:
        return np.frombuffer(raw, "<f4").astype(np.float32)
    if dtype == F16:
        return np.frombuffer(raw, "<f2").astype(np.float32)
    if dtype == BF16:
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype == Q8_0:
        b = np.frombuffer(raw, np.dtype([("d", "<f2"), ("q", "i1", 32)]))
        return (b["d"].astype(np.float32)[:, None] * b["q"]).ravel()
    raise ValueError(f"tensor type {dtype}")


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """layer, name, dtype, dims, data of the tensors that an embedder needs (the output weights are left out); each is
    read by offset in a task of its own."""

    def heads(batches):
        for pdf in batches:
            for p in pdf["path"]:
                yield pd.DataFrame([{"path": p, **t} for t in head(p)[1]], columns=["path", "name", "dtype", "dims", "offset", "length"])

    def data(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                yield pd.DataFrame({"name": [row.name], "dtype": [row.dtype], "dims": [row.dims], "data": [ranges.read(row.path, row.offset, row.length)]})

    found = ranges.table(spark, path).select("path").mapInPandas(heads, "path string, name string, dtype int, dims array<long>, offset long, length long")
    got = found.where("name <> 'output.weight'").repartition("path", "name").mapInPandas(data, "name string, dtype int, dims array<long>, data binary")
    return got.select(tensor_layer(F.col("name")).alias("layer"), "name", "dtype", "dims", "data")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """key and its value as JSON."""

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                m = head(p)[0]
                yield pd.DataFrame({"key": list(m), "value": [json.dumps(v) for v in m.values()]})

    return ranges.table(spark, path).select("path").mapInPandas(run, "key string, value string")


#: Metadata keys of the tokenizer, the end token without one, and the kind of a control token
TOKENS, MERGES, KINDS, END_KEY, END, CONTROL = "tokenizer.ggml.tokens", "tokenizer.ggml.merges", "tokenizer.ggml.token_type", "tokenizer.ggml.eos_token_id", 151643, 3


def tokenizer(meta: dict) -> BytePairs:
    """The byte-level BPE that a model file's metadata describe."""
    if TOKENS not in meta:
        raise ValueError(f"no {TOKENS}")
    words = meta[TOKENS]
    kinds = meta.get(KINDS) or []
    special = tuple(w for w, k in zip(words, kinds, strict=False) if k == CONTROL) or tuple(w for w in words if w.startswith("<|") and w.endswith("|>"))
    return BytePairs({w: i for i, w in enumerate(words)}, [m for m in meta.get(MERGES, []) if " " in m], special, int(meta.get(END_KEY, END)))


def dequantized(rows: DataFrame) -> DataFrame:
    """name and its numbers as an array<float>."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["name"], "values": [dequantize(bytes(d), int(k)) for d, k in zip(pdf["data"], pdf["dtype"], strict=True)]})

    return rows.select("name", "dtype", "data").mapInPandas(run, "name string, values array<float>")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class BytePairs:
    """Byte-level BPE: lowest-ranked merges first, special tokens cut out, an end token appended."""

    def __init__(self, vocabulary: dict[str, int], merges: list[str], special: tuple[str, ...] = (), end: int | None = None):
        self.ids, self.special, self.end = vocabulary, special, end
        self.rank = {tuple(m.split(" ")): i for i, m in enumerate(merges)}
        self.letters = byte_letters()
        # no merge crosses other pairs of letters than these, so a text cut at all others has the same pieces
        after: dict[str, set[str]] = {}
        for a, b in self.rank:
            after.setdefault(a[-1:], set()).add(b[:1])
        joins = "|".join(f"(?<={re.escape(a)})[{''.join(map(re.escape, sorted(b)))}]" for a, b in sorted(after.items()))
        self.apart = re.compile(f".(?:{joins})*" if joins else ".", re.DOTALL)
        self.known: dict[str, list[int]] = {}

    def word(self, text: str) -> list[int]:
        letters = text.encode().decode("latin-1").translate(self.letters)
        out: list[int] = []
        for p in self.apart.findall(letters):
            ids = self.known.get(p)
            if ids is None:
                ids = self.merged(p)
                if len(p) <= 32 and len(self.known) < 1 << 16:
                    self.known[p] = ids
            out += ids
        return out

    def merged(self, letters: str) -> list[int]:
        parts = list(letters)
        while len(parts) > 1:
            rank, i = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.rank):
                break
            pair = (parts[i], parts[i + 1])
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return [self.ids[p] for p in parts if p in self.ids]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for p in pieces:
            if p:
                out += [self.ids[p]] if p in self.special else self.word(p)
        return out if self.end is None else [*out, self.end]

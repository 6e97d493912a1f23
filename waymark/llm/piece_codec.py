"""SentencePiece encoding and decoding as a max-plus parallel scan.

A text's segmentation is the path of largest total score through the lattice of the vocabulary's pieces. In a
unigram model every step is open; in a BPE model a step from piece a to piece b is open (weight: b's score) if
merging the string a b gives just these two pieces, else closed (minus infinity). A path of open steps is then
the one that BPE's merges lead to, so the ids are the library's own for either type of model. A character without a
piece has the least score less 10 and is spelt in byte pieces; its steps are open on both sides.

Scores are taken as multiples of 2**-16 in 64-bit integers, those below -2**20 as -2**20, so sums are exact
and max-plus products are associative whatever the grouping.

1. No piece goes on over the beginning of a run of spaces, so texts fall into units there. A unit's
   segmentation is worked out once, many units in lockstep, and remembered in a table of fixed size.
2. Giant texts (over `chunk` bytes) are cut into chunks that may lie on any executor. A boundary's states are
   the pieces that reach or cross it. A chunk yields its transfer matrix: T[i, j] is the best score from state
   i of its beginning to state j of its end. The matrices of a text (CHUNKS at most; the chunks of a longer
   text grow) are combined by a scan of max-plus products, which fixes every boundary's state; each chunk is
   then traced back independently.

Defined results: null and empty texts have no ids; a text that holds U+2581 decodes with a space there (the
format uses it for spaces); control pieces' names in a text are ordinary text; repeated rows are coded each; a
null doc_id stays; other columns are ignored. Ties go to the longer last piece, at chunk boundaries to the
first state. Models with user-defined pieces, or with pieces over the beginning of a run of spaces, are refused.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, buffers, materialize, text_of
from waymark.llm.words import EXACT, fmix, hashes

CHUNK, CHUNKS, UNIT = 1 << 16, 4096, 1 << 16
NONE = np.int64(-(1 << 62))
SPACE = 0x20


class Pieces:
    """The vocabulary: piece bytes (spaces for U+2581), ids, integer scores, and which steps are open."""

    SLOTS = 19

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.merges = model.trainer_spec.model_type == model.trainer_spec.BPE
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or any(p.type == p.USER_DEFINED or " " in p.piece or "▁" in p.piece.lstrip("▁") for p in model.pieces):
            raise ValueError("a model of this kind is not supported")
        spec.add_dummy_prefix = False
        self.library = SentencePieceProcessor(model_proto=model.SerializeToString())  # tells which pairs of pieces stay as they are
        n = len(model.pieces)
        self.raw = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        ids, score = [], []
        for i, p in enumerate(model.pieces):
            if p.type == p.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, bytes([value])
            elif p.type == p.NORMAL:
                self.raw[i] = p.piece.replace("▁", " ").encode()
                ids.append(i)
                score.append(max(p.score, -(2.0**20)))
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        flat = np.frombuffer(b"".join(self.raw[i] for i in ids), np.uint8)
        size = np.array([len(self.raw[i]) for i in ids])
        end = np.cumsum(size)
        h = hashes(flat, end - size, end, EXACT)
        order = np.argsort(h)
        self.keys, self.ids = h[order], np.array(ids, np.int32)[order]
        self.scores = np.round(np.array(score)[order] * 65536).astype(np.int64)
        self.unknown = np.int64(self.scores.min() - 10 * 65536)
        # what an id adds to a path's score; byte pieces only spell characters without a piece
        self.gain = np.zeros(n, np.int64)
        self.gain[self.ids] = self.scores
        self.gain[self.byte_ids[[b for b in range(256) if b & 0xC0 != 0x80]]] = self.unknown
        self.lengths = np.unique(size)
        self.most = int(size.max())
        self.flag = np.zeros(1 << 22, bool)
        self.flag[self.keys & np.uint64((1 << 22) - 1)] = True
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.size = np.array([len(x) for x in self.raw])
        self.place = np.cumsum(self.size) - self.size
        self.pair, self.stays = np.zeros(1 << self.SLOTS, np.int64), np.zeros(1 << self.SLOTS, bool)

    def open(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which steps are open; -1: a character without a piece, -2 (in a): the beginning of a span."""
        if not self.merges:
            return np.ones(len(a), bool)
        out = (a == -1) | (b < 0)
        at = np.flatnonzero(~out)
        key = ((a[at].astype(np.int64) + 3) << 32) | b[at]
        slot = (fmix(key.view(np.uint64)) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        got = self.stays[slot]
        new = np.flatnonzero(self.pair[slot] != key)
        if len(new):
            keys, inverse = np.unique(key[new], return_inverse=True)
            left, right = (keys >> 32) - 3, keys & 0xFFFFFFFF
            texts = [((self.raw[x] if x >= 0 else b"") + self.raw[y]).decode() for x, y in zip(left.tolist(), right.tolist(), strict=True)]
            stay = np.array([e == ([x, y] if x >= 0 else [y]) for e, x, y in zip(self.library.encode(texts, num_threads=1), left.tolist(), right.tolist(), strict=True)])
            got[new] = stay[inverse]
            self.pair[slot[new]], self.stays[slot[new]] = key[new], got[new]
        out[at] = got
        return out

    def edges(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id or -1 for a character without a piece, score); room: bytes up to the span's end."""
        parts = []
        width = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)[data]
        lead = (data & 0xC0) != 0x80
        alone = lead.copy()
        for n in self.lengths:
            at = np.flatnonzero(lead & (room >= n))
            if not len(at):
                continue
            h = hashes(data, at, at + n, EXACT)
            maybe = np.flatnonzero(self.flag[h & np.uint64((1 << 22) - 1)])
            k = np.searchsorted(self.keys, h[maybe]).clip(max=len(self.keys) - 1)
            hit = self.keys[k] == h[maybe]
            at, k = at[maybe[hit]], k[hit]
            alone[at[width[at] == n]] = False
            parts.append((at, np.full(len(at), n), self.ids[k], self.scores[k]))
        at = np.flatnonzero(alone & (room >= width))
        parts.append((at, width[at], np.full(len(at), -1, np.int32), np.full(len(at), self.unknown)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def solve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentations of many spans in lockstep: (ids, number of each span's ids)."""
        size = ends - starts
        order = np.argsort(size, kind="stable")
        total = np.cumsum(size[order])
        counts = np.zeros(len(size), np.int64)
        i, pieces = 0, []
        while i < len(order):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + (1 << 18), "right")))
            own = order[i:j]
            ids, n = self._solve(data, starts[own], size[own])
            counts[own] = n
            pieces.append((own, ids))
            i = j
        begin = np.cumsum(counts) - counts
        flat = np.empty(int(counts.sum()), self.kind)
        for own, ids in pieces:
            n = counts[own]
            flat[np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, counts

    def _solve(self, data, starts, size):
        n = len(size)
        off = np.concatenate([[0], np.cumsum(size)])
        buf = data[np.repeat(starts - off[:-1], size) + np.arange(off[-1])]
        owner = np.repeat(np.arange(n), size)
        local = np.arange(off[-1]) - off[owner]
        s, length, piece, score = self.edges(buf, off[owner + 1] - np.arange(off[-1]))
        turn = np.argsort(local[s], kind="stable")
        s, length, piece, score = s[turn], length[turn], piece[turn], score[turn]
        # a span's place p is node off[span] + span + p
        source, cut = s + owner[s], np.searchsorted(local[s], np.arange(size.max() + 1 if n else 1))
        target = source + length
        best, back = np.full(off[-1] + n, NONE), np.full(off[-1] + n, -1, np.int64)
        best[off[:-1] + np.arange(n)] = 0
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            live = a + np.flatnonzero(best[source[a:b]] > NONE)
            before = np.where(back[source[live]] >= 0, piece[back[source[live]]], -2)
            live = live[self.open(before, piece[live])]
            new, t = best[source[live]] + score[live], target[live]
            up = np.flatnonzero(new > best[t])
            best[t[up]], back[t[up]] = new[up], live[up]
        node, taken = off[1:] + np.arange(n), []
        live = np.flatnonzero(size > 0)
        if (back[node[live]] < 0).any():
            raise ValueError("the model's pieces don't lead through a text")
        while len(live):
            e = back[node[live]]
            taken.append(e)
            node[live] = source[e]
            live = live[local[s[e]] > 0]
        x = np.concatenate(taken) if taken else np.zeros(0, np.int64)
        x = x[np.argsort(s[x], kind="stable")]
        wide = np.where(piece[x] < 0, length[x], 1)
        ids = np.repeat(piece[x], wide)
        bad = ids < 0
        at = np.repeat(s[x], wide) + np.arange(len(ids)) - np.repeat(np.cumsum(wide) - wide, wide)
        ids[bad] = self.byte_ids[buf[at[bad]]]
        return ids.astype(self.kind), np.bincount(np.repeat(owner[s[x]], wide), minlength=n)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for, U+2581 as a space; the first space is still there."""
        n = self.size[ids]
        end = np.cumsum(n)
        return self.bytes[np.repeat(self.place[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


class Codec:
    """Pieces with a direct-mapped memory of 2**SLOTS units."""

    SLOTS, POOL = 20, 1 << 23

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._forget()

    def _forget(self) -> None:
        self.key, self.at, self.size = (np.zeros(1 << self.SLOTS, t) for t in (np.uint64, np.int32, np.int32))
        self.pool, self.used = np.empty(self.POOL, self.pieces.kind), 0

    @staticmethod
    def units(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        begin = data == SPACE
        begin[1:] &= ~(data[:-1] == SPACE)
        begin[off[:-1][off[:-1] < len(data)]] = True
        return np.flatnonzero(begin)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each span's ids begin); spans begin with their space, if any."""
        starts = self.units(data, off)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        rows = np.searchsorted(starts, off)
        h = hashes(data, starts, ends, EXACT) | np.uint64(1)
        if self.used > self.POOL // 2:
            self._forget()
        slot = fmix(h) >> np.uint64(64 - self.SLOTS)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            keys, where, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            ids, n = self.pieces.solve(data, starts[where], ends[where])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.empty(len(ids) + len(self.pool), self.pool.dtype)])
            self.pool[self.used : self.used + len(ids)] = ids
            begin = self.used + np.cumsum(n) - n
            self.used += len(ids)
            at[new], size[new] = begin[inverse], n[inverse]
            k = slot[where]
            self.key[k], self.at[k], self.size[k] = keys, begin, n
        done = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = self.pool[np.repeat(at - done[:-1], size) + np.arange(done[-1])]
        return flat, done[rows]

    def score(self, data: np.ndarray) -> np.int64:
        """Of the best path through one span."""
        return self.pieces.gain[self.encode(data, np.array([0, len(data)]))[0]].sum() if len(data) else np.int64(0)

    def states(self, data: np.ndarray, at: int) -> list[tuple[int, int]]:
        """(bytes beyond `at`, piece) of the pieces that reach or cross it; 0 for any piece in a unigram model."""
        low = max(0, at - self.pieces.most)
        seg = data[low : at + self.pieces.most]
        s, n, piece, _ = self.pieces.edges(seg, len(seg) - np.arange(len(seg)))
        hit = (s < at - low) & (s + n >= at - low)
        return sorted({(int(e), int(p) if self.pieces.merges else 0) for e, p in zip((s + n - at + low)[hit], piece[hit], strict=True)})

    def transfer(self, data: np.ndarray, begin: int, n: int, first: bool, last: bool) -> tuple[np.ndarray, list[int], list[int]]:
        """T of the chunk data[begin : begin + n], and its entry and exit states' overhangs.

        data also holds up to `most` bytes on either side.
        """
        end = begin + n
        entries = [(0, -2)] if first else self.states(data, begin)
        exits = None if last else self.states(data, end)
        sync = self.units(data, np.array([0, len(data)]))
        sync = sync[(sync >= begin) & (sync < end) & (sync > 0)]
        if len(sync):
            # every path passes the beginnings of units, and every step over one is open
            a, b = int(sync[0]), int(sync[-1])
            head = self._paths(data, begin, a, entries, None)
            middle = self.score(data[a:b])
            tail = self._paths(data, b, end, [(0, -2)], exits)
            t = np.where((head > NONE) & (tail > NONE), head + middle + tail, NONE)
        else:
            t = self._paths(data, begin, end, entries, exits)
        return t, [e for e, _ in entries], [e for e, _ in exits] if exits else [0]

    def _paths(self, data: np.ndarray, begin: int, end: int, entries: list[tuple[int, int]], exits: list[tuple[int, int]] | None) -> np.ndarray:
        """Best scores from each entry state to each exit state; without exits, to the place `end` itself."""
        n, known = end - begin, {}
        top = data[begin : end + (self.pieces.most if exits is not None else 0)]
        s, length, piece, score = self.pieces.edges(top, len(top) - np.arange(len(top)))
        order = np.argsort(s, kind="stable")
        s, length, piece, score = s[order], length[order].tolist(), piece[order].tolist(), score[order].tolist()
        cut = np.searchsorted(s, np.arange(n + 1)).tolist()
        at: dict[int, dict[int, np.ndarray]] = {}

        def reach(place: int, key: int, row: np.ndarray) -> None:
            there = at.setdefault(place, {})
            there[key] = np.maximum(there[key], row) if key in there else row

        for i, (e, p) in enumerate(entries):
            row = np.full(len(entries), NONE)
            row[i] = 0
            reach(e, p, row)
        for p in range(n):
            for key, row in at.pop(p, {}).items():
                for e in range(cut[p], cut[p + 1]):
                    if (key, piece[e]) not in known:
                        known[key, piece[e]] = bool(self.pieces.open(np.array([key]), np.array([piece[e]]))[0])
                    if known[key, piece[e]]:
                        reach(p + length[e], piece[e] if self.pieces.merges else 0, np.where(row > NONE, row + score[e], NONE))
        none = np.full(len(entries), NONE)
        if exits is None:
            rows = [np.max([none, *at.get(n, {}).values()], axis=0)]
        else:
            rows = [np.max([none, *at.get(n + e, {}).values()], axis=0) if not self.pieces.merges else at.get(n + e, {}).get(k, none) for e, k in exits]
        return np.array(rows).T


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return np.maximum(np.max(np.where((a[:, :, None] > NONE) & (b[None] > NONE), a[:, :, None] + b[None], NONE), axis=1), NONE)


def scan(ts: list[np.ndarray]) -> list[np.ndarray]:
    """Inclusive prefix products, by pairs."""
    if len(ts) < 2:
        return ts
    pairs = scan([compose(a, b) for a, b in zip(ts[::2], ts[1::2], strict=False)])
    return [ts[0] if i == 0 else pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], ts[i]) for i in range(len(ts))]


def boundaries(ts: list[np.ndarray]) -> np.ndarray:
    """The best path's state at the chunks' beginnings and at the end."""
    prefix = scan(ts)
    state = np.zeros(len(ts) + 1, np.int64)
    for k in range(len(ts) - 1, 0, -1):
        a, b = prefix[k - 1][0], ts[k][:, state[k + 1]]
        state[k] = int(np.argmax(np.where((a > NONE) & (b > NONE), a + b, NONE)))
    return state


def crc_join(a: int, b: int, n: int) -> int:
    """CRC-32 of two strings one after the other, the second of n bytes."""
    zero, at = bytes(min(n, 1 << 20)), 0
    c, d = a, 0
    while at < n:
        part = zero[: n - at]
        c, d, at = zlib.crc32(part, c), zlib.crc32(part, d), at + len(part)
    return c ^ d ^ b


_codecs: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    """One a worker process: what it remembers serves its later tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _plain(col: pa.Array) -> pa.Array:
    """Texts with U+2581 as a space."""
    return pc.replace_substring(col, "▁", " ") if pc.any(pc.match_substring(col, "▁")).as_py() else col


def _prefixed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With the space that every text begins with."""
    some = np.diff(off) > 0
    return np.insert(data, off[:-1][some], SPACE), off + np.concatenate([[0], np.cumsum(some)])


FIELDS = "n_tokens long, ids_crc32 long, whole boolean, ids array<int>"


def _coded(codec: Codec, data: np.ndarray, off: np.ndarray, with_ids: bool) -> list[pa.Array]:
    """The columns FIELDS of spans; `whole`: the ids decode to the span's bytes."""
    ids, cut = codec.encode(data, off)
    back = codec.pieces.decode(ids)
    size = np.concatenate([[0], np.cumsum(codec.pieces.size[ids])])[cut]
    wide = ids.astype("<u4")
    crc = [zlib.crc32(wide[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    same = np.array_equal(size, off - off[0]) and np.array_equal(back, data[off[0] : off[-1]])
    ok = [True] * len(crc) if same else [np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(size[:-1], size[1:], off[:-1], off[1:], strict=True)]
    lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(len(crc), pa.list_(pa.int32()))
    return [pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64()), pa.array(ok, pa.bool_()), lists]


NAMES = ["n_tokens", "ids_crc32", "whole", "ids"]


def _giants(docs: DataFrame, path: str, chunk: int, with_ids: bool) -> DataFrame:
    """doc_id, n_chunks and FIELDS of texts over `chunk` bytes."""
    spark = docs.sparkSession

    def cut(batches):
        from pyspark import TaskContext

        wide, rid = _codec(path).pieces.most, TaskContext.get().partitionId() << 33
        for batch in batches:
            for d in range(batch.num_rows):
                part = batch.slice(d, 1)
                data, off = _prefixed(*buffers(_plain(part.column("text"))))
                n = max(chunk, -(-len(data) // CHUNKS))
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                at = lead[np.searchsorted(lead, np.arange(n, len(data), n)).clip(max=len(lead) - 1)]
                at = np.unique(np.concatenate([[0], at, [len(data)]]))
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    low = max(0, a - wide)
                    yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), part.column("doc_id"), pa.array([k], pa.int32()), pa.array([a - low], pa.int32()), pa.array([b - a], pa.int32()), pa.array([b == len(data)]), pa.array([data[low : b + wide].tobytes()])], names=["rid", "doc_id", "k", "begin", "n", "last", "bytes"])
                rid += 1

    chunks, _ = materialize(docs.mapInArrow(cut, "rid long, doc_id long, k int, begin int, n int, last boolean, bytes binary"), "chunks")
    chunks = chunks.repartition("rid", "k")

    def matrices(batches):
        codec = _codec(path)
        for batch in batches:
            out = []
            for k, begin, n, last, raw in zip(*(batch.column(c).to_pylist() for c in ("k", "begin", "n", "last", "bytes")), strict=True):
                t, enter, leave = codec.transfer(np.frombuffer(raw, np.uint8), begin, n, k == 0, last)
                out.append((t.tobytes(), enter, leave))
            ts, enter, leave = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), pa.array(ts, pa.binary()), pa.array(enter, pa.list_(pa.int32())), pa.array(leave, pa.list_(pa.int32()))], names=["rid", "k", "t", "enter", "leave"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")  # at most CHUNKS rows
        state = boundaries([np.frombuffer(t, np.int64).reshape(len(i), len(j)) for t, i, j in zip(pdf["t"], pdf["enter"], pdf["leave"], strict=True)])
        return pd.DataFrame({"rid": pdf["rid"], "k": pdf["k"], "low": [int(x[i]) for x, i in zip(pdf["enter"], state[:-1], strict=True)], "high": [int(x[i]) for x, i in zip(pdf["leave"], state[1:], strict=True)]})

    at = chunks.select("rid", "k", "begin", "n", "last", "bytes").mapInArrow(matrices, "rid long, k int, t binary, enter array<int>, leave array<int>").groupBy("rid").applyInPandas(states, "rid long, k int, low int, high int")

    def trace(batches):
        codec = _codec(path)
        for batch in batches:
            spans = [raw[begin + low : begin + n + high] for raw, begin, n, low, high in zip(*(batch.column(c).to_pylist() for c in ("bytes", "begin", "n", "low", "high")), strict=True)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("k"), *_coded(codec, np.frombuffer(b"".join(spans), np.uint8), off, with_ids)], names=["rid", "doc_id", "k", *NAMES])

    done = chunks.join(at, ["rid", "k"]).mapInArrow(trace, f"rid long, doc_id long, k int, {FIELDS}")
    # at most CHUNKS rows a text
    whole = done.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("*").cast("int").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.every("whole").alias("whole"), F.sort_array(F.collect_list(F.struct("k", "n_tokens", "ids_crc32", "ids"))).alias("parts"))

    def join(batches):
        for batch in batches:
            crc, lists = [], []
            for parts in batch.column("parts").to_pylist():
                c, ids = 0, []
                for p in parts:
                    c = crc_join(c, p["ids_crc32"], 4 * p["n_tokens"])
                    ids += p["ids"] or []
                crc.append(c)
                lists.append(ids if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chunks"), batch.column("n_tokens"), pa.array(crc, pa.int64()), batch.column("whole"), pa.array(lists, pa.list_(pa.int32()))], names=["doc_id", "n_chunks", *NAMES])

    return whole.mapInArrow(join, f"doc_id long, n_chunks int, {FIELDS}")


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """doc_id, n_chunks, n_tokens, ids_crc32 (of ids as little-endian 32-bit integers), whole (the ids decode to
    the text) and, with with_ids, ids of every whole text."""
    texts = text_of(docs)
    giant = F.octet_length("text") > chunk

    def run(batches):
        codec = _codec(path)
        for batch, _, _ in blocks(batches):
            data, off = _prefixed(*buffers(_plain(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([1] * batch.num_rows, pa.int32()), *_coded(codec, data, off, with_ids)], names=["doc_id", "n_chunks", *NAMES])

    out = texts.where(~giant).mapInArrow(run, f"doc_id long, n_chunks int, {FIELDS}").union(_giants(texts.where(giant), path, chunk, with_ids))
    return out if with_ids else out.drop("ids")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text, ids of control pieces nothing."""

    def run(batches):
        pieces = _codec(path).pieces
        for batch in batches:
            texts = [pieces.decode(np.array(ids or [], np.int64)).tobytes().decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")

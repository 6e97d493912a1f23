"""Token-ID files with a static range asymmetric numeral system (rANS).

Container: rows of a Spark table in the shared store, so any file system that Spark reaches will do; each row
holds one segment, at most SEGMENT tokens of whole documents (a longer document stands alone). A segment is:

  magic "WMTK", version | lengths | document ids and token counts | frequency table shared by its blocks |
  per block: token count, lanes, words, CRC-32 of the coded words and of the tokens, checkpoints, final
  states, coded 16-bit words

Token i of a block belongs to lane i mod lanes; all lanes share one word stream (interleaving). Blocks don't
depend on each other, and at each checkpoint (step, words read, lane states) a decoder can begin inside one.
States stay in [2**32, 2**48) and are renormalised by 16 bits; probabilities have 20 bits. A state over a
frequency is less than 2**28, so a quotient of doubles is exact once rounded down.

Documents are range-partitioned and sorted by doc_id, then by the text's hash and by the input partition, so
that rows of one doc_id, or equal rows, can fill several partitions; every segment knows how many tokens precede
it in its partition, and one row a partition gives the partitions' offsets.

Defined results: null and empty texts have the end id only; the name of a special token in a text is that token,
as the library has it; repeated rows of a doc_id stand side by side (ordered by the text's hash); a null doc_id
comes first; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import blocks, materialize, text_of
from waymark.llm.words import EXACT, SPACED, fmix, hashes, spans

MAGIC, VERSION = b"WMTK", 1
BITS = 20
LOW = 1 << 32
LANES, BLOCK, SEGMENT, EVERY = 4096, 1 << 20, 1 << 22, 128
PART_BYTES = 24 << 20


def table_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): counts scaled to a sum of 2**BITS, each at least 1."""
    counts = np.bincount(tokens)
    symbols = np.flatnonzero(counts)
    c = counts[symbols].astype(np.float64)
    if len(symbols) > 1 << (BITS - 1):
        raise ValueError("too many distinct tokens for the table")
    room = (1 << BITS) - len(symbols)
    exact = c / c.sum() * room
    f = np.floor(exact).astype(np.int64)
    rest = room - int(f.sum())
    f[np.argsort(-(exact - f), kind="stable")[:rest]] += 1
    return symbols, f + 1


def encode_block(tokens: np.ndarray, freq: np.ndarray, cum: np.ndarray) -> bytes:
    """tokens: numbers of table entries."""
    n = len(tokens)
    lanes = int(min(LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.int64)
    out, written, marks = [], 0, []
    f_all, c_all = freq[tokens], cum[tokens]
    limit = f_all << (48 - BITS)
    by = f_all.astype(np.float64)
    for s in range(steps - 1, -1, -1):
        k = slice(s * lanes, (s + 1) * lanes)
        live = x[: len(f_all[k])]
        full = np.flatnonzero(live >= limit[k])
        if len(full):
            got = live[full]
            low, got = got.astype(np.uint16), got >> 16
            twice = np.flatnonzero(got >= limit[k][full])  # frequencies under 16
            if len(twice):
                # read first what was pushed last
                out.append(low[twice])
                low[twice] = got[twice].astype(np.uint16)
                got[twice] >>= 16
            out.append(low)
            written += len(low) + len(twice)
            live[full] = got
        q = (live / by[k]).astype(np.int64)
        q *= (1 << BITS) - f_all[k]
        live += q  # (q << BITS) + x - q f + c
        live += c_all[k]
        if s and s % EVERY == 0:
            marks.append((s, written, x.copy()))
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint16)
    payload = words.astype("<u2").tobytes()
    head = struct.pack("<IIIIII", n, lanes, len(words), len(marks), zlib.crc32(payload), 0)
    points = b"".join(struct.pack("<II", s, len(words) - w) + state.astype("<i8").tobytes() for s, w, state in marks[::-1])
    return head + points + x.astype("<i8").tobytes() + payload


class Block:
    """A coded block: decode() all of it, or its parts between checkpoints independently."""

    def __init__(self, raw: memoryview, slots: np.ndarray, freq: np.ndarray, cum: np.ndarray):
        self.n, self.lanes, words, marks, crc, _ = struct.unpack_from("<IIIIII", raw)
        at = 24
        self.starts = []
        for _ in range(marks):
            s, w = struct.unpack_from("<II", raw, at)
            self.starts.append((s, w, np.frombuffer(raw, "<i8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.starts.insert(0, (0, 0, np.frombuffer(raw, "<i8", self.lanes, at)))
        at += 8 * self.lanes
        if zlib.crc32(raw[at : at + 2 * words]) != crc:
            raise ValueError("checksum of a coded block differs")
        self.words = np.frombuffer(raw, "<u2", words, at).astype(np.int64)
        self.size = at + 2 * words
        self.slots, self.freq, self.cum = slots, freq, cum
        self.steps = -(-self.n // self.lanes)

    def part(self, k: int) -> np.ndarray:
        """Table entries from checkpoint k up to the next one."""
        step, at, state = self.starts[k]
        end = self.starts[k + 1][0] if k + 1 < len(self.starts) else self.steps
        x, lanes = state.astype(np.int64), self.lanes
        out = np.empty(min(end * lanes, self.n) - step * lanes, self.slots.dtype)
        mask = (1 << BITS) - 1
        for s in range(step, end):
            o = (s - step) * lanes
            live = x[: min(lanes, self.n - s * lanes)]
            slot = live & mask
            got = self.slots[slot]
            out[o : o + len(got)] = got
            live >>= BITS
            live *= self.freq[got]
            live += slot
            live -= self.cum[got]
            low = np.flatnonzero(live < LOW)
            while len(low):
                live[low] = (live[low] << 16) | self.words[at : at + len(low)]
                at += len(low)
                low = low[live[low] < LOW]
        return out

    def decode(self) -> np.ndarray:
        return np.concatenate([self.part(k) for k in range(len(self.starts))])


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    f = freq.astype(np.int64)
    return f, np.concatenate([[0], np.cumsum(f)[:-1]])


def encode_segment(ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    symbols, freq = table_of(tokens)
    number = np.zeros(int(symbols[-1]) + 1, np.int32)
    number[symbols] = np.arange(len(symbols), dtype=np.int32)
    f, cum = _tables(freq)
    index = zlib.compress(np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes() + lengths.astype("<i8").tobytes(), 1)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    coded = [encode_block(number[tokens[i : i + BLOCK]], f, cum) for i in range(0, len(tokens), BLOCK)]
    check = [zlib.crc32(tokens[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(tokens), BLOCK)]
    return b"".join([MAGIC, struct.pack("<IIIIII", VERSION, len(ids), len(index), len(symbols), len(table), len(coded)), index, table, *(struct.pack("<II", len(b), c) + b for b, c in zip(coded, check, strict=True))])


def decode_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, tokens); raises ValueError if a checksum differs."""
    view = memoryview(raw)
    version, n, n_index, n_symbols, n_table, n_blocks = struct.unpack_from("<IIIIII", view, 4)
    if view[:4] != MAGIC or version != VERSION:
        raise ValueError("not a token segment")
    at = 28
    index = zlib.decompress(view[at : at + n_index])
    none = np.frombuffer(index, "u1", n, 8 * n)
    ids = [None if x else i for i, x in zip(np.frombuffer(index, "<i8", n).tolist(), none.tolist(), strict=True)]
    lengths = np.frombuffer(index[9 * n :], "<i8", n)
    at += n_index
    table = np.frombuffer(zlib.decompress(view[at : at + n_table]), "<u4")
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:]
    at += n_table
    f, cum = _tables(freq)
    slots = np.repeat(np.arange(n_symbols, dtype=np.int32), freq)
    out = []
    for _ in range(n_blocks):
        size, crc = struct.unpack_from("<II", view, at)
        tokens = symbols[Block(view[at + 8 : at + 8 + size], slots, f, cum).decode()]
        if zlib.crc32(tokens.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block's tokens differs")
        out.append(tokens)
        at += 8 + size
    return ids, lengths, np.concatenate(out) if out else np.zeros(0, np.uint32)


class Encoder:
    """The library's ids of whole texts, remembered per word with the space or line feed before it.

    The byte-level pattern never joins what stands on both sides of a space, or of a single line feed, that is
    between two characters other than white space: such pieces have their own ids whatever surrounds them. A
    text with any other white space, or with the name of an added token, goes to the library whole, and so does
    every text if the file isn't of this kind. The memory is a direct-mapped table of 2**SLOTS pieces by hash, so
    its size is fixed.
    """

    SLOTS, POOL = 21, 1 << 24

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; the library's threads would each hold memory
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.plain, self.names = self._kind(json.load(f))
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each token: the byte-level alphabet has a letter a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self._forget()

    @staticmethod
    def _kind(file: dict) -> tuple[bool, list[bytes]]:
        """Whether words can be coded one by one, and the added tokens' names that must not be cut."""
        before, model, after = file.get("pre_tokenizer") or {}, file.get("model") or {}, file.get("post_processor")
        added = file.get("added_tokens") or []
        names = [t["content"].encode() for t in added]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not file.get("normalizer") and not file.get("truncation") and not file.get("padding")
        plain = plain and (after or {"type": "ByteLevel"})["type"] == "ByteLevel"
        return plain and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in added) and not any(c.isspace() for t in added for c in t["content"]), [n for n in names if n]

    def _forget(self) -> None:
        self.key, self.at, self.size = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32), np.zeros(1 << self.SLOTS, np.int32)
        self.pool, self.used = np.empty(self.POOL, self.kind), 0

    def _add(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(ids) + len(self.pool), self.kind)])
        at, self.used = self.used, self.used + len(ids)
        self.pool[at : self.used] = ids
        return at

    def _learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(places in the pool, lengths) of new pieces, by the library."""
        at, size = np.empty(len(pieces), np.int32), np.empty(len(pieces), np.int32)
        joined = [i for i, p in enumerate(pieces) if p[:1] in b" \n"]
        alone = [i for i, p in enumerate(pieces) if p[:1] not in b" \n"]
        for i, e in zip(alone, self.library.encode_batch_fast([pieces[i].decode() for i in alone], add_special_tokens=False), strict=True):
            at[i], size[i] = self._add(np.array(e.ids, self.kind)), len(e.ids)
        runs = [np.array(joined[i : i + 500]) for i in range(0, len(joined), 500)]
        for run, e in zip(runs, self.library.encode_batch_fast([b"".join(pieces[i] for i in run).decode() for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.kind)
            begin = np.concatenate([[0], np.cumsum([len(pieces[i]) for i in run])])
            cut = np.searchsorted(np.concatenate([[0], np.cumsum(self.bytes[ids])]), begin)
            at[run], size[run] = self._add(ids) + cut[:-1], np.diff(cut)
        return at, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Each text's ids, as little-endian integers of self.kind."""
        starts, ends, rows = spans(data, off, SPACED)
        raw = data.tobytes()
        odd = self._odd(data, off, starts, ends, rows) if self.plain else np.diff(off) > 0
        for name in self.names:
            at = raw.find(name)
            while at >= 0:
                odd[np.searchsorted(off, at, "right") - 1] = True
                at = raw.find(name, at + 1)
        plain = np.repeat(~odd, np.diff(rows))
        starts, ends = starts[plain], ends[plain]
        of = np.repeat(np.arange(len(odd)), np.diff(rows))[plain]
        first = starts == off[of]
        h = hashes(data, starts, ends, EXACT)
        lead = data[np.maximum(starts - 1, 0)]
        lead = np.where(first, 0, lead).astype(np.uint64)
        h = fmix(h + lead * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1)
        if self.used > self.POOL - (1 << 22):
            self._forget()
        slot = h >> np.uint64(64 - self.SLOTS)
        at, size = self.at[slot], self.size[slot]
        new = np.flatnonzero(self.key[slot] != h)
        if len(new):
            keys, where, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            where = new[where]
            begin, end = starts[where] - ~first[where], ends[where]
            got_at, got_size = self._learn([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            at[new], size[new] = got_at[inverse], got_size[inverse]
            k = slot[where]
            self.key[k], self.at[k], self.size[k] = keys, got_at, got_size
        done = np.cumsum(size, dtype=np.int64)
        flat = self.pool[np.repeat(at - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        cut = np.concatenate([[0], done])[np.searchsorted(of, np.arange(len(odd) + 1))]
        out = [flat[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        if odd.any():
            some = np.flatnonzero(odd)
            texts = [data[off[d] : off[d + 1]].tobytes().decode() for d in some]
            for d, e in zip(some, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[d] = np.array(e.ids, self.kind).tobytes()
        return out

    @staticmethod
    def _odd(data, off, starts, ends, rows) -> np.ndarray:
        """Texts that aren't words with one space or line feed between them."""
        n = np.diff(rows)
        odd = (n == 0) & (np.diff(off) > 0)
        some = n > 0
        odd[some] |= (starts[rows[:-1][some]] != off[:-1][some]) | (ends[rows[1:][some] - 1] != off[1:][some])
        gap = np.flatnonzero((starts[1:] - ends[:-1] != 1) | ((data[ends[:-1]] != 0x20) & (data[ends[:-1]] != 0x0A))) if len(starts) > 1 else np.zeros(0, np.int64)
        left, right = np.searchsorted(rows, gap, "right"), np.searchsorted(rows, gap + 1, "right")
        odd[left[left == right] - 1] = True
        # white space beyond ASCII, and the four separators that only some call white space
        lead = np.flatnonzero(WIDE[data])
        if len(lead):
            b, c = data[lead], data[np.minimum(lead + 1, len(data) - 1)]
            wide = (b < 0x20) | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))) | ((b == 0xE1) & ((c == 0x9A) | (c == 0xA0))) | ((b == 0xE2) & ((c == 0x80) | (c == 0x81))) | ((b == 0xE3) & (c == 0x80))
            odd[np.searchsorted(off, lead[wide], "right") - 1] = True
        return odd


WIDE = np.zeros(256, bool)
WIDE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One a worker process: what it remembers serves its later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """Encode and write all texts; returns the written container: part, before, first_id, n_tokens, segment."""
    source = text_of(docs)
    size = source.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def run(batches):
        from pyspark import TaskContext

        encoder, part, before = _encoder(path), TaskContext.get().partitionId(), 0
        kind, ids, pieces, held = encoder.kind, [], [], 0
        stop = np.array([end], kind).tobytes()
        width = kind.itemsize

        def segment():
            nonlocal ids, pieces, held, before
            raw = encode_segment(ids, np.array([len(p) // width for p in pieces]), np.frombuffer(b"".join(pieces), kind))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([before], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([held], pa.int64()), pa.array([raw], pa.binary())], names=["part", "before", "first_id", "n_tokens", "segment"])
            before += held
            ids, pieces, held = [], [], 0
            return row

        for batch, data, off in blocks(batches):
            for i, got in zip(batch.column("doc_id").to_pylist(), encoder.encode(data, off), strict=True):
                if held and held + len(got) // width + 1 > SEGMENT:
                    yield segment()
                ids.append(i)
                pieces.append(got + stop)
                held += len(got) // width + 1
        if held:
            yield segment()

    source = source.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("origin"))
    ordered = source.repartitionByRange(int(parts), "doc_id", "hash", "origin").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part long, before long, first_id long, n_tokens long, segment binary"), "tokens")[0]


def read(container: DataFrame) -> DataFrame:
    """doc_id, part, place (tokens before it in the part), n_tokens, ids_crc32, from the files."""

    def run(batches):
        for batch in batches:
            for part, before, raw in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("segment"), strict=True):
                ids, lengths, tokens = decode_segment(raw.as_py())
                data = tokens.astype("<u4")
                cut = np.concatenate([[0], np.cumsum(lengths)])
                crc = [zlib.crc32(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int64()), pa.array(before + cut[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    return container.select("part", "before", "segment").mapInArrow(run, "doc_id long, part long, place long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, end: int = 0) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files."""
    spark = docs.sparkSession
    container = write(docs, path, end)
    sums = container.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a partition
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in sums])])
    base = spark.createDataFrame([(r["part"], int(s)) for r, s in zip(sums, starts)], "part long, base long")
    return read(container).join(base, "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")

"""Near duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. One pass over the texts: words, distinct k-word shingles (64-bit hashes), a 128-bit digest of the set,
   and for each text 128 minima under universal hash functions, cut into 32 bands of 4.
2. Texts with equal sets are one class, which has a number of its own; only classes go on.
3. For the texts that share a bucket (band, key), the shingles that another such text has too are counted.
   A pair has at most the smaller of the two counts in common, so most texts that only resemble others
   leave their buckets at once, exactly.
4. Members of a bucket are linked to its smallest class; the connected components of these links, by
   alternating large-star and small-star, are blocks: texts in different blocks can't be linked. A block of at
   most BLOCK texts and SHINGLES shingles is settled in one task: a breadth-first search compares signatures,
   then confirms on full sets, and only meets texts that no component has yet.
5. The texts of a larger block are dealt into parts, and every two parts are settled together in one task, so that
   all of its texts meet; large-star and small-star join what these tasks found. Rows grow with texts times parts.

So no pair that shares a bucket goes unchecked unless it is already connected. A pair at the threshold shares
no bucket with a probability of (1 - 0.8**4)**32 = 5e-8, one above it still less.

Defined results: every row is a document of its own, whatever its doc_id, so different texts with one doc_id are
linked only if they are alike. null text, or text without words: no shingles, its own component, kept. Repeated
rows are returned once each, in one component. A row with a null doc_id links as others do; component_id is null
only if no document reachable has an id, and then it is kept. Of a component, keep_one keeps the smallest doc_id
(null last; of one id's texts the one with the smaller hash), and of equal rows one. Texts of any length are used
whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import BROADCAST_ROWS, blocks, by_ids, drop, materialize, release, spread_join
from waymark.llm.components import components
from waymark.llm.words import SPACED, fmix, ngrams, words

HASHES, BAND = 128, 4
_rng = np.random.Generator(np.random.PCG64(20240229))
_A = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = fmix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
#: Signature bytes that must agree: at similarity s their number is binomial(128, s + (1 - s) / 256); at 0.8 fewer than 70 have a probability below 1e-11
AGREE = 70


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of (a x + b) mod 2**64 for 128 odd a and any b."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        h = shingles[i : i + 256, None] * _A
        h += _B
        np.minimum(out, h.min(0), out=out)
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int):
    h, rows, _, _ = words(data, off, SPACED)
    grams, _, cut = ngrams(h, rows, k)
    return [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def keys_of() -> list[Column]:
    """d and t tell rows of different ids or texts apart; they are never null."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("d"), F.xxhash64(doc_id.isNull(), "text").alias("t")]


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), d and t."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *keys_of())


def prepare(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, d, t, n, digest, signature (a byte per minimum) and band keys of every text."""

    def run(batches):
        for batch, data, off in blocks(batches):
            n, digests, sigs, keys = [], [], [], []
            for s in shingle_sets(data, off, k):
                n.append(len(s))
                if len(s):
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig = signature(s)
                    mixed = sig * _MIX  # minima are small numbers: the first bytes of large sets' are nearly all 0
                    sigs.append((mixed >> np.uint64(56)).astype(np.uint8).view(np.int8))
                    keys.append(fmix(mixed.reshape(-1, BAND).sum(1, dtype=np.uint64)).view(np.int64))
                else:
                    digests.append(None)
                    sigs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("d"), batch.column("t"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int8())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "d", "t", "n", "digest", "sig", "keys"])

    return rows_of(docs).mapInArrow(run, "doc_id long, d long, t long, n long, digest binary, sig array<tinyint>, keys array<long>")


def sets_of(docs: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the rows in chosen: d, t, id."""
    few = chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # 24 bytes each: some 40 MB, or a shuffled join
    chosen = F.broadcast(chosen) if few else chosen.hint("merge")

    def run(batches):
        for batch, data, off in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.view(np.int64) for s in shingle_sets(data, off, k)], pa.list_(pa.int64()))], names=["id", "shingles"])

    return rows_of(docs).join(chosen, ["d", "t"]).select("id", "text").dropDuplicates(["id"]).mapInArrow(run, "id long, shingles array<long>")


def shared_counts(sets: DataFrame) -> DataFrame:
    """(id, n, c): the set's size, and how many of its shingles another set has too.

    A pair has at most min(c) shingles in common, which settles most members of large buckets without a pair.
    """
    single = sets.select("id", F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1")
    alone = single.groupBy("id").agg(F.count("*").alias("alone"))
    n = F.size("shingles").cast("long")
    return sets.select("id", n.alias("n")).join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("c"))


BLOCK, SHINGLES, HUBS = 4096, 1 << 23, 16


def agreeing(n: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """A number for each of a bucket's texts, the same for all that texts of like size and signature connect."""
    out, free = np.arange(len(n)), np.ones(len(n), bool)
    for first in range(len(n)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            x = queue.pop()
            u = np.flatnonzero(free)
            u = u[100 * np.minimum(n[u], n[x]) >= percent * np.maximum(n[u], n[x])]
            new = u[(sig[u] == sig[x]).sum(1) >= AGREE]
            free[new], out[new] = False, first
            queue += new.tolist()
    return out


def agreeing_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that connect the texts of each bucket which agree; rows: bucket, id, n, sig."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        bucket, ids, n = (t.column(x).to_numpy() for x in ("bucket", "id", "n"))
        sig = t.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)
        start = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        size = np.diff(np.append(start, len(bucket)))
        root = np.repeat(start, size)
        like = 100 * np.minimum(n, n[root]) >= percent * np.maximum(n, n[root])
        for a in range(0, len(n), 4096):
            like[a : a + 4096] &= (sig[a : a + 4096] == sig[root[a : a + 4096]]).sum(1) >= AGREE
        out = np.where(like, root, np.arange(len(n)))
        for i in np.flatnonzero((np.add.reduceat(like, start) < size) & (size > 2)):  # most buckets agree with their first text
            a, b = start[i], start[i] + size[i]
            out[a:b] = a + agreeing(n[a:b], sig[a:b], percent)
        linked = out != np.arange(len(n))
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[out[linked]])], names=["u", "v"])

    def run(batches):
        held = None  # the last bucket so far: at most BLOCK rows
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held else t
            bucket = t.column("bucket").to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1])) if len(bucket) else 0
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut)
        if held:
            yield solve(held)

    return rows.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(run, "u long, v long")


def settle(n: np.ndarray, c: np.ndarray, sig: np.ndarray, flat: np.ndarray, off: np.ndarray, percent: int) -> np.ndarray:
    """The number of one text connected to each of a block's texts; n, c: set sizes and shared counts.

    It begins with texts whose shingles are mostly shared: of copies with edits, that is the one they are copies of.
    """
    out, free = np.arange(len(n)), np.ones(len(n), bool)
    for first in np.lexsort((np.arange(len(n)), -n, -c / n)):
        if not free[first]:
            continue
        free[first], queue = False, [first]
        while queue:
            x = queue.pop()
            u = np.flatnonzero(free)
            u = u[((100 + percent) * np.minimum(c[u], c[x]) >= percent * (n[u] + n[x])) & (100 * np.minimum(n[u], n[x]) >= percent * np.maximum(n[u], n[x]))]
            u = u[(sig[u] == sig[x]).sum(1) >= AGREE]
            if not len(u):
                continue
            own, size = flat[off[x] : off[x + 1]], n[u]
            begin = np.cumsum(size) - size
            h = flat[np.repeat(off[u] - begin, size) + np.arange(size.sum())]
            common = np.add.reduceat(own[np.searchsorted(own, h).clip(max=len(own) - 1)] == h, begin)
            new = u[100 * common >= percent * (n[u] + n[x] - common)]
            free[new], out[new] = False, first
            queue += new.tolist()
    return out


def settle_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """(id, component) of whole blocks; rows: block, id, n, c, sig, shingles."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        sets = t.column("shingles").combine_chunks()
        flat = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        off = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy())]).astype(np.int64)
        sig = t.column("sig").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)
        ids = t.column("id").to_numpy()
        got = settle(*(t.column(x).to_numpy() for x in "nc"), sig, flat, off, percent)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[got])], names=["id", "component"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the last block so far: at most BLOCK rows, SHINGLES shingles
        for batch in batches:
            block = batch.column("block").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if held and a < b and held[0].column("block")[0].as_py() != block[a]:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.repartition("block").sortWithinPartitions("block", "id").mapInArrow(run, "id long, component long")


def two_parts(rows: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """rows of the keys in large (key, parts: 2 or more), dealt into parts by id: every two parts share a new key."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = rows.join(F.broadcast(large), key).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    twos = dealt.select("*", other).where("other <> part").withColumn(key, F.xxhash64(key, F.least("part", "other"), F.greatest("part", "other")))
    return twos.select(rows.columns)


def settle_parts(rows: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(id, component) of whole blocks too large for a task; rows as in settle_blocks, large: block, parts (2 or more).

    A block's texts are dealt into parts by hash, and every two parts are settled together as a block of their
    own, so any two texts meet in a task; the components of what these tasks found are the block's. Up to HUBS texts
    of the block that share most of their shingles are in all of its tasks.
    """
    some = rows.join(F.broadcast(large), "block")
    best = F.max_by("id", F.struct(F.col("c") / F.col("n"), "n", "id")).alias("id")
    hubs = some.groupBy("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(HUBS))).agg(best).select("id")
    low, high = (F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(x) for x in ("low", "high"))
    tasks = some.join(F.broadcast(hubs), "id").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select("*", low).select("*", high)
    tasks = tasks.where("low < high and part <> low and part <> high").withColumn("block", F.xxhash64("block", "low", "high")).select(rows.columns)
    twos = two_parts(rows, large, "block").union(tasks)
    found, path = materialize(settle_blocks(twos, percent).where("id <> component").distinct(), "found")
    labels = components(found.select(F.col("id").alias("u"), F.col("component").alias("v")))
    drop(rows.sparkSession, path)
    return labels


def classes(docs: DataFrame, k: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row, with d, t and stays (the row or its equals stand for the
    component); see the module's text."""
    spark = docs.sparkSession
    seen, seen_path = materialize(prepare(docs, k), "minima")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d", "t")
    reps = seen.where("n > 0").groupBy("digest").agg(F.min(row).alias("row"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"))
    # the numbers are drawn once, as the table is written
    reps, reps_path = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "reps")
    members = reps.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("bucket"))
    several = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members, members_path = materialize(spread_join(members, several, "bucket", how="inner"), "buckets")
    release(spark)  # here and below: dozens of shuffles follow each other, and a heap only grows
    tall, tall_path = materialize(members.groupBy("bucket").count().where(F.col("count") > block).select("bucket", F.ceil(2 * F.col("count") / block).cast("int").alias("parts")), "tall")
    rows = members.join(reps.select("id", "n", "sig"), "id").select("bucket", "id", "n", "sig")
    if not tall.isEmpty():
        rows = rows.join(F.broadcast(tall), "bucket", "left_anti").union(two_parts(rows, tall, "bucket"))
    links, links_path = materialize(agreeing_pairs(rows, percent), "agreeing")
    blocks_, blocks_path = materialize(components(links).withColumnRenamed("component", "block"), "blocks")
    chosen = reps.select("row.d", "row.t", "id").join(blocks_.select("id"), "id", "left_semi").select("d", "t", "id")
    chosen, chosen_path = materialize(chosen, "chosen")
    sets, sets_path = materialize(sets_of(docs, chosen, k), "sets")
    release(spark)
    counts, counts_path = materialize(shared_counts(sets).where(f"100 * c >= {percent} * n"), "shared")

    placed = counts.join(blocks_, "id")
    large = placed.groupBy("block").agg(F.count("*").alias("texts"), F.sum("n").alias("size")).where((F.col("texts") > block) | (F.col("size") > SHINGLES))
    # two parts hold about as much as the largest block that one task settles
    large = large.select("block", F.greatest(F.ceil(2 * F.col("texts") / block), F.ceil(2 * F.col("size") / SHINGLES)).cast("int").alias("parts"))
    large, large_path = materialize(large, "large")
    some = not large.isEmpty()
    full = placed.join(reps.select("id", "sig"), "id").join(sets, "id").select("block", "id", "n", "c", "sig", "shingles")
    labels, labels_path = materialize(settle_blocks(full.join(F.broadcast(large), "block", "left_anti") if some else full, percent), "labels")
    if some:
        labels = labels.union(settle_parts(full, large, percent))
    release(spark)
    # back to all rows: a class or a component of several rows has its first row's id
    inside = labels.join(reps.select("id", "row"), "id")
    best = inside.groupBy("component").agg(F.min("row").alias("best"), F.count("*").alias("size"))
    joined = spread_join(inside.select("id", "component"), best, "component").select("id", "best")
    whole = reps.select("id", "digest", "row", "size").join(joined, "id", "left").select("digest", "size", F.coalesce("best", "row").alias("best"), "row")
    whole, whole_path = materialize(whole.where("size > 1 or best <> row").drop("row"), "whole")
    out = spread_join(seen.select("doc_id", "d", "t", "n", "digest"), whole, "digest")
    stays = F.col("best").isNull() | ((F.col("best.none") == F.col("doc_id").isNull()) & (F.col("best.d") == F.col("d")) & (F.col("best.t") == F.col("t")))
    out, _ = materialize(out.select("doc_id", "d", "t", F.col("n").alias("n_shingles"), F.coalesce("best.doc_id", "doc_id").alias("component_id"), stays.alias("stays")), "classes")
    drop(spark, seen_path, reps_path, members_path, tall_path, links_path, blocks_path, chosen_path, sets_path, counts_path, large_path, labels_path, whole_path)
    release(spark)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    return classes(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns of documents; see the module's text."""
    found = classes(docs, k, percent)
    key, columns = ["d", "t"], ["doc_id", "text", "lang", "source", "n_chars"]
    named = docs.select(*columns, *keys_of())
    out = by_ids(named, found.where("not stays").select(key).distinct(), "left_anti")
    again = found.groupBy(key).count().where("count > 1").select(key)
    if not again.isEmpty():
        out = by_ids(out, again, "left_anti").union(by_ids(out, again, "left_semi").dropDuplicates(key))
    return out.select(columns)

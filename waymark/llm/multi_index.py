"""Approximate nearest neighbours: an inverted multi-index.

1. Equal vectors are one entry (their k + 1 smallest ids can be anyone's neighbours, no others).
2. Unit vectors are cut in two halves, each quantised by its own k-means codebook. The codebooks are fitted
   on a bounded sample: the SAMPLE entries that come first by hash. Every entry is indexed: its cell is the
   pair of its halves' centroids.
3. A query goes through the centroid pairs by the sum of the halves' distances (the multi-sequence walk, with a
   heap; a walk that gets long sorts all sums instead), until the cells it took hold a share of all entries. The share is measured, not set: TRIAL
   entries drawn by hash ask for their exact neighbours among all entries, and the smallest share is taken at
   which the cells walked hold `recall` of them.
4. Cells are stored in shards of about SHARD entries: neighbouring small cells share one, a larger cell has
   several. Query blocks meet the shards of their cells by an equi-join; by a matrix product a shard gives a
   query the best of those entries whose cells the query took (a bit for each cell of the shard), and these are
   reranked by the exact cosine of the original vectors. A query and a shard make k + 1 rows at most, however many cells they share.

On vectors without structure the share comes out large (0.7 or more on the test tables), and work then grows with
queries times vectors; clustered vectors give a small one.

Defined results: vectors that are null, zero, or hold a null or non-finite number, null ids, and vectors whose
dimension isn't the most frequent one (ties: the larger) take no part, neither as queries. Repeated rows count
once. An id with several vectors asks with each and is never its own neighbour. Ties go to the smaller vec_id.
Fewer candidates than k: all of them. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import drop, materialize

SAMPLE, SAMPLE_BYTES, TRIAL, SHARD, BLOCK, LONG = 16_384, 64 << 20, 256, 8192, 512, 1000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles, without negative zeros) of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0)
    )
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("v") == (size["n"] if size else 0))


def keys() -> tuple[Column, Column]:
    return F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (2 * x @ c.T - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, need: int) -> np.ndarray:
    """Cells i * len(b) + j that hold entries, in order of a[i] + b[j], until they hold `need` of them."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen, out, held, steps = [(float(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}, [], 0, 0
    while heap and held < need and steps < LONG:
        _, i, j = heapq.heappop(heap)
        steps += 1
        cell = int(oa[i]) * len(b) + int(ob[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (float(a[oa[i2]] + b[ob[j2]]), i2, j2))
    if not heap or held >= need:
        return np.array(out, np.int64)
    cells = np.argsort((a[:, None] + b).ravel(), kind="stable")
    cells = cells[counts[cells] > 0]
    return cells[: int(np.searchsorted(np.cumsum(counts[cells]), need)) + 1]


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def distances(v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Squared distances of the unit vectors' halves to the centroids."""
    u = v / np.abs(v).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    h = books[0].shape[1]
    return [(x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1) for x, c in zip((u[:, :h], u[:, h:]), books, strict=True)]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a with the vector b, in double precision."""
    sa, sb = np.abs(a).max(1, keepdims=True), np.abs(b).max()
    if sa.max() > 1e100 or sb > 1e100 or sa.min() < 1e-100 or sb < 1e-100:  # squares would leave the range
        a, b = a / sa, b / sb
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum()))


def exact_top(entries: DataFrame, asks: np.ndarray, k: int) -> DataFrame:
    """(ask, score, cell): the 2nd to k-th nearest entries of each ask, itself an entry, by exact cosine; entries:
    v and cell. Each task keeps its best only, so k rows an ask and task are shuffled."""

    def run(batches):
        score, cell = np.full((len(asks), 0), -np.inf), np.zeros((len(asks), 0), np.int64)
        unit = asks / np.sqrt((asks * asks).sum(1, keepdims=True))
        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                v = _matrix(part.column("v"))
                v = v / np.abs(v).max(1, keepdims=True)
                s = unit @ (v / np.sqrt((v * v).sum(1, keepdims=True))).T
                c = np.broadcast_to(part.column("cell").to_numpy(), s.shape)
                score, cell = np.concatenate([score, s], 1), np.concatenate([cell, c], 1)
                if score.shape[1] > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, cell = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        n = score.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asks)), n).astype(np.int32)), pa.array(score.ravel()), pa.array(cell.ravel().astype(np.int32))], names=["ask", "score", "cell"])

    found = entries.select("v", "cell").mapInArrow(run, "ask int, score double, cell int")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "cell")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k)).select("ask", "score", "cell")


def needed(found: pa.Table, a: np.ndarray, b: np.ndarray, counts: np.ndarray, recall: float) -> int:
    """How many entries a walk must take for `recall` of the neighbours found (their cells) to be among them."""
    ask, cell, held = found["ask"].to_numpy(), found["cell"].to_numpy(), []
    for q in np.unique(ask):
        cells = np.argsort((a[q][:, None] + b[q]).ravel(), kind="stable")  # the walk's order
        upto = np.zeros(len(counts), np.int64)
        upto[cells] = np.cumsum(counts[cells])
        held.append(upto[cell[ask == q]])
    if not held:
        return 1  # a single entry
    held = np.sort(np.concatenate(held))
    return int(held[min(len(held) - 1, int(np.ceil(recall * len(held))) - 1)])


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.95) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    out_schema = "query_id long, rank int, vec_id long, score double"
    k1, k2 = keys()
    rows, _ = materialize(usable(vectors).select("vec_id", "v", k1, k2), "vectors")
    by_id = Window.partitionBy("k1", "k2").orderBy("vec_id")
    few = rows.dropDuplicates(["k1", "k2", "vec_id"]).withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    entries, entries_path = materialize(few.groupBy("k1", "k2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    got = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    n = got[0]
    if not n:
        return spark.createDataFrame([], out_schema)
    codewords = int(np.clip(round((n / 16) ** 0.5), 2, 256))
    some = max(codewords, min(SAMPLE, SAMPLE_BYTES // (8 * got[1])))
    sample = entries.orderBy("k1", "k2").limit(some).select("v").toArrow()["v"].combine_chunks()  # at most SAMPLE vectors, SAMPLE_BYTES
    sample = _matrix(sample)
    if sample.shape[1] < 2:
        sample = np.concatenate([sample, np.zeros_like(sample)], 1)  # a second half of zeros
    unit = sample / np.abs(sample).max(1, keepdims=True)
    unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
    half = max(1, unit.shape[1] // 2)
    books = (kmeans(unit[:, :half], codewords), kmeans(unit[:, half:], codewords))
    wide = len(books[1])

    def matrix(col):
        v = _matrix(col)
        return np.concatenate([v, np.zeros_like(v)], 1) if v.shape[1] < 2 else v

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = distances(matrix(batch.column("v")), books)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((a.argmin(1) * wide + b.argmin(1)).astype(np.int32))], names=[*batch.schema.names, "cell"])

    cells, _ = materialize(entries.mapInArrow(assign, "k1 long, k2 long, v array<double>, ids array<long>, cell int"), "cells")
    sizes = cells.groupBy("cell").count().collect()  # at most a row a centroid pair
    counts = np.zeros(len(books[0]) * wide, np.int64)
    for r in sizes:
        counts[r["cell"]] = r["count"]
    trial = unit[:: max(1, len(unit) // TRIAL)][:TRIAL]  # the sample is in hash order
    found = exact_top(cells, trial[:, : got[1]], k + 1).toArrow()  # k rows a trial vector
    need = needed(found, *distances(trial, books), counts, recall)
    drop(spark, entries_path)

    # shards: cells in their order, a cell over SHARD entries spread over several
    first, spread, shard, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    live = np.flatnonzero(counts)
    for c in live:
        spread[c] = -(-counts[c] // SHARD)
        if held and held + counts[c] > SHARD:
            shard, held = shard + 1, 0
        first[c] = shard
        shard, held = (shard + spread[c], 0) if spread[c] > 1 else (shard, held + counts[c])
    place = np.zeros(len(counts), np.int64)  # of a cell among those with entries
    place[live] = np.arange(len(live))
    last = first[live] + spread[live] - 1
    every_shard = np.arange(last[-1] + 1)
    low, high = np.searchsorted(last, every_shard), np.searchsorted(first[live], every_shard, "right")  # the places in a shard
    places = F.broadcast(spark.createDataFrame([(int(c), int(first[c]), int(spread[c])) for c in live], "cell int, first long, spread long"))
    salted = cells.join(places, "cell").withColumn("shard", F.col("first") + F.pmod("k2", "spread"))
    shards = salted.groupBy("shard").agg(F.collect_list(F.struct("v", "ids", "cell")).alias("entries"))

    # query blocks: one row for each shard that a query of the block goes to
    asked = rows.where(F.col("vec_id") % every == 0)
    asks = asked.groupBy("k1", "k2").agg(F.first("v").alias("v"))
    # about a block a task, whatever its bytes: the walks are the work
    asks = asks.repartition(-(-asks.count() // BLOCK) or 1, "k1", "k2")

    def route(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                part = batch.slice(s, BLOCK)
                a, b = distances(matrix(part.column("v")), books)
                taken = np.zeros((part.num_rows, len(live)), bool)
                for q in range(part.num_rows):
                    taken[q, place[walk(a[q], b[q], counts, need)]] = True
                for at in every_shard.tolist():
                    open_ = taken[:, low[at] : high[at]]
                    qs = np.flatnonzero(open_.any(1))
                    if not len(qs):
                        continue
                    bits = pa.array([x.tobytes() for x in np.packbits(open_[qs], axis=1)], pa.binary())
                    rows_ = pa.StructArray.from_arrays([*(part.column(c).take(pa.array(qs)) for c in ("k1", "k2", "v")), bits], ["k1", "k2", "v", "cells"])
                    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(qs)], pa.int32()), rows_)], names=["shard", "asks"])

    routed = asks.mapInArrow(route, "shard long, asks array<struct<k1: long, k2: long, v: array<double>, cells: binary>>")

    def best(batches):
        for batch in batches:
            out = []
            for at, asks_, entries_ in zip(batch.column("shard").to_pylist(), batch.column("asks"), batch.column("entries"), strict=True):
                asks_, entries_ = asks_.values, entries_.values
                q, e, ids = _matrix(asks_.field("v")), _matrix(entries_.field("v")), entries_.field("ids")
                local = place[entries_.field("cell").to_numpy()] - low[at]
                bits = np.frombuffer(b"".join(asks_.field("cells").to_pylist()), np.uint8).reshape(len(q), -1)
                open_ = np.unpackbits(bits, axis=1, count=int(high[at] - low[at])).astype(bool)
                s = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ (e / np.sqrt((e * e).sum(1, keepdims=True))).T
                s[~open_[:, local]] = -np.inf
                m = min(k + 1, len(e))
                least = -np.partition(-s, m - 1, axis=1)[:, m - 1] - 1e-9  # ties, and what rounding may have put behind, are reranked too
                for i, (a1, a2) in enumerate(zip(asks_.field("k1").to_pylist(), asks_.field("k2").to_pylist(), strict=True)):
                    x = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    found = sorted(((-c, v) for j, c in zip(x, cosine(e[x], q[i]).tolist(), strict=True) for v in ids[int(j)].as_py()))[: k + 1] if len(x) else []
                    out += [(a1, a2, -c, v) for c, v in found]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=["k1", "k2", "score", "vec_id"])

    # never broadcast: Spark takes the routed blocks for small, but they grow with queries times shards
    hits = routed.join(shards.hint("merge"), "shard").select("shard", "asks", "entries").mapInArrow(best, "k1 long, k2 long, score double, vec_id long")
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    top = top.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("top"))
    out = asked.select(F.col("vec_id").alias("query_id"), "k1", "k2").distinct().join(top.hint("merge"), ["k1", "k2"])
    mine = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return out.select("query_id", F.posexplode(mine).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")

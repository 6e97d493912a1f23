"""Vector search: exact, and by an inverted file of spherical k-means clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vector as V
from waymark.operators.lexical import best_per_entity, filtered

PER_CLUSTER, ROUNDS, PROBES, SIZE = 2500, 10, 3, 64
RANGES, PRODUCT = 64, 1 << 22


def prepared(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """id and unit vector of the first `size` components; shorter vectors are left out."""
    return vectors.select("id", V.truncated(F.col("embedding"), size).alias("v")).where("v is not null")


def clusters(n: int, per_cluster: int = PER_CLUSTER) -> int:
    return max(1, n // per_cluster)


def seeds(unit: DataFrame, k: int) -> DataFrame:
    """k vectors at even strides in the order of ids: the ids are ranked within ranges, so no task sorts them all."""
    n = unit.count()
    ranked = _numbered(unit)
    spots = unit.sparkSession.createDataFrame([(i, i * n // k) for i in range(min(k, n))], "cluster int, place long")
    return ranked.join(F.broadcast(spots), "place").select("cluster", "id", "v")


def _numbered(unit: DataFrame) -> DataFrame:
    """place: the row's number in the order of ids, from 0.

    Rows are counted by ranges of ids whose bounds are fixed first, so counting and ranking see the same ranges.
    """
    bounds = unit.agg(F.percentile_approx("id", [i / RANGES for i in range(1, RANGES)])).first()[0] or []
    cuts = sorted(set(bounds))
    part = F.lit(0)
    for c in cuts:  # as many terms as ranges
        part = part + (F.col("id") > c).cast("int")
    parts = unit.withColumn("part", part)
    sizes = dict(parts.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row a range
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    base = unit.sparkSession.createDataFrame(rows, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return parts.join(F.broadcast(base), "part").withColumn("place", F.col("before") + rank - 1).drop("part", "before")


def _nearest(centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    rows = max(1, PRODUCT // max(1, len(centroids)))  # so a product has PRODUCT numbers at most

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                yield pdf.assign(cluster=np.concatenate([(x[i : i + rows] @ centroids.T).argmax(1) for i in range(0, len(x), rows)]).astype(np.int32))
    return run


def assign(unit: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector's cluster: the largest dot product, ties to the first."""
    return unit.mapInPandas(_nearest(centroids), "id long, v array<double>, cluster int")


def recentre(assigned: DataFrame, old: np.ndarray) -> np.ndarray:
    """Unit means of the clusters; an empty cluster keeps its centroid. One row a cluster reaches the driver."""
    size = old.shape[1]
    sums = assigned.groupBy("cluster").agg(*(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(size))).collect()
    new = old.copy()
    for r in sums:
        s = np.array(r[1:], float)
        norm = np.sqrt((s * s).sum())
        new[r["cluster"]] = s / norm if norm > 0 else s
    return new


def fit(vectors: DataFrame, size: int = SIZE, per_cluster: int = PER_CLUSTER, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids, as rows; an empty table has none."""
    unit = prepared(vectors, size).persist()
    try:
        k = clusters(unit.count(), per_cluster)
        got = seeds(unit, k).orderBy("cluster").collect()
        c = np.array([r["v"] for r in got], float).reshape(-1, size)
        for _ in range(rounds if len(c) else 0):
            c = recentre(assign(unit, c), c)
        return c
    finally:
        unit.unpersist()


def inverted_lists(assigned: DataFrame, per_chunk: int = PER_CLUSTER) -> DataFrame:
    """cluster, chunk, position, id: lists cut into chunks in the order of ids."""
    r = F.row_number().over(Window.partitionBy("cluster").orderBy("id")) - 1
    return assigned.select("cluster", F.floor(r / per_chunk).cast("int").alias("chunk"), (r % per_chunk).cast("int").alias("position"), "id", "v")


def probes(query: np.ndarray, centroids: np.ndarray, n: int = PROBES) -> list[int]:
    return np.argsort(-(centroids @ query), kind="stable")[:n].tolist()


def query_vector(v: list[float], size: int = SIZE) -> np.ndarray:
    x = np.array(v[:size], float)
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else x


def search(assigned: DataFrame, query: np.ndarray, centroids: np.ndarray, limit: int | None = 10, n: int = PROBES) -> DataFrame:
    """(id, cosine) of the best vectors in the probed lists."""
    if assigned.schema["v"].dataType.simpleString() != "array<double>" or (len(centroids) and centroids.shape[1] != len(query)):
        raise ValueError("the query's size is not the index's")
    mine = assigned.where(F.col("cluster").isin(probes(query, centroids, n)))
    hit = mine.select("id", V.dot(F.col("v"), F.array(*(F.lit(float(x)) for x in query))).alias("cosine"))
    return hit if limit is None else hit.orderBy(F.desc("cosine"), "id").limit(limit)


def exact(vectors: DataFrame, query: np.ndarray, size: int = SIZE) -> DataFrame:
    return prepared(vectors, size).select("id", V.dot(F.col("v"), F.array(*(F.lit(float(x)) for x in query))).alias("cosine"))


def search_sections(hits: DataFrame, sections: DataFrame, entities: DataFrame, limit: int = 10, places=None, times=None, near=None, when=None) -> DataFrame:
    """Vector hits (id, cosine) as section results, one per entity."""
    from waymark.functions.text import truncated

    found = hits.withColumnRenamed("id", "doc").join(sections.select(F.col("id").alias("doc"), "entity_id"), "doc")
    top = best_per_entity(filtered(found, places, times, near, when), limit, F.desc("cosine"))
    s = sections.select(F.col("id").alias("doc"), F.col("title").alias("section_title"), "content")
    e = entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"), "article_id")
    return top.join(s, "doc").join(e, "entity_id", "left").select("entity_id", "doc", F.coalesce("entity_title", "section_title").alias("title"), F.coalesce("article_id", F.lit(0).cast("long")).alias("article_id"), "cosine", V.power(F.col("cosine")).alias("power"), "code", truncated(F.col("content")).alias("snippet"), F.lit("S").alias("type")).orderBy(F.desc("cosine"), "entity_id")


def pending(sections: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sections that have no vector yet."""
    return sections.join(vectors.select("id"), "id", "left_anti")


def embedding_input(sections: DataFrame, entities: DataFrame, prefix: str = "") -> DataFrame:
    e = entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"))
    return sections.join(e, "entity_id", "left").select("id", F.concat(F.lit(prefix), F.coalesce("entity_title", "title", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("input"))


def hash_embedder(size: int = SIZE) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A deterministic embedder for use without a model: signed counts of hashed words, at unit length."""
    import zlib

    def run(batches):
        for pdf in batches:
            out = np.zeros((len(pdf), size))
            for i, t in enumerate(pdf["input"]):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode())
                    out[i, h % size] += 1 if h >> 31 else -1
            n = np.sqrt((out * out).sum(1, keepdims=True))
            yield pd.DataFrame({"id": pdf["id"], "embedding": list((out / np.where(n > 0, n, 1)).astype(np.float32))})
    return run


def http_embedder(url: str, model: str, key: str = "", timeout: float = 30, most: int = 32) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Vectors from a server with the usual embeddings interface: POST {model, input} gives {data: [{index, embedding}]}."""
    import json
    import urllib.request

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), most):
                part = pdf.iloc[i : i + most]
                headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
                ask = urllib.request.Request(url, json.dumps({"model": model, "input": part["input"].fillna("").tolist()}).encode(), headers)
                with urllib.request.urlopen(ask, timeout=timeout) as r:
                    got = json.loads(r.read())
                data = sorted(got.get("data") or [], key=lambda d: d.get("index", 0))
                if len(data) != len(part):
                    raise ValueError(f"{len(data)} embeddings for {len(part)} texts: {(got.get('error') or {}).get('message', '')}")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": [np.array(d["embedding"], np.float32) for d in data]})
    return run


def embed_text(embedder, text: str) -> list[float]:
    """One text's vector, on the driver: a query's."""
    return list(next(iter(embedder(iter([pd.DataFrame({"id": [0], "input": [text]})]))))["embedding"].iloc[0])


def embed(inputs: DataFrame, embedder=None) -> DataFrame:
    """(id, embedding); any function of batches (id, input) serves, such as one that asks a model server."""
    return inputs.mapInPandas(embedder or hash_embedder(), "id long, embedding array<float>")

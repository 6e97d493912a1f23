"""BM25 search over section texts and entity labels.

An index is a table of postings (term, doc, tf, positions; a row holds a term's in some documents) and document
lengths, made in one pass. A query filters the postings to its own terms before anything is joined, so its cost
follows those terms' postings. Texts without a stored index are scanned: one pass for the corpus statistics, one
that scores, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import text as T
from waymark.functions.tiles import filled
from waymark.operators.events import Near, When, labelled
from waymark.operators.merge import first_by
from waymark.sources.batches import bound_batches


@dataclass
class Index:
    """rows: term, docs, tfs, positions, of some documents; a row without a term has the documents' lengths as tfs."""

    rows: DataFrame

    @property
    def postings(self) -> DataFrame:
        """term, doc, tf, positions."""
        return self.of(F.col("term").isNotNull())

    def of(self, wanted: Column) -> DataFrame:
        flat = self.rows.where(wanted).select("term", F.inline(F.arrays_zip("docs", "tfs", "positions")))
        return flat.select("term", F.col("docs").alias("doc"), F.col("tfs").alias("tf"), "positions")

    @property
    def terms(self) -> DataFrame:
        return self.rows.where("term is not null").select("term")

    @property
    def lengths(self) -> DataFrame:
        flat = self.rows.where("term is null").select(F.inline(F.arrays_zip("docs", "tfs")))
        return flat.select(F.col("docs").alias("doc"), F.col("tfs").alias("len"))


#: positions of a column begin so far after the one before's; a term's rows are dealt out in so many parts
STEP, PARTS, NAMES = 1_000_000, 16, ["term", "docs", "tfs", "positions"]


def _moved(positions: str, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def _list(starts: np.ndarray, end: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, end).astype(np.int32)), values)


def _grouped(columns: int):
    """Arrow batches of doc and token lists (w0, w1 and so on) into index rows; a row of the input is a document."""

    def run(batches):
        for batch in batches:
            n, terms, rows, spots = batch.num_rows, [], [], []
            for i in range(columns):
                w = batch.column(f"w{i}")
                size = pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64)
                terms.append(w.flatten())
                rows.append(np.repeat(np.arange(n), size))
                spots.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + i * STEP)
            words, row, spot = pa.concat_arrays(terms).dictionary_encode(), np.concatenate(rows), np.concatenate(spots)
            term = words.indices.to_numpy().astype(np.int64)
            order = np.lexsort((spot, term * n + row))
            term, row, spot = term[order], row[order], spot[order]
            pair = np.flatnonzero(np.diff(term * n + row, prepend=-1))  # where a term's next document begins
            tf, first = np.diff(pair, append=len(term)), np.flatnonzero(np.diff(term[pair], prepend=-1))
            docs = _list(first, len(pair), batch.column("doc").take(pa.array(row[pair])))
            places = _list(first, len(pair), _list(pair, len(term), pa.array(spot.astype(np.int32))))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[pair[first]])), docs, _list(first, len(pair), pa.array(tf)), places], names=NAMES)
            whole, size = np.zeros(1, np.int64), np.bincount(row, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), _list(whole, n, batch.column("doc")), _list(whole, n, pa.array(size)), pa.nulls(1, places.type)], names=NAMES)

    return run


def build(docs: DataFrame, doc: str, columns: list[Column]) -> Index:
    """Index of several text columns; a column's positions begin 1,000,000 after the one before, so no phrase crosses.

    Tokens are grouped where they are cut; only those of ids that come more than once are shuffled."""
    bound_batches(docs.sparkSession)
    words = docs.select(F.col(doc).alias("doc"), *(T.tokens(F.coalesce(c, F.lit(""))).alias(f"w{i}") for i, c in enumerate(columns)))
    schema = f"term string, docs array<{words.schema['doc'].dataType.simpleString()}>, tfs array<long>, positions array<array<int>>"
    again = docs.groupBy(F.col(doc).alias("again")).count().where("count > 1").select("again")
    if again.isEmpty():
        return Index(words.mapInArrow(_grouped(len(columns)), schema))
    same = F.col("doc").eqNullSafe(F.col("again"))
    once, more = (Index(words.join(again, same, how).mapInArrow(_grouped(len(columns)), schema)) for how in ("left_anti", "left_semi"))
    merged = more.postings.groupBy("term", "doc").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    merged = merged.select("term", *(F.array(c).alias(name) for c, name in zip(("doc", "tf", "positions"), NAMES[1:], strict=True)))
    return Index(once.rows.unionByName(merged).unionByName(more.rows.where("term is null")))


def written(index: Index, path: str) -> Index:
    """The index as a stored table, each file sorted by term so that a query's scan skips all others; a frequent
    term's rows are in several files."""
    spark = index.rows.sparkSession
    index.rows.repartition(F.col("term"), F.pmod(F.hash(F.get("docs", F.lit(0))), F.lit(PARTS))).sortWithinPartitions("term").write.mode("overwrite").parquet(path)
    return Index(spark.read.parquet(path))


@dataclass
class Scan:
    """Texts to be searched without a stored index: doc, and each column in lower case."""

    texts: DataFrame
    columns: int

    def total(self, pattern: str) -> Column:
        """Matches in all columns."""
        return sum(F.regexp_count(f"t{i}", F.lit(pattern)) for i in range(self.columns)).cast("long")

    @property
    def lengths(self) -> DataFrame:
        return self.texts.select("doc", self.total(WORD).alias("len"))


WORD, INSIDE, BETWEEN = r"[\p{L}\p{N}]+", r"[\p{L}\p{N}]", r"[^\p{L}\p{N}]+"


def scan(docs: DataFrame, doc: str, columns: list[Column]) -> Scan:
    return Scan(docs.select(F.col(doc).alias("doc"), *(F.lower(F.coalesce(c, F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns))), len(columns))


def _places(phrase: list[str]) -> str:
    """Matches (without width, so they may overlap) where the phrase's tokens stand side by side."""
    return f"(?<!{INSIDE})(?={BETWEEN.join(phrase)}(?!{INSIDE}))"


def bm25_scan(found: Scan, phrases: list[list[str]]) -> DataFrame:
    """Counted by expressions alone; no text is taken apart into an array."""
    per = found.texts.select("doc", found.total(WORD).alias("len"), *(found.total(_places(p)).alias(f"tf{k}") for k, p in enumerate(phrases)))
    total = per.agg(F.count("*").alias("docs"), F.avg("len").alias("average"), *(F.sum((F.col(f"tf{k}") > 0).cast("long")).alias(f"df{k}") for k in range(len(phrases)))).first()  # one row
    const = lambda x: F.lit(x if x is not None else 0)
    score, all_ = F.lit(0.0), F.lit(True)
    for k in range(len(phrases)):
        score = score + T.bm25_part(F.col(f"tf{k}"), F.col("len"), const(total["average"]), T.idf(const(total["docs"]), const(total[f"df{k}"])))
        all_ &= F.col(f"tf{k}") > 0
    return per.where(all_).select("doc", score.alias("score"))


def stats(index: Index | Scan) -> DataFrame:
    return index.lengths.agg(F.count("*").alias("docs"), F.avg("len").alias("average"))


def phrase_hits(index: Index, phrases: list[list[str]]) -> DataFrame:
    """(phrase, doc, tf): how often each phrase's tokens stand side by side."""
    terms = sorted({t for p in phrases for t in p})
    mine = index.of(F.col("term").isin(terms))
    parts = None
    for k, p in enumerate(phrases):
        at = mine.where(F.col("term") == p[0]).select("doc", "positions")
        for i, t in enumerate(p[1:], 1):
            nxt = mine.where(F.col("term") == t).select("doc", _moved("positions", i).alias("next"))
            at = at.join(nxt, "doc").select("doc", F.array_intersect("positions", "next").alias("positions"))
        hit = at.select(F.lit(k).alias("phrase"), "doc", F.size("positions").cast("long").alias("tf")).where("tf > 0")
        parts = hit if parts is None else parts.union(hit)
    return parts


def bm25(index: Index | Scan, query: str) -> DataFrame | None:
    """(doc, score) of the documents that match every phrase of the query; None for an empty query."""
    phrases = T.query_phrases(query)
    if not phrases:
        return None
    if isinstance(index, Scan):
        return bm25_scan(index, phrases)
    hits = phrase_hits(index, phrases)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))  # a row a phrase
    total = F.broadcast(stats(index))
    scored = hits.join(F.broadcast(df), "phrase").join(index.lengths, "doc").crossJoin(total)  # total is one row
    part = T.bm25_part(F.col("tf"), F.col("len"), F.col("average"), T.idf(F.col("docs"), F.col("df")))
    return scored.groupBy("doc").agg(F.sum(part).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(phrases)).drop("n")


def near_entities(places: DataFrame, near: Near) -> DataFrame:
    """Entities whose place nearest to the target is within the radius."""
    return near.places(places).groupBy("entity_id").agg(F.min_by("prop_code", F.struct("distance_km", "id")).alias("place_code"))


def timed_entities(times: DataFrame, when: When) -> DataFrame:
    """Entities with a matching time, and the property of the first such."""
    return times.where(when.predicate()).groupBy("entity_id").agg(F.min_by("prop_code", F.struct("julian_day", "prop_code")).alias("time_code"))


def filtered(hits: DataFrame, places: DataFrame | None, times: DataFrame | None, near: Near | None, when: When | None) -> DataFrame:
    """Hits (with entity_id) in the place and time asked for, with the property that matched: time before place."""
    code = F.lit(0)
    if near:
        hits = hits.join(near_entities(places, near), "entity_id")
        code = F.col("place_code")
    if when and when.given():
        hits = hits.join(timed_entities(times, when), "entity_id")
        code = F.col("time_code")
    return hits.withColumn("code", code).drop("place_code", "time_code")


def best_per_entity(hits: DataFrame, limit: int, order: Column, tie: str = "doc") -> DataFrame:
    """The best hit of each entity, then the best `limit` of these."""
    return first_by(hits, ["entity_id"], order, tie).orderBy(order, "entity_id").limit(limit)


def search_sections(sections: DataFrame, entities: DataFrame, index: Index | Scan, query: str, limit: int = 10, places=None, times=None, near: Near | None = None, when: When | None = None, overfetch: bool = False) -> DataFrame | None:
    """entity_id, doc, title, article_id, score, power, code, snippet; filters come before the top `limit`, so
    nothing is lost. overfetch: cut to 6 * limit hits (60 at least; 2000 with filters) first."""
    found = bm25(index, query)
    if found is None:
        return None
    if overfetch:
        found = found.orderBy(F.desc("score"), "doc").limit(2000 if near or when else max(60, 6 * limit))
    hits = found.join(sections.select(F.col("id").alias("doc"), "entity_id"), "doc")
    top = best_per_entity(filtered(hits, places, times, near, when), limit, F.desc("score"))
    s = sections.select(F.col("id").alias("doc"), F.col("title").alias("section_title"), "content")
    e = entities.select(F.col("id").alias("entity_id"), F.col("title").alias("entity_title"), "article_id")
    words = [t for p in T.query_phrases(query) for t in p]
    return top.join(s, "doc").join(e, "entity_id", "left").select(
        "entity_id", "doc", F.coalesce("entity_title", "section_title").alias("title"), F.coalesce("article_id", F.lit(0).cast("long")).alias("article_id"), "score", T.power(F.col("score")).alias("power"), "code",
        F.coalesce(filled(T.snippet(F.col("content"), words, 32)), T.truncated(F.col("content"))).alias("snippet"), F.lit("L").alias("type"),
    ).orderBy(F.desc("score"), "entity_id")


def label_index(entities: DataFrame) -> Index:
    return build(entities, "id", [T.fold_accents(F.col("title"))])


def search_labels(entities: DataFrame, index: Index | Scan, query: str, limit: int = 10, places=None, times=None, near: Near | None = None, when: When | None = None) -> DataFrame | None:
    """Entities by their labels, accents folded; the snippet is the description, else the marked label, else the title."""
    found = bm25(index, "".join(dict(zip(T.ACCENTED, T.PLAIN, strict=True)).get(c, c) for c in query.lower()))
    if found is None:
        return None
    hits = found.withColumn("entity_id", F.col("doc"))
    top = best_per_entity(filtered(hits, places, times, near, when), limit, F.desc("score"))
    words = [t for p in T.query_phrases(query) for t in p]
    out = labelled(top, entities, "Q")
    return out.select("entity_id", "title", "article_id", "description", "score", T.power(F.col("score")).alias("power"), "code", F.coalesce(filled(F.col("description"), T.snippet(F.col("title"), words, 16)), "title").alias("snippet"), F.lit("T").alias("type")).orderBy(F.desc("score"), "entity_id")

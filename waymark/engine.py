"""The facade: one object over a set of tables, with searches, look-ups, maps, index builds and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators import articles, events, hybrid, ingest, lexical, maps, merge, semantic
from waymark.sources import lines, model_file, raster, tile_archive

#: The schemas of the domain's tables
SCHEMAS = {
    "settings": "key string, value string",
    "entities": "id long, article_id long, title string, description string",
    "sections": "id long, entity_id long, title string, content string, pow int",
    "entity_times": "entity_id long, prop_code int, year int, month int, day int, julian_day long",
    "entity_places": "id long, entity_id long, prop_code int, latitude double, longitude double, precision double",
    "vectors": "id long, embedding array<float>",
    "tensors": "layer int, name string, dtype int, dims array<long>, data binary",
    "tiles": "zoom int, col int, row int, tile_data binary",
    "elevations": "zoom int, col int, row int, tile_data binary",
}

#: SQL functions that register() makes
FUNCTIONS = {
    "julian_day": "(y int, m int, d int) returns bigint return (case when d=0 then 1 else d end) + (153*((case when m=0 then 1 else m end) + 12*((14-(case when m=0 then 1 else m end)) div 12) - 3) + 2) div 5 + 365*(y+4800-((14-(case when m=0 then 1 else m end)) div 12)) + (y+4800-((14-(case when m=0 then 1 else m end)) div 12)) div 4 - (y+4800-((14-(case when m=0 then 1 else m end)) div 12)) div 100 + (y+4800-((14-(case when m=0 then 1 else m end)) div 12)) div 400 - 32045",
    "haversine_km": "(a double, b double, c double, d double) returns double return 2*6371.0*asin(sqrt(least(1.0, pow(sin(radians(c-a)/2),2)+cos(radians(a))*cos(radians(c))*pow(sin(radians(d-b)/2),2))))",
    "tile_x": "(lon double, z int) returns bigint return greatest(0, least(cast(pow(2,z) as bigint)-1, floor((lon+180)/360*pow(2,z))))",
    "tile_y": "(lat double, z int) returns bigint return greatest(0, least(cast(pow(2,z) as bigint)-1, floor((1-ln(tan(radians(greatest(-85.05112878, least(85.05112878, lat))))+1/cos(radians(greatest(-85.05112878, least(85.05112878, lat)))))/pi())/2*pow(2,z))))",
}


class Engine:
    """tables: DataFrames by name; those not given are the session's tables of that name, or empty.

    embed: a text's vector, for semantic and hybrid search; without it hybrid search has two lists.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, embed=None):
        self.spark, self.embed = spark, embed
        self.tables = {n: (tables or {}).get(n) if n in (tables or {}) else lines.table_or_empty(spark, n, s) for n, s in SCHEMAS.items()}
        self._sections: lexical.Index | None = None
        self._labels: lexical.Index | None = None
        self._ann = None

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    # --- indexes ---

    def index(self, path: str | None = None) -> None:
        """Build the text indexes; with a path they are written there, sorted by term so that scans skip."""
        self._sections = lexical.build(self.sections, "id", [F.col("title"), F.col("content")])
        self._labels = lexical.label_index(self.entities)
        if path:
            self._sections, self._labels = lexical.written(self._sections, f"{path}/sections"), lexical.written(self._labels, f"{path}/labels")

    def rebuild_ann(self, path: str | None = None, size: int = semantic.SIZE, per_cluster: int = semantic.PER_CLUSTER) -> None:
        """Centroids and inverted lists; with a path the lists are written by cluster, so a probe reads three."""
        c = semantic.fit(self.vectors, size, per_cluster)
        lists = semantic.assign(semantic.prepared(self.vectors, size), c) if len(c) else None
        if path and lists is not None:
            lists.write.mode("overwrite").partitionBy("cluster").parquet(path)
            lists = self.spark.read.parquet(path).select("id", "v", F.col("cluster").cast("int"))
        self._ann = (c, lists, size)

    def save(self, path: str) -> None:
        """Write all tables: a folder each, as Parquet."""
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def open(spark: SparkSession, path: str, embed=None) -> Engine:
        """Over the tables that save() or an import has written; missing ones are empty."""
        there = {n: lines.folder_or_empty(spark, f"{path}/{n}", s) for n, s in SCHEMAS.items()}
        return Engine(spark, there, embed)

    # --- imports ---

    def _take(self, new: dict[str, DataFrame], path: str | None) -> None:
        """Keep the imported tables; with a path they are written there and read again."""
        if path:  # all beside what is still read, then each in its place
            for name, df in new.items():
                df.write.mode("overwrite").parquet(f"{path}/{name}.new")
            for name in new:
                lines.moved(self.spark, f"{path}/{name}.new", f"{path}/{name}")
            new = {name: self.spark.read.parquet(f"{path}/{name}") for name in new}
        self.tables |= new
        self._sections = self._labels = self._ann = None

    def import_entities(self, source: str, path: str | None = None) -> None:
        """A dump of entities, by path or URL: parse, upsert, dates, places, links, pruning."""
        self._take(ingest.import_entities(lines.lines(self.spark, source), self.tables), path)

    def import_articles(self, source: str, path: str | None = None) -> None:
        """An archive of articles: entities and sections."""
        self._take(ingest.import_articles(lines.archive_lines(self.spark, source), self.tables), path)

    def import_store(self, store: dict[str, DataFrame], path: str | None = None) -> None:
        """An existing store's tables: settings, entities, sections, vectors."""
        self._take(ingest.import_store(store, self.tables), path)

    def import_tiles(self, source: str, path: str | None = None, zoom: int | None = None) -> None:
        """A tile archive: its tiles up to a zoom, and its metadata as settings."""
        most = None if zoom is None else (4 ** (zoom + 1) - 1) // 3
        shallow, data = tile_archive.tiles(self.spark, source, most)
        meta = merge.flat_settings(tile_archive.metadata_of(self.spark, source))
        self._take({"tiles": maps.tiles_view(shallow, data), "settings": merge.put_settings(self.settings, meta)}, path)

    def import_model(self, source: str, path: str | None = None) -> None:
        """A model file: its tensors, and its metadata as settings."""
        meta = model_file.metadata(self.spark, source).select(F.concat(F.lit("gguf_"), "key").alias("key"), "value")
        self._take({"tensors": model_file.tensors(self.spark, source), "settings": merge.put_settings(self.settings, meta)}, path)

    def embed_sections(self, path: str | None = None, embedder=None, prefix: str = "") -> None:
        """Vectors of the sections that have none yet."""
        todo = semantic.pending(self.sections, self.vectors)
        self._take({"vectors": self.vectors.unionByName(semantic.embed(semantic.embedding_input(todo, self.entities, prefix), embedder))}, path)

    def import_elevation(self, source: str, path: str | None = None, most: int = 7) -> None:
        """A raster into elevation tiles of the zooms 0 to `most`."""
        self._take({"elevations": raster.pyramid(self.spark, source, most)}, path)

    # --- searches ---

    def _criteria(self, lat, lon, radius, year, month, day, direction):
        near = events.Near(lat, lon, radius if radius and radius > 0 else 100.0) if lat is not None and lon is not None else None
        month = month if month and 1 <= month <= 12 else None
        day = day if day and 1 <= day <= 31 else None
        when = events.When(year or None, month, day, direction)
        return near, when if when.given() else None

    def search_events(self, latitude=None, longitude=None, radius=100.0, year=None, month=None, day=None, direction=0, limit=100) -> DataFrame | None:
        near, when = self._criteria(latitude, longitude, radius, year, month, day, direction)
        return events.search(self.entity_places, self.entity_times, self.entities, near, when, limit)

    def search_lexical(self, query: str, limit=10, near=None, when=None) -> DataFrame | None:
        if self._sections is None:
            self.index()
        return lexical.search_sections(self.sections, self.entities, self._sections, query, limit, self.entity_places, self.entity_times, near, when)

    def search_entities(self, query: str, limit=10, near=None, when=None) -> DataFrame | None:
        if self._labels is None:
            self.index()
        return lexical.search_labels(self.entities, self._labels, query, limit, self.entity_places, self.entity_times, near, when)

    def search_semantic(self, query: str, limit=10, near=None, when=None) -> DataFrame:
        if self.embed is None:
            raise ValueError("semantic search needs an embedder")
        if self._ann is None:
            self.rebuild_ann()
        c, lists, size = self._ann
        q = semantic.query_vector([float(x) for x in self.embed(query)], size)
        hits = semantic.search(lists, q, c, None) if lists is not None else self.spark.createDataFrame([], "id long, cosine double")
        return semantic.search_sections(hits, self.sections, self.entities, limit, self.entity_places, self.entity_times, near, when)

    def search_hybrid(self, query: str, limit=10, near=None, when=None) -> DataFrame | None:
        lists = [(self.search_entities(query, limit, near, when), "score"), (self.search_lexical(query, limit, near, when), "score")]
        if self.embed is not None:
            lists.append((self.search_semantic(query, limit, near, when), "cosine"))
        ranked = [hybrid.ranked(df, i, score) for i, (df, score) in enumerate(lists) if df is not None]
        return hybrid.fuse(ranked, limit) if ranked else None

    def search_knowledge(self, query: str, mode: str = "hybrid", limit=10, latitude=None, longitude=None, radius=100.0, year=None, month=None, day=None, direction=0) -> DataFrame | None:
        near, when = self._criteria(latitude, longitude, radius, year, month, day, direction)
        f = {"semantic": self.search_semantic, "lexical": self.search_lexical, "entity": self.search_entities}.get(mode, self.search_hybrid)
        return f(query, limit, near, when)

    def search(self, query: str = "", entity_id=None, article_id=None, id=None, mode="hybrid", limit=10, **where) -> DataFrame | None:
        """One entry for all: ids first, then events if there is no text, else the mode's search. Nothing asked: None."""
        for number in (entity_id, article_id, id):
            if number:
                return self.get_article(number)
        if not query.strip():
            hits = self.search_events(limit=limit, **where)
            return None if hits is None else hits.withColumns({"type": F.lit("E"), "power": F.lit(100.0), "snippet": F.col("description")})
        return self.search_knowledge(query, mode, limit, **where)

    # --- look-ups ---

    def get_article(self, number: int) -> DataFrame:
        return articles.get(self.sections, self.entities, number)

    def get_markdown(self, number: int) -> DataFrame:
        return articles.markdown(self.get_article(number))

    def entity_info(self, target=None) -> DataFrame:
        return events.entity_info(self.entity_times, self.entity_places, target)

    def get_map_config(self) -> DataFrame:
        return merge.map_config(self.settings)

    def get_map_centroids(self, latitude, longitude, radius_m=1000, zoom=14, limit=50) -> DataFrame:
        return maps.centroids(self.tiles, latitude, longitude, radius_m, min(30, max(0, zoom)), limit)

    def get_map_feature(self, latitude, longitude, number, radius_m=1000, zoom=14) -> DataFrame:
        return maps.feature_by_id(self.tiles, latitude, longitude, str(number), radius_m, zoom)

    def tile(self, zoom: int, x: int, y: int) -> DataFrame:
        return maps.fetch(self.tiles, zoom, x, y)

    def elevation(self, zoom: int, x: int, y: int) -> DataFrame:
        return maps.fetch(self.elevations, zoom, x, y)

    def has_model(self) -> bool:
        return not self.tensors.isEmpty() and not self.settings.where("key like 'gguf_%'").isEmpty()

    # --- SQL ---

    def register(self) -> None:
        """Tables as views and the scalar functions as SQL functions."""
        for n, df in self.tables.items():
            df.createOrReplaceTempView(n)
        for n, body in FUNCTIONS.items():
            self.spark.sql(f"create or replace temporary function {n}{body}")

    def sql(self, text: str) -> DataFrame:
        self.register()
        return self.spark.sql(text)

"""Command line: imports, index builds, searches and SQL over a folder of tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from waymark.engine import Engine
from waymark.operators import semantic
from waymark.sources import lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m waymark", description=__doc__)
    p.add_argument("--tables", default="waymark-tables", help="folder of the tables")
    for name, what in (("entities", "a dump of entities (.json, .gz, .bz2; path or URL)"), ("articles", "an archive of articles (.tar.gz; path or URL)"), ("store", "a folder of an existing store's tables as Parquet"), ("tiles", "a tile archive"), ("elevation", "an elevation raster"), ("model", "a model file")):
        p.add_argument(f"--import-{name}", metavar="SOURCE", help=f"import {what}")
    p.add_argument("--zoom", type=int, default=12, help="largest zoom of imported tiles")
    p.add_argument("--embed", action="store_true", help="make vectors for sections that have none")
    p.add_argument("--api-url", help="server of embeddings; without it words are hashed")
    p.add_argument("--api-key", default="")
    p.add_argument("--api-model", default="")
    p.add_argument("--prefix-save", default="", help="put before passages")
    p.add_argument("--prefix-search", default="", help="put before queries")
    p.add_argument("--compress", metavar="TO", help="write a compressed copy of the tables")
    p.add_argument("--decompress", metavar="TO", help="write an uncompressed copy of the tables")
    p.add_argument("--sql", metavar="TEXT", help="run a statement over the tables")
    p.add_argument("--search", metavar="TEXT", nargs="?", const="", help="search; without a text by place and time only")
    p.add_argument("--mode", default="hybrid", choices=("hybrid", "lexical", "semantic", "entity"))
    for name, kind in (("latitude", float), ("longitude", float), ("radius", float), ("year", int), ("month", int), ("day", int), ("direction", int), ("limit", int)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--article", type=int, help="an article as Markdown, by id")
    return p


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    embedder = semantic.http_embedder(a.api_url, a.api_model, a.api_key) if a.api_url else semantic.hash_embedder()
    e = Engine.open(spark, a.tables, embed=lambda text: semantic.embed_text(embedder, a.prefix_search + text))
    if a.import_entities:
        e.import_entities(a.import_entities, a.tables)
    if a.import_articles:
        e.import_articles(a.import_articles, a.tables)
    if a.import_store:
        known = lambda n, s: lines.folder_or_empty(spark, f"{a.import_store}/{n}", s)
        e.import_store({"articles": known("articles", "id long, title string, entity string"), "sections": known("sections", "id long, article_id long, title string, content string, pow int"), "setup": known("setup", "key string, value string"), "vectors": known("vectors", "id long, embedding array<float>")}, a.tables)
    if a.import_tiles:
        e.import_tiles(a.import_tiles, a.tables, a.zoom)
    if a.import_elevation:
        e.import_elevation(a.import_elevation, a.tables)
    if a.import_model:
        e.import_model(a.import_model, a.tables)
    if a.embed:
        e.embed_sections(a.tables, embedder, a.prefix_save)
    for to, how in ((a.compress, lines.compress), (a.decompress, lambda df, to: df.write.mode("overwrite").option("compression", "uncompressed").parquet(to))):
        if to:
            for name, df in e.tables.items():
                how(df, f"{to}/{name}")
    if a.sql:
        e.sql(a.sql).show(100, truncate=False)
    if a.search is not None:
        asked = {k: v for k in ("latitude", "longitude", "radius", "year", "month", "day", "direction") if (v := getattr(a, k)) is not None}
        got = e.search(a.search, mode=a.mode, limit=a.limit or 10, **asked)
        print("nothing asked for") if got is None else got.show(a.limit or 10, truncate=80)
    if a.article:
        for row in e.get_markdown(a.article).collect():  # one article
            print(row.markdown)


if __name__ == "__main__":
    run(SparkSession.builder.appName("waymark").getOrCreate())

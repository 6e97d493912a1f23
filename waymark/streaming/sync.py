"""Streams: entity dumps and new sections into tables, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.operators import ingest, merge, semantic


def _versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished writes path/name=<number>."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])


def ingest_entities(spark: SparkSession, lines: str, out: str, checkpoint: str) -> StreamingQuery:
    """Dump files that arrive in `lines` become versions of the entities table: out/v=<batch>.

    Each batch merges with the newest version before it and writes a new one, so a batch that is repeated after a
    failure overwrites its own version and nothing else. If there should be a version and there is none, it raises.
    """
    schema = "id long, article_id long, title string, description string"

    def merge_batch(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        new = ingest.entities(ingest.parsed(ingest.relevant(ingest.records(batch))))
        before = [v for v in _versions(s, out, "v") if v < number]
        if number and not before:
            raise RuntimeError(f"{out} has no finished version before {number}")
        old = s.read.schema(schema).parquet(f"{out}/v={before[-1]}") if before else s.createDataFrame([], schema)
        merge.upsert_keep_title(old, new.select("id", "title", "description")).write.mode("overwrite").parquet(f"{out}/v={number}")

    return spark.readStream.text(lines).writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed_sections(spark: SparkSession, sections: str, schema: str, entities: DataFrame, out: str, checkpoint: str, embedder=None) -> StreamingQuery:
    """New section files get vectors: out/batch=<number>; sections that have one already are left out."""

    def embed_batch(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        before = [v for v in _versions(s, out, "batch") if v < number]
        done = s.read.schema("id long, embedding array<float>, batch int").parquet(out).where(F.col("batch") < number) if before else s.createDataFrame([], "id long, embedding array<float>")
        todo = semantic.pending(batch, done)
        semantic.embed(semantic.embedding_input(todo, entities), embedder).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(sections).writeStream.foreachBatch(embed_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and values by event type in tumbling windows; rows later than the watermark are left out. Serves
    streams and tables alike (an addition of ours)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")

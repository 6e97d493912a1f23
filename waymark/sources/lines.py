"""Text lines, archives of line-JSON articles, compressed tables."""

from __future__ import annotations

import bz2
import gzip
import tarfile
import tempfile
import urllib.request
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources import ranges


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value; .gz and .bz2 by their extension (bzip2 files are split). A http(s) URL is streamed by one task."""
    return url_lines(spark, path) if path.startswith(("http://", "https://")) else spark.read.text(path)


def _groups(texts, most: int = 1000):
    """Data frames of at most so many values."""
    held = []
    for t in texts:
        held.append(t)
        if len(held) == most:
            yield pd.DataFrame({"value": held})
            held = []
    if held:
        yield pd.DataFrame({"value": held})


def url_lines(spark: SparkSession, url: str) -> DataFrame:
    """value: the lines of what a URL holds, decompressed as they arrive."""

    def run(batches):
        for pdf in batches:
            for u in pdf["url"]:
                with urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": "waymark"}), timeout=60) as r:
                    end = u.split("?")[0].lower()
                    f = gzip.GzipFile(fileobj=r) if end.endswith(".gz") else bz2.BZ2File(r) if end.endswith(".bz2") else r
                    yield from _groups(x.decode("utf-8", "replace").rstrip("\r\n") for x in f)

    return spark.createDataFrame([(url,)], "url string").mapInPandas(run, "value string")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of all members of tar or tar.gz archives, one task an archive, read as a stream; a http(s) URL
    serves as well."""
    url = path.startswith(("http://", "https://"))
    source = spark.createDataFrame([(path,)], "path string") if url else ranges.table(spark, path).select("path")

    def run(batches):
        for pdf in batches:
            for p in pdf["path"]:
                with urllib.request.urlopen(p, timeout=60) if url else ranges.stream(p) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for member in tar:
                        if member.isfile():
                            yield from _groups(t for line in tar.extractfile(member) if (t := line.decode("utf-8", "replace").strip()))

    return source.mapInPandas(run, "value string")


def compress(df: DataFrame, path: str) -> None:
    """A read-only copy: Parquet with zstd, whose pages can be read one by one."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def decompress(spark: SparkSession, path: str, to: str) -> None:
    spark.read.parquet(path).write.mode("overwrite").option("compression", "uncompressed").parquet(to)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A table, or an empty one where it doesn't exist."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


def slice_blob(rows: DataFrame, column: str, offset: int, length: int) -> DataFrame:
    return rows.withColumn(column, F.substring(column, offset + 1, length))


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_scratch: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A folder for stored indexes that goes when the driver ends: in spark.checkpoint.dir, which all executors share,
    or a local one in local mode."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _scratch[app] = f"{(base or 'file://' + tempfile.gettempdir()).rstrip('/')}/waymark-{app}-{uuid.uuid4().hex[:8]}"
        p, store = _path(spark, _scratch[app])
        store.mkdirs(p)
        store.deleteOnExit(p)
    return _scratch[app]


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, worked out once and stored until the driver ends."""
    spark = rows.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def folder_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A finished Parquet folder, or an empty table where there is none."""
    p, store = _path(spark, f"{path}/_SUCCESS")
    return spark.read.schema(schema).parquet(path) if store.exists(p) else spark.createDataFrame([], schema)


def removed(spark: SparkSession, path: str) -> None:
    p, store = _path(spark, path)
    store.delete(p, True)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Put a finished folder in the place of another."""
    (new, store), (old, _) = _path(spark, path), _path(spark, to)
    store.delete(old, True)
    if not store.rename(new, old):
        raise OSError(f"cannot rename {path}")

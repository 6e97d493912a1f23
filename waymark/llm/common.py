"""Session helpers shared by the operators: reading tables, shared scratch tables, text columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.batches import bound_batches

ROOT = Path(__file__).resolve().parents[2]
_own: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # a task has one core: more threads would only wait on each other
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the package to the executors where neither their working folder nor PYTHONPATH has it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == str(ROOT) for p in known):
        return
    folder = tempfile.mkdtemp(prefix="waymark-src-")  # on the driver only; Spark's file server hands it out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/waymark.zip", "w") as z:
        for p in (ROOT / "waymark").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(f"{folder}/waymark.zip")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only in local mode without it."""
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def materialize(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors.

    What a returned DataFrame still reads can't be dropped by its maker: it goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession) -> None:
    """Have the executors' JVMs collect their garbage, which also gives unused heap back to the system.

    A heap that has grown otherwise stays as large as it was at its largest, beside the Python workers of all
    later stages. One task a core; an executor without a free core is left out, which changes no result.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    for path in paths:
        p, fs = _file(spark, path)
        fs.delete(p, True)
        fs.cancelDeleteOnExit(p)


BROADCAST_ROWS = 500_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with ids (key columns of numbers, each key once) by left_semi or left_anti.

    The ids are broadcast only if they are few (some 20 MB as a hash table, 40 with two columns), else both
    sides are shuffled.
    """
    ids, _ = materialize(ids, "ids")
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), ids.columns, how)


def spread_join(rows: DataFrame, values: DataFrame, key: str, total: int | None = None, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with values: one row a key, its column `size` being how many rows the key has.

    Keys with more rows than a quarter of a partition's share can't be more than four a partition, whatever the
    input, so theirs are broadcast and no task meets all rows of a hot key; null keys aren't shuffled at all.
    total: the sum of the sizes, where known.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = values.agg(F.sum("size")).first()[0] or 0
    limit = total // (4 * parts) + 1
    hot, cold = values.where(F.col("size") > limit).drop("size"), values.where(F.col("size") <= limit).drop("size")
    rest = [c for c in hot.columns if c != key]
    order = [*rows.columns, *rest]
    out = rows.join(F.broadcast(hot), key).select(order)
    out = out.union(rows.where(F.col(key).isNotNull()).join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how).select(order))
    if how == "inner":
        return out
    return out.union(rows.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(values.schema[c].dataType).alias(c) for c in rest)))


def bucket(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the contracts' folds."""
    return F.crc32(col.cast("string").cast("binary")) % n


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """Only doc_id (long), the text (null: empty) and the named columns; other columns are never looked at."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def trim() -> None:
    """Give freed memory back to the system: workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into runs of whole rows of at most `most` text bytes (a longer row stands alone)."""
    for batch in batches:
        _, off = buffers(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            part = batch.slice(i, min(j, n) - i)
            yield part, *buffers(part.column(column))
            i = min(j, n)
    trim()


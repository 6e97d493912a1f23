"""How rows come to tasks and to Python workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of about 4 MB at most, unless the session has a bound of its own: rows with long texts
    otherwise come in batches of 64 MB, held several times over by the JVM and by each Python worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt out to all cores: small rows that make much work can come from one file, in one task. Counted as they
    pass, since Spark moves filters, and what they need, before a mere repartition."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(n).observe("dealt", F.count(F.lit(1)).alias("rows"))

"""Tables stored in hash buckets of a key, each sorted by it, so that joins and groupings on the key need no exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET = 2_000_000
MOST_BUCKETS = 100_000  # what Spark accepts at most by default


def bucket_count(rows: int, spark: SparkSession, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for a table of so many rows: full ones for a large table, one for each core's share of a small one."""
    return min(MOST_BUCKETS, max(-(-rows // rows_per_bucket), min(spark.sparkContext.defaultParallelism, 1 + rows // 10_000)))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` as table ``name`` at ``path``, one file to a bucket, and hand back the stored table.

    Two tables with equal keys and bucket counts join without an exchange. A key that owns much of the rows fills its
    bucket: meant for keys of bounded groups, as orders and their items are.
    """
    spaced = df.repartition(buckets, key)  # by the hash that deals buckets, so a task writes the files of its own only
    spaced.write.bucketBy(buckets, key).sortBy(key).option("path", path).option("compression", "zstd").format("parquet").mode(
        "overwrite").saveAsTable(name)
    return df.sparkSession.table(name)

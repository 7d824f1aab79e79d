"""Reading raw tables; writing, publishing and listing results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.sources.layouts import read_layouts
from stallkeeper.sources.schemas import raw_schema, score_schema

RENAMED = {"customers": {"customer_external_id": "cust_ext_id"}}


def bronze(spark: SparkSession, path: str, entity: str, declared: bool = True) -> DataFrame:
    """Raw Parquet rows of one entity with load time and source name.

    With ``declared`` files of any layout may lie side by side: they are cast to the declared types, renamed columns are
    taken under either name, and columns a file lacks are NULL. Without, all files must agree and are read as they are.
    """
    if declared:
        rows = read_layouts(spark, path, raw_schema(entity), RENAMED.get(entity))
    else:
        rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.withColumns({"_loaded_at": F.current_timestamp(), "_source": F.lit(entity)})


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def publish(reports: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Store every report under its name and hand the stored frames back."""
    stored = {}
    for name, df in reports.items():
        write_table(df, f"{path}/{name}")
        stored[name] = df.sparkSession.read.parquet(f"{path}/{name}")
    return stored


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
             for n, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def describe_schema(df: DataFrame) -> DataFrame:
    """Column names, types and filled cells, with the filled cells counted in one pass."""
    lines = F.array(*[
        F.struct(
            F.lit(i + 1).cast("bigint").alias("position"), F.lit(name).alias("column_name"),
            F.lit(kind).alias("column_type"), F.col(f"n{i}").alias("filled_rows"), F.col("n").alias("total_rows"),
        )
        for i, (name, kind) in enumerate(df.dtypes)
    ])
    counts = [F.count(c).alias(f"n{i}") for i, c in enumerate(df.columns)]
    return df.agg(F.count("*").alias("n"), *counts).select(F.inline(lines))


def conform_scores(df: DataFrame) -> DataFrame:
    """Score rows cast to the declared contract."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in score_schema()])

"""Duplicate handling: only what is repeated is sorted, and a key that owns a third of the rows never meets in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(
    df: DataFrame,
    key: str | Sequence[str],
    order_by: str,
    tie_break: str,
    keep: str = "last",
    drop_null_key: bool = False,
) -> DataFrame:
    """One row per key: the first or last by ``order_by`` (rows without it come last), then ``tie_break``.

    Rows per key are counted over the keys alone. Rows of a key that occurs once are the result as they are; only those of
    repeated keys are put in order, and each task hands on the best that it has of a key, so a hot key does not meet
    anywhere. Rows without a key share one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first' or 'last'")
    if drop_null_key:
        df = df.dropna(subset=keys)
    repeated = duplicate_keys(df, keys).select(*[F.col(k).alias(f"_{k}") for k in keys]).hint("shuffle_hash")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    order = [F.col(order_by).asc_nulls_last(), F.col(tie_break).asc()] if keep == "first" else [
        F.col(order_by).desc_nulls_last(), F.col(tie_break).desc()]
    ranked = df.join(repeated, same, "left_semi").withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return df.join(repeated, same, "left_anti").unionAll(ranked.where("_place = 1").drop("_place"))


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    rows = df.groupBy(key).count()
    return rows.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
        F.count(key).alias("unique_ids"),
        (F.coalesce(F.sum("count"), F.lit(0)) - F.count(key)).alias("duplicate_count"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty means the keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where(F.col("occurrences") > 1)


def near_duplicates(
    df: DataFrame, id_col: str, match_on: Sequence[str], ts_col: str, seconds: int
) -> DataFrame:
    """Rows that follow a row with equal ``match_on`` values within ``seconds``.

    Time is cut into slots of ``seconds``; the earliest and latest moment per slot is kept by
    aggregation, so a row only looks at its own and the previous slot and no pairs are formed.
    """
    slot = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / F.lit(seconds * 1_000_000))
    base = df.withColumn("_slot", slot).withColumn("_ord", F.struct(ts_col, id_col))
    slots = base.groupBy(*match_on, "_slot").agg(F.min("_ord").alias("_first"), F.max("_ord").alias("_last"))
    own = slots.select(*match_on, "_slot", F.col("_first").alias("_own"))
    before = slots.select(*match_on, (F.col("_slot") + 1).alias("_slot"), F.col("_last").alias("_prev"))
    keys = [*match_on, "_slot"]
    joined = base.join(own, keys).join(before, keys, "left")
    gap = F.unix_micros(F.col(ts_col).cast("timestamp")) - F.unix_micros(F.col(f"_prev.{ts_col}").cast("timestamp"))
    repeat = (F.col("_ord") > F.col("_own")) | F.coalesce(gap <= seconds * 1_000_000, F.lit(False))
    return joined.where(repeat).select(*df.columns)

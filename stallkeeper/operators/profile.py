"""Profiles of raw tables: what is wrong before cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.functions import NULL_TOKENS, count_if, pct, ratio
from stallkeeper.operators.shares import share_of_total

# fixed values: what profiling calls a test record, wider than the cleaning rule
PROFILE_ID_PATTERN = "TEST%"
PROFILE_EMAIL_PATTERNS = ("%test@test%", "%@localhost%", "%asdf%")
PROFILE_NAMES = ("TEST USER", "test test", "ASDF ASDF", "QA Test", "DELETE ME", "xxxxx", "DO NOT USE")


def _cells(cols: Sequence[str]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))


def null_token_profile(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """How often each spelling of "no value" occurs per column, in one pass."""
    cells = df.select(_cells(cols)).where(F.col("value").isin(*tokens) | F.col("value").isNull())
    return cells.groupBy("column", "value").agg(F.count("*").alias("occurrences"))


def find_zombies(df: DataFrame, limit: int | None = 10, id_col: str = "customer_id") -> DataFrame:
    suspect = F.col(id_col).like(PROFILE_ID_PATTERN) | F.col("first_name").isin(*PROFILE_NAMES)
    for pattern in PROFILE_EMAIL_PATTERNS:
        suspect = suspect | F.col("email").like(pattern)
    found = df.where(suspect).select(id_col, "first_name", "last_name", "email")
    return found if limit is None else found.orderBy(id_col).limit(limit)


def fill_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Filled cells per column; a column that does not exist is listed as absent."""
    there = [c for c in cols if c in df.columns]
    counts = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in there])
    lines = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in there).alias("present"),
            F.col("total"),
            (F.col(c) if c in there else F.lit(None).cast("bigint")).alias("non_null"),
            (pct(F.col(c), F.col("total")) if c in there else F.lit(None).cast("double")).alias("fill_rate_pct"),
        )
        for c in cols
    ])
    return counts.select(F.inline(lines))


def _not_number(value: Column) -> Column:
    return ~value.rlike("^-?[0-9]")


def type_drift(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Type of each column and how many values do not start like a number."""
    kinds = dict(df.dtypes)
    counts = df.agg(*[count_if(_not_number(F.col(c).cast("string"))).alias(c) for c in cols])
    lines = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c).alias("drifted_values")) for c in cols
    ])
    return counts.select(F.inline(lines))


def type_drift_samples(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The first ``k`` values of each column that do not start like a number, with their row counts."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("sample")) for c in cols])
    drifted = df.select(F.inline(cells)).where(_not_number(F.col("sample"))).groupBy("column", "sample").agg(
        F.count("*").alias("occurrences")
    )
    place = F.row_number().over(Window.partitionBy("column").orderBy("sample"))
    return drifted.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def late_arrival_profile(df: DataFrame, delay_col: str = "_ingestion_delay_days") -> DataFrame:
    delay = F.col(delay_col)
    return df.where(delay > 0).agg(
        F.count("*").alias("total_late"),
        F.min(delay).alias("min_delay"),
        F.max(delay).alias("max_delay"),
        ratio(F.sum(delay), F.count(delay), 1).alias("avg_delay"),
    )


def negative_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[count_if(F.col(c).try_cast("double") < 0).alias(f"negative_{c}") for c in cols])


def orphan_prefix_profile(df: DataFrame, fk: str, prefix: str = "ORPHAN", k: int = 5) -> DataFrame:
    """The first ``k`` broken keys with their row counts and the number of broken rows overall."""
    broken = df.where(F.col(fk).startswith(prefix)).groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("rows"))
    total = broken.agg(F.sum("rows")).scalar()
    return broken.orderBy("key").limit(k).withColumn("broken_rows", total)


def rating_distribution(reviews: DataFrame) -> DataFrame:
    grouped = reviews.groupBy("rating").agg(F.count("*").alias("cnt"))
    return share_of_total(grouped, "cnt", "pct")

"""Shares, growth and distributed ranks over aggregated or row-level frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallkeeper.functions import pct


def share_of_total(
    df: DataFrame, value: str, out: str, partition: Sequence[str] = (), digits: int = 1
) -> DataFrame:
    """Percent of the total (or of the partition total). For frames that are already grouped to a few
    business keys such as region, segment or tier; the window sees one row per key."""
    total = F.sum(value).over(W.partitionBy(*partition))
    return df.withColumn(out, pct(F.col(value), total, digits))


def growth(df: DataFrame, time: str, value: str, lag: int = 1) -> Column:
    """Percent change against the row ``lag`` steps earlier. For a frame with one row per period."""
    before = F.lag(value, lag).over(W.orderBy(F.col(time).asc_nulls_last()))
    return pct(F.col(value) - before, before, 1)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)

"""Conditional aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sum_if(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0)))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def distinct_if(value: Column, condition: Column) -> Column:
    """Exact distinct count under a condition. Use once per group-by; see ``operators.marts`` for more."""
    return F.count_distinct(F.when(condition, value))


def avg_if(value: Column, condition: Column) -> Column:
    return F.avg(F.when(condition, value))

"""Money and rounding.

Amounts are held as BIGINT cents between the cleaned tables and the reports, so sums do not depend on
the order in which partitions arrive. ``rnd`` rounds the binary value half away from zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(value: Column | str, digits: int = 2) -> Column:
    value = _col(value)
    scale = F.lit(float(10**digits))
    units = (F.signum(value) * F.floor(F.abs(value) * scale + F.lit(0.5))).cast("bigint")
    return units / scale


def cents(value: Column | str) -> Column:
    value = _col(value).cast("double")
    return (F.signum(value) * F.floor(F.abs(value) * F.lit(100.0) + F.lit(0.5))).cast("bigint")


def dollars(value: Column | str) -> Column:
    return _col(value) / F.lit(100.0)


def div_half_up(value: Column, divisor: int) -> Column:
    """Integer division rounded half up, for non-negative values."""
    return F.floor((value + F.lit(divisor // 2)) / F.lit(divisor)).cast("bigint")


def ratio(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return rnd(_col(part) / F.nullif(_col(whole), F.lit(0)), digits)


def pct(part: Column | str, whole: Column | str, digits: int = 1) -> Column:
    return rnd(F.lit(100.0) * _col(part) / F.nullif(_col(whole), F.lit(0)), digits)


def mean_dollars(total_cents: Column, n: Column, digits: int = 2) -> Column:
    return rnd(total_cents / F.nullif(n, F.lit(0)) / F.lit(100.0), digits)


def show_money(df: DataFrame, suffix: str = "_cents") -> DataFrame:
    """Replace every ``x_cents`` column by ``x`` in currency units, in place."""
    return df.select(
        *[
            dollars(c).alias(c[: -len(suffix)]) if c.endswith(suffix) else F.col(c)
            for c in df.columns
        ]
    )

"""Threshold ladders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ladder(value: Column, bounds: Sequence[float], labels: Sequence[str], inclusive: bool = True) -> Column:
    """Label of the first bound that ``value`` does not exceed; the last label is the rest."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("ladder needs one more label than bounds")
    out = F.lit(labels[-1])
    for bound, label in reversed(list(zip(bounds, labels))):
        hit = value <= F.lit(bound) if inclusive else value < F.lit(bound)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def recency_band(days: Column, bounds: Sequence[int], labels: Sequence[str], null_label: str) -> Column:
    return F.when(days.isNull(), F.lit(null_label)).otherwise(ladder(days, bounds, labels))

"""Cleaning steps between the raw and the silver tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import NULL_TOKENS, blank_to_col, clean_numeric, null_token_col

# fixed values: marks of test records and of broken foreign keys
ZOMBIE_ID_PREFIX = "TEST-"
ZOMBIE_EMAILS = ("%@localhost%", "%test@test%", "%asdf@asdf%")
ORPHAN_PREFIX = "ORPHAN-"


def standardize_nulls(df: DataFrame, cols: Iterable[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    return df.withColumns({c: null_token_col(F.col(c), tokens) for c in cols})


def clean_numbers(df: DataFrame, cols: Iterable[str], strict_prefix_order: bool = False) -> DataFrame:
    return df.withColumns({c: clean_numeric(F.col(c), strict_prefix_order) for c in cols})


def remove_zombies(
    df: DataFrame,
    id_col: str = "customer_id",
    email_col: str = "email",
    id_prefix: str = ZOMBIE_ID_PREFIX,
    patterns: Sequence[str] = ZOMBIE_EMAILS,
) -> DataFrame:
    """Drop test records. As with NOT LIKE, a row without an id or an email drops out too."""
    keep = ~F.col(id_col).startswith(id_prefix)
    for pattern in patterns:
        keep = keep & ~F.col(email_col).like(pattern)
    return df.where(keep)


def remove_orphan_ids(df: DataFrame, fk: str, prefix: str = ORPHAN_PREFIX) -> DataFrame:
    return df.where(~F.col(fk).startswith(prefix))


def conform_schema(
    df: DataFrame,
    renames: Mapping[str, str] | None = None,
    added: Mapping[str, object] | Iterable[str] = (),
) -> DataFrame:
    """Undo column renames and make sure late-added columns exist; of an old and a new column the new value counts."""
    for old, new in (renames or {}).items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    defaults = dict(added) if isinstance(added, Mapping) else {c: None for c in added}
    missing = {
        c: (F.lit(None).cast("string") if value is None else F.lit(value))
        for c, value in defaults.items()
        if c not in df.columns
    }
    return df.withColumns(missing) if missing else df


def null_negative(df: DataFrame, col: str, flag: str) -> DataFrame:
    negative = F.coalesce(F.col(col) < 0, F.lit(False))
    return df.withColumns({flag: negative, col: F.when(~negative, F.col(col))})


def flag_late_arrivals(
    df: DataFrame, delay_col: str = "_ingestion_delay_days", out: str = "ingestion_delay_days"
) -> DataFrame:
    late = F.coalesce(F.col(delay_col) > 0, F.lit(False))
    return df.withColumns({out: F.coalesce(delay_col, F.lit(0)), "is_late_arrival": late}).drop(delay_col)


def flag_business_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    return df.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})


def blank_to(df: DataFrame, cols: Iterable[str], default: str = "missing") -> DataFrame:
    return df.withColumns({c: blank_to_col(F.col(c), default) for c in cols})

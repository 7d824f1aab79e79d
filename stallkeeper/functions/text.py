"""Text columns: null tokens, drifted numbers, labels, repeatable hash buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: spellings of "no value" found in the sources
NULL_TOKENS = ("N/A", "", "NULL", "null", "None", "-", "n/a", "NA", " ", "  ")

PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def null_token_col(col: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~col.isin(*tokens), col)


def clean_numeric(col: Column, strict_prefix_order: bool = False) -> Column:
    """Number out of a drifted string.

    A comma next to a period groups thousands, a lone comma is the decimal mark. In the default mode the
    dollar sign goes before ``R$``, which leaves ``R12.5`` unreadable (NULL); ``strict_prefix_order``
    takes the longer prefix first and reads it.
    """
    prefixes = ["R$", "$", "€", "USD "] if strict_prefix_order else ["$", "€", "R$", "USD "]
    bare = F.trim(col)
    for prefix in prefixes:
        bare = F.replace(bare, F.lit(prefix), F.lit(""))
    mark = F.when(F.contains(col, F.lit(".")), F.lit("")).otherwise(F.lit("."))
    number = F.trim(F.replace(bare, F.lit(","), mark))
    return F.when(number.rlike(PLAIN_NUMBER), number.try_cast("double"))


def blank_to_col(col: Column, default: str = "missing") -> Column:
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(default))


def normalize_risk_label(col: Column) -> Column:
    words = F.replace(F.lower(F.trim(col)), F.lit("_"), F.lit(" "))
    return (
        F.when(words == "high risk", F.lit("high"))
        .when(words == "medium risk", F.lit("medium"))
        .when(words == "low risk", F.lit("low"))
        .otherwise(words)
    )


def hash_bucket(salt: str, key: Column) -> Column:
    """28-bit number from md5, the same on every engine; basis for repeatable row choice."""
    digest = F.md5(F.concat(F.lit(salt + "|"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")

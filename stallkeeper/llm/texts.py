"""Column expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def text_of(column: str) -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def one_space(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, rf"[\x09-\x0D][{SPACE}]*|\x20[{SPACE}]+", " ")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def id_key(column: str) -> Column:
    """A join key that is never null: the id as text behind a mark, or the mark of a null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("-"))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, however often lambdas inside ``body`` read it."""
    return F.transform(F.array(value), body)[0]

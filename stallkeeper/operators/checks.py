"""Declarative data checks: a check is a query for violating rows.

Row checks of one table share a single scan; its uniqueness checks and references share one shuffle of counted values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    table: str
    kind: str
    column: str
    values: tuple = ()
    to: tuple[str, str] | None = None
    severity: str = "error"

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.table}_{self.column}"


def check_not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNull())


def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Values that occur more than once."""
    rows = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("occurrences"))
    return rows.where(F.col("occurrences") > 1)


def check_accepted(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Values outside the list, with their row counts; NULL is left to ``not_null``."""
    return df.where(~F.col(col).isin(list(values))).groupBy(col).agg(F.count("*").alias("occurrences"))


def check_fk(df: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    keys = parent.select(F.col(parent_col).alias("_pk")).where("_pk is not null")
    return df.where(F.col(col).isNotNull()).join(keys, F.col(col) == F.col("_pk"), "left_anti")


def _row_rule(c: Check) -> Column | None:
    if c.kind == "not_null":
        return F.col(c.column).isNull()
    if c.kind == "accepted":
        return ~F.col(c.column).isin(list(c.values))
    return None


def _result(c: Check, n: Column) -> Column:
    status = F.when(n == 0, "pass").otherwise(F.lit("warn" if c.severity == "warn" else "error"))
    return F.struct(
        F.lit(c.name).alias("check_name"),
        F.lit(c.table).alias("table_name"),
        F.lit(c.severity).alias("severity"),
        n.alias("violations"),
        status.alias("status"),
    )


def _by_value(df: DataFrame, unique: Sequence[str], refer: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """``u0, u1, ...``: how many values of a column occur more than once; ``r0, r1, ...``: how many rows refer to a parent
    that is not there. One scan of the table, one of each parent's key, and one shuffle of counted values."""
    def cell(i: int, column: str, refers: bool):
        return F.struct(F.lit(i).alias("i"), F.lit(refers).alias("refers"), F.col(column).cast("string").alias("v"))

    cells = [cell(i, c, False) for i, c in enumerate(unique)] + [cell(i, c, True) for i, (c, _, _) in enumerate(refer)]
    values = df.select(F.inline(F.array(*cells)), F.lit(1).alias("n"), F.lit(0).alias("there"))
    for i, (_, parent, key) in enumerate(refer):
        values = values.unionAll(parent.select(F.lit(i), F.lit(True), F.col(key).cast("string"), F.lit(0), F.lit(1)))
    counted = values.where("v IS NOT NULL").groupBy("i", "refers", "v").agg(F.sum("n").alias("n"), F.max("there").alias("there"))
    at = lambda i, refers: (F.col("i") == i) & (F.col("refers") == refers)
    zero = F.lit(0).cast("bigint")
    return counted.where("IF(refers, there = 0, n > 1)").agg(
        *[F.count_if(at(i, False)).alias(f"u{i}") for i in range(len(unique))],
        *[F.coalesce(F.sum(F.when(at(i, True), F.col("n"))), zero).alias(f"r{i}") for i in range(len(refer))])


def run_checks(
    tables: Mapping[str, DataFrame], suite: Sequence[Check], queries: Mapping[Check, DataFrame] | None = None
) -> DataFrame:
    """One result row per check. ``queries`` adds checks whose violating rows are given directly.

    ``violations`` counts rows, and distinct repeated values for uniqueness.
    """
    parts = []
    for table in dict.fromkeys(c.table for c in suite):
        mine = [c for c in suite if c.table == table]
        by_row = [(c, rule) for c in mine if (rule := _row_rule(c)) is not None]
        if by_row:
            counts = tables[table].agg(*[F.count_if(rule).alias(f"n{i}") for i, (_, rule) in enumerate(by_row)])
            lines = F.array(*[_result(c, F.col(f"n{i}")) for i, (c, _) in enumerate(by_row)])
            parts.append(counts.select(F.inline(lines)))
        unique = [c for c in mine if c.kind == "unique"]
        refer = [c for c in mine if c.kind == "relationship"]
        if unique or refer:
            counts = _by_value(tables[table], [c.column for c in unique], [(c.column, tables[c.to[0]], c.to[1]) for c in refer])
            lines = [_result(c, F.col(f"u{i}")) for i, c in enumerate(unique)] + [_result(c, F.col(f"r{i}")) for i, c in enumerate(refer)]
            parts.append(counts.select(F.inline(F.array(*lines))))
    for c, bad in (queries or {}).items():
        parts.append(bad.agg(F.count("*").alias("n")).select(F.inline(F.array(_result(c, F.col("n"))))))
    return reduce(DataFrame.unionByName, parts)


def check_summary(results: DataFrame) -> DataFrame:
    """Checks per status."""
    return results.groupBy("status").agg(F.count("*").alias("checks"))

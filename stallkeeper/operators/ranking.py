"""Global order over large frames without a single-task window.

Rows are cut into ordered blocks of a bounded number of rows. First the value range is cut at approximate quantiles, as
many as the row count asks for; a value that takes up several of them gets a range of its own; ranges that still hold too
many rows are cut again. What is left above the bound holds one value, and is cut by as many leading digits of the row id's
md5 as its size asks for. Borders are literals and digits a small table in the plan, so a block is a pure function of the
row and recomputation after a lost executor gives the same block. Block totals, a few for every bound's worth of rows,
carry the prefix sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallkeeper.session import cut_lineage

MOST_ROWS = 1_000_000  # of a block
ROUNDS = 60


def _cut(df: DataFrame, value: str, borders: Sequence[float]) -> DataFrame:
    """Adds ``_b``, the number of the range that a row's value is in; rows without a value are left out."""
    if not borders:
        return df.where(F.col(value).isNotNull()).withColumn("_b", F.lit(0.0))
    splits = [float("-inf"), *borders, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_b", handleInvalid="skip").transform(df)


def _quantiles(df: DataFrame, value: str, rows: int, most: int) -> set[float]:
    """Borders that leave about half of ``most`` rows between them; a value met twice is shut in between two borders."""
    parts = math.ceil(2 * rows / most)
    found = df.approxQuantile(value, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return set(found) | {math.nextafter(a, math.inf) for a, b in zip(found, found[1:]) if a == b}


def _ranges(df: DataFrame, value: str, most: int) -> tuple[list[float], dict[float, int]]:
    """Borders of the ranges, and the sizes of ranges that one value fills beyond ``most`` rows."""
    borders: set[float] = set()
    over = [(None, df.where(F.col(value).isNotNull()).count())]
    over = [x for x in over if x[1] > most]
    alone: dict[float, int] = {}
    for _ in range(ROUNDS):
        if not over:
            break
        cut = _cut(df, value, sorted(borders))
        for number, rows in over:
            part = cut if number is None else cut.where(F.col("_b") == number)
            new = _quantiles(part, value, rows, most)
            if new <= borders:  # an approximate quantile that does not cut: the middle one does, or the value after it
                middle = part.approxQuantile(value, [0.5], 0.0)[0]
                new = {middle, math.nextafter(middle, math.inf)}
            borders |= new
        borders = {b for b in borders if math.isfinite(b)}
        sizes = _cut(df, value, sorted(borders)).groupBy("_b").agg(
            F.count("*").alias("n"), (F.min(value) == F.max(value)).alias("one")).where(F.col("n") > most).collect()
        alone = {r["_b"]: r["n"] for r in sizes if r["one"]}
        over = [(r["_b"], r["n"]) for r in sizes if not r["one"]]
    return sorted(borders), alone


def ordered_blocks(df: DataFrame, value: str, digest: str, most: int = MOST_ROWS) -> DataFrame:
    """Adds ``_b`` and ``_t``, which order the blocks; ``digest`` is a column of hex digits that are evenly spread.

    Rows of a later block have larger values, or the same value and a larger digest.
    """
    borders, alone = _ranges(df, value, most)
    cut = _cut(df, value, borders)
    if not alone:
        return cut.withColumn("_t", F.lit(""))
    digits = [(b, math.ceil(math.log(2 * n / most, 16))) for b, n in alone.items()]  # at most one for each bound's worth of rows
    table = df.sparkSession.createDataFrame(digits, "_b double, _digits int")
    return cut.join(F.broadcast(table), "_b", "left").withColumn(
        "_t", F.coalesce(F.col(digest).substr(F.lit(1), F.col("_digits")), F.lit(""))).drop("_digits")


def global_rank(
    df: DataFrame, value: str, id_col: str, out: str = "rank", descending: bool = True, most: int = MOST_ROWS,
    stored: bool = False,
) -> DataFrame:
    """Adds the 1-based position by ``value`` and the row count as ``{out}_n``.

    Equal values are ordered by md5 of the id, then the id. Rows whose value is NULL or NaN come back with a NULL
    rank and count; the count is that of the ranked rows. No task orders more than about ``most`` rows at a time.
    The frame is read several times, so it is stored first unless the caller says it already is.
    """
    if not stored:
        df = cut_lineage(df)
    number = F.col(value).cast("double")
    valid = number.isNotNull() & ~F.isnan(number)
    signed = df.where(valid).withColumn("_v", -number if descending else number)
    signed = signed.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    rows = ordered_blocks(signed, "_v", "_h", most)
    sizes = rows.groupBy("_b", "_t").agg(F.count("*").alias("_n"))
    # a few rows for every bound's worth of rows: fine for one task and for a broadcast
    order = W.orderBy("_b", "_t")
    whole = W.partitionBy()
    starts = sizes.select(
        "_b",
        "_t",
        (F.sum("_n").over(order) - F.col("_n")).alias("_start"),
        F.sum("_n").over(whole).alias(f"{out}_n"),
    )
    inside = F.row_number().over(W.partitionBy("_b", "_t").orderBy("_v", "_h", id_col))
    ranked = rows.withColumn("_i", inside.cast("bigint")).join(F.broadcast(starts), ["_b", "_t"])
    placed = ranked.withColumn(out, F.col("_start") + F.col("_i")).select(*df.columns, out, f"{out}_n")
    none = F.lit(None).cast("bigint")
    return placed.unionByName(df.where(~valid).withColumns({out: none, f"{out}_n": none}))


def running_sums(
    df: DataFrame,
    value: str,
    sums: Sequence[str],
    partition_by: Sequence[str] = (),
    descending: bool = False,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Adds ``run_<c>`` (sum up to and including this value) and ``all_<c>`` (partition total).

    Needs one row per (partition, value): group first, which also removes any hot value. The grouped
    frame is stored because it is read several times.
    """
    df = cut_lineage(df)
    keys = list(partition_by)
    signed = df.withColumn("_v", (-F.col(value) if descending else F.col(value)).cast("double"))
    borders, _ = _ranges(signed, "_v", most)
    rows = _cut(signed, "_v", borders)
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    # one row per partition and bucket
    before = W.partitionBy(*keys).orderBy("_b")
    starts = totals.select(
        *keys,
        "_b",
        *[(F.sum(f"_s_{c}").over(before) - F.col(f"_s_{c}")).alias(f"_start_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(W.partitionBy(*keys)).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_v")
    rows = rows.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums}).join(starts, [*keys, "_b"])
    run = {f"run_{c}": F.col(f"_start_{c}") + F.col(f"_in_{c}") for c in sums}
    return rows.withColumns(run).select(
        *df.columns, *[f"run_{c}" for c in sums], *[f"all_{c}" for c in sums]
    )


def exact_quantile(
    df: DataFrame, value: str, q: float, by: Sequence[str] = (), out: str = "quantile", most: int = MOST_ROWS
) -> DataFrame:
    """Exact interpolated quantile per group, without holding a group's values in one task."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    run = running_sums(counts, value, ["_n"], keys, most=most)
    place = F.lit(q) * (F.col("all__n") - 1)
    lower, upper = F.floor(place), F.ceil(place)
    # zero-based positions held by this value: [run - n, run)
    def at(position: Column) -> Column:
        held = (position >= F.col("run__n") - F.col("_n")) & (position < F.col("run__n"))
        return F.max(F.when(held, F.col(value).cast("double")))

    picked = run.groupBy(*keys).agg(
        at(lower).alias("_lo"), at(upper).alias("_hi"), F.max(place - lower).alias("_f")
    )
    return picked.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias(out))


def qcut_decile(rank: Column, n: Column, parts: int = 10) -> Column:
    """Part of an evenly cut rank scale, lower edges open: ceil((rank - 1) * parts / (n - 1)), at least 1; NULL without a rank."""
    step = F.ceil((rank - 1) * F.lit(float(parts)) / F.nullif(n - 1, F.lit(0)))
    return F.when(rank.isNotNull(), F.greatest(F.coalesce(step, F.lit(1)), F.lit(1)).cast("bigint"))


def pct_rank_decile(rank: Column, n: Column, parts: int = 10) -> Column:
    part = F.ceil(rank / n * F.lit(float(parts)))
    return F.when(rank.isNotNull(), F.least(F.greatest(part, F.lit(1)), F.lit(parts)).cast("bigint"))


def ntile(rank: Column, n: Column, parts: int) -> Column:
    """NTILE from a rank: the first ``n % parts`` parts hold one row more."""
    small, extra = F.floor(n / F.lit(parts)), n % parts
    head = extra * (small + 1)
    late = extra + F.floor((rank - 1 - head) / F.nullif(small, F.lit(0))) + 1
    early = F.floor((rank - 1) / (small + 1)) + 1
    return F.when(rank <= head, early).otherwise(late).cast("bigint")

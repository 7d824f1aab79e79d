"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. A source's budget is met by taking its documents below a hash
threshold: sizes are summed by source and hash bucket, the running sums over the buckets find the boundary bucket, and
only the rows of that bucket are summed again by the next bits, until the bucket holds a single hash. A boundary document
that does not fit is passed over and a nested threshold above it, for documents no larger than what is left, fills the
budget further. The sample is then a filter on (source, hash, size): nothing is sorted, reruns agree, and the sums are
combined before the shuffle, so a source may hold any share of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.texts import text_of, words_of
from stallkeeper.session import cut_lineage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS = 60
LEVEL_BITS = 10
PASSES = 3


def _sized(id_column: str, text_column: str, source_column: str) -> list[Column]:
    """Id, source, number of words and hash of a row."""
    text = text_of(text_column)
    mark = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("\n"), text))
    return [
        F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"),
        F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    ]


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, target``: the total shared out by weight, no target above max_repeat times its source.

    A source is full when its share of what the fuller sources leave is still above its limit; in order of limit to
    weight that is one running sum. The table has one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    weighed = sums.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn).alias("weight"))
    top = F.col("source_size") * max_repeat
    filled = Window.orderBy(top / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum(top).over(before), F.lit(0))
    weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighed.select("*", top.alias("top"), (rest / weight).alias("level"))
    open_ = F.col("top") >= F.col("weight") * F.col("level")
    water = F.max(F.when(open_, F.col("level"))).over(Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing))
    return shared.select(
        "source", "source_size",
        F.when(open_, F.col("weight") * water).otherwise(F.col("top")).cast("double").alias("target"),
    )


def _threshold(rows: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """``src, below, at, rest`` per row of ``budgets`` (src, lower, most, budget): the hash below which rows fit.

    ``at`` is the boundary hash (null if all rows fit), ``rest`` what is left of the budget. ``nearest`` also takes the
    boundary hash if that comes nearer to the budget.
    """
    found, state = [], budgets.select("src", "lower", "most", "budget", F.lit(0).cast("long").alias("prefix"))
    for used in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - used
        inside = rows.join(state, F.col("source").eqNullSafe(F.col("src"))).where(
            (F.col("h") >= F.col("lower")) & (F.col("size") <= F.col("most"))
            & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        )
        sums = inside.groupBy("src", "lower", "most", "budget", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("sum"), F.min("h").alias("first"), F.max("h").alias("last"))
        upto = Window.partitionBy("src").orderBy("bucket")
        over = cut_lineage(
            sums.withColumn("cum", F.sum("sum").over(upto)).where("cum > budget")
            .withColumn("nth", F.row_number().over(upto)).where("nth = 1")
            .withColumn("rest", F.col("budget") - F.col("cum") + F.col("sum"))
        )
        take = F.col("sum") - F.col("rest") < F.col("rest") if nearest else F.lit(False)
        found.append(over.where("first = last").select(
            "src", (F.col("first") + F.when(take, 1).otherwise(0)).alias("below"), F.col("first").alias("at"), "rest"))
        state = over.where("first < last").select(
            "src", "lower", "most", F.col("rest").alias("budget"), F.col("bucket").alias("prefix"))
        if state.isEmpty():
            break
    return reduce(DataFrame.union, found)


def _plan(rows: DataFrame, weights: tuple, max_repeat: int, passes: int) -> DataFrame:
    """``of, source_size, target, times, bars`` of every source: whole copies, and the thresholds for the rest."""
    goal = cut_lineage(source_targets(rows, weights, max_repeat))
    times = F.when(F.col("target") >= F.col("source_size") * max_repeat, F.lit(max_repeat)).otherwise(
        F.floor(F.col("target") / F.col("source_size"))).cast("long")
    budgets = goal.where("source_size > 0").withColumn("times", times).select(
        F.col("source").alias("src"), F.lit(0).cast("long").alias("lower"), F.lit(2**62).cast("long").alias("most"),
        F.when(F.col("times") == max_repeat, F.lit(0.0)).otherwise(
            F.col("target") - F.col("times") * F.col("source_size")).alias("budget")).where("budget > 0")
    bars, words = [], rows.where("size > 0")
    for k in range(passes):
        cut = _threshold(words, budgets, nearest=k == passes - 1)
        bars.append(budgets.join(cut.withColumnRenamed("src", "s"), F.col("src").eqNullSafe(F.col("s")), "left").select(
            "src", "lower", "most", F.coalesce("below", F.lit(2**62).cast("long")).alias("below")))
        budgets = cut.select("src", (F.col("at") + 1).alias("lower"), F.floor("rest").cast("long").alias("most"),
                             F.col("rest").alias("budget")).where("most > 0")
    bar = reduce(DataFrame.union, bars).groupBy("src").agg(F.collect_list(F.struct("lower", "most", "below")).alias("bars"))
    return cut_lineage(goal.join(cut_lineage(bar), F.col("source").eqNullSafe(F.col("src")), "left").select(
        F.col("source").alias("of"), "source_size", "target", times.alias("times"), "bars"))


def _copies() -> Column:
    fits = F.exists("bars", lambda b: (F.col("h") >= b["lower"]) & (F.col("size") <= b["most"]) & (F.col("h") < b["below"]))
    return F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("times") + F.when(fits, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, passes: int = PASSES) -> DataFrame:
    """``id, source, size, source_size, target, taken`` of every row; a document is taken whole, taken / size times.

    A source is taken whole as often as its target holds it, and the rest by threshold. Null texts have size 0 and are
    not taken. Null sources are one source, the last. Repeated rows have one hash and go in or out together. A table
    without words has targets 0; an empty table gives an empty result. Other columns are not read.
    """
    rows = cut_lineage(docs.select(*_sized(id_column, text_column, source_column)))
    return rows.join(_plan(rows, weights, max_repeat, passes), F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mix_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                  weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT, passes: int = PASSES) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, as often as it is taken."""
    marks = _sized(id_column, text_column, source_column)
    plan = _plan(cut_lineage(docs.select(*marks)), weights, max_repeat, passes)
    names = [f"row_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*marks, *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)])
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(*names, _copies().alias("copies")).where("copies > 0")
    return taken.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(
        *[F.col(a).alias(c) for c, a in zip(docs.columns, names)])

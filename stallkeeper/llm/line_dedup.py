"""Repeated line runs: the suffix array of the lines of all documents by distributed prefix doubling, and its common prefixes.

Every line that occurs more than once gets a rank in the order of its digest. Lines that occur once match nothing, so they cut
documents into stretches, and a suffix goes from a position to the end of its stretch. A rank is one more than the number of
suffixes that sort before: after k rounds suffixes share it that agree in their first 2^k lines. A round orders them by the rank
of the lines after those (0 where the stretch ends), until every suffix is alone or equal to its whole bucket. Ranks come from
a global sort, running sums in its parts and a small table of part totals, so no task meets a hot bucket.

The longest common prefix of neighbours in the array is put together from the largest blocks of 2^k lines down, by ranks of
the rounds. For each position the shortest run of lines with ``min_words`` words is looked for: where the prefix shared with
the neighbour before covers it, both lie in one interval. Of the positions in an interval the first stays, and the lines under
the others are deleted; overlapping ones add up to runs. Names are counted with map-side combination and
stored before they are joined, so a run that a third of all documents share is split over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.texts import id_key, let, one_space, text_of, words_of
from stallkeeper.session import cut_lineage, free_shuffles

MIN_WORDS = 50


def _keys(id_column: str, text_column: str):
    return id_key(id_column).alias("d"), F.xxhash64(text_of(text_column)).alias("t")


def _running(rows: DataFrame, by: Sequence[str], value: Column, total: Callable, add: Callable) -> DataFrame:
    """``rows`` with ``sofar``: ``total`` of ``value`` over all rows up to this one in the order of ``by``, which is unique.

    The sort deals rows to ordered parts; a part is run through by itself and ``add`` brings in what the parts before it hold.
    """
    parts = cut_lineage(rows.withColumn("_v", value).orderBy(*by).withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the sort has parts
    before = parts.groupBy("_part").agg(total("_v").alias("_of")).select("_part", total("_of").over(ahead).alias("_before"))
    inside = total("_v").over(Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    held = parts.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    return held.withColumn("sofar", add(F.col("_before"), F.col("_inside"))).drop("_v", "_part", "_inside", "_before")


def _ahead_of(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """``counted`` with ``ahead``: how many rows its groups (of ``size`` each) before this one hold, in the order of ``by``."""
    run = _running(counted, by, F.col("size"), F.sum, lambda before, inside: F.coalesce(before, F.lit(0)) + inside)
    return run.withColumn("ahead", F.col("sofar") - F.col("size")).drop("sofar")


def _split(rows: DataFrame) -> DataFrame:
    """``rows`` of buckets ``rank``, ordered in their bucket by ``next``: their new rank, and the ``size`` of its bucket."""
    named = cut_lineage(_ahead_of(rows.groupBy("rank", "next").agg(F.count("*").alias("size")), ["rank", "next"]))
    base = named.groupBy("rank").agg(F.min("ahead").alias("base"))
    names = named.join(base, "rank").select("rank", "next", (F.col("rank") + F.col("ahead") - F.col("base")).alias("new"), "size")
    return rows.drop("size").join(names, ["rank", "next"]).drop("rank", "next").withColumnRenamed("new", "rank")


def suffix_array(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``d, t, pos, left, first, rank`` of every position whose ``line`` occurs more than once, and the ranks of each round.

    ``left`` counts the lines from the position to the end of its stretch, ``first`` is the rank of its line alone and ``rank`` the place
    of its suffix in the array, from 1; equal suffixes share the first place that they take up. Round k has ``d, t, pos, rank`` by
    the first 2^k lines, of positions with as many lines in documents that were not yet in order.
    """
    named = lines.groupBy("line").agg(F.count("*").alias("size")).where("size > 1")
    names = cut_lineage(_ahead_of(named, ["line"]).select("line", (F.col("ahead") + 1).alias("rank"), "size"))
    by_doc, whole = Window.partitionBy("d", "t").orderBy("pos"), Window.partitionBy("d", "t")
    stretch = lines.select("d", "t", "pos", "line").join(names, ["line"]).withColumn("stretch", F.col("pos") - F.row_number().over(by_doc))
    left = F.max("pos").over(Window.partitionBy("d", "t", "stretch")) - F.col("pos") + 1
    rows = cut_lineage(stretch.withColumn("left", left).select(
        "d", "t", "pos", "left", F.col("rank").alias("first"), "rank", "size", F.lit(True).alias("open")))
    rounds, done, half = [], [], 1
    while not rows.where("open").isEmpty():
        rounds.append(rows.where(F.col("left") >= half).select("d", "t", "pos", "rank"))
        follows = F.when(F.col("left") > half, F.first("rank").over(by_doc.rangeBetween(half, half)))
        seen = cut_lineage(rows.select("*", F.coalesce(follows, F.lit(0)).alias("next"), F.max("open").over(whole).alias("alive")).where("alive").drop("alive"))
        still = (F.col("size") > 1) & (F.col("left") >= 2 * half)
        moved = cut_lineage(_split(seen.where("open")).withColumn("open", still))
        done.append(moved.where("NOT open").select("d", "t", "pos", "left", "first", "rank"))
        rows = moved.unionByName(seen.where("NOT open").drop("next"))
        half *= 2
    return reduce(DataFrame.union, done, rows.select("d", "t", "pos", "left", "first", "rank").limit(0)), rounds


def common_prefixes(suffixes: DataFrame, rounds: Sequence[DataFrame]) -> DataFrame:
    """``rank, size, left, lcp`` of every bucket of the array: ``lcp`` lines are shared with the bucket before, none by the first."""
    buckets = cut_lineage(suffixes.groupBy("rank").agg(
        F.count("*").alias("size"), F.min(F.struct("d", "t", "pos")).alias("at"), F.min("left").alias("left"), F.min("first").alias("first")))
    before = buckets.select((F.col("rank") + F.col("size")).alias("rank"), F.col("at").alias("was"), F.col("first").alias("first_was"))
    same = buckets.join(before, "rank").where("first = first_was").select("rank", "at", "was", F.lit(0).alias("lcp"))
    for k in reversed(range(len(rounds))):
        for side in ("at", "was"):
            found = rounds[k].select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("pos").alias("_pos"), F.col("rank").alias(f"{side}_rank"))
            here = (F.col(f"{side}.d") == F.col("_d")) & (F.col(f"{side}.t") == F.col("_t")) & (F.col(f"{side}.pos") + F.col("lcp") == F.col("_pos"))
            same = same.join(found, here, "left").drop("_d", "_t", "_pos")
        same = same.withColumn("lcp", F.col("lcp") + F.when(F.col("at_rank") == F.col("was_rank"), 2**k).otherwise(0)).drop("at_rank", "was_rank")
        if k % 4 == 0:
            same = cut_lineage(same)
    return buckets.join(same.select("rank", "lcp"), "rank", "left").select("rank", "size", "left", F.coalesce("lcp", F.lit(0)).alias("lcp"))


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``d, t, id, pos, line``: the lines of each document that hold a word, numbered in order."""
    rows = docs.select(*_keys(id_column, text_column), F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(one_space(x))), lambda x: x != "")
    return rows.select("d", "t", "id", F.posexplode(lines).alias("pos", "line"))


def _reach(min_words: int):
    """Lines in the shortest run of consecutive positions with min_words words, null if there is none."""
    ahead = F.collect_list(F.struct("pos", "words")).over(
        Window.partitionBy("d", "t").orderBy("pos").rowsBetween(0, min_words - 1))

    def length(run):
        return F.aggregate(
            run, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("n"), run[0]["pos"].alias("next")),
            lambda acc, x: F.when((acc["sum"] >= min_words) | (acc["next"] != x["pos"]), F.struct(
                acc["sum"].alias("sum"), acc["n"].alias("n"), acc["next"].alias("next"))).otherwise(F.struct(
                    (acc["sum"] + x["words"]).alias("sum"), (acc["n"] + 1).alias("n"), (acc["next"] + 1).alias("next"))),
            lambda acc: F.when(acc["sum"] >= min_words, acc["n"]))

    return let(ahead, length)


def deleted_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``d, t, pos, words`` of every line to delete; see ``repeated_runs``."""
    lines = _lines(docs, id_column, text_column)
    marked = lines.select("d", "t", "id", "pos", F.unhex(F.sha2("line", 256)).alias("line"), F.size(words_of(F.col("line"))).cast("long").alias("words"))
    marked = cut_lineage(marked.distinct())
    suffixes, rounds = suffix_array(marked)
    suffixes = cut_lineage(suffixes)
    at = suffixes.join(marked.select("d", "t", "id", "pos", "words"), ["d", "t", "pos"])
    at = cut_lineage(at.select("d", "t", "id", "pos", "rank", _reach(min_words).alias("reach")).where("reach IS NOT NULL"))
    free_shuffles(docs.sparkSession)
    reaches = at.groupBy("rank").agg(F.min("reach").alias("reach"))  # equal suffixes have equal runs
    # neighbours that share a run of min_words words lie in one interval, named by the rank that it starts with
    starts = F.when(F.col("lcp") < F.col("reach"), F.col("rank"))
    intervals = _running(common_prefixes(suffixes, rounds).join(reaches, "rank"), ["rank"], starts, F.max, F.greatest).select(
        "rank", F.col("sofar").alias("interval"))
    runs = cut_lineage(at.join(cut_lineage(intervals), "rank").drop("rank"))
    first = runs.groupBy("interval").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "d", "t", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut_lineage(first.select("interval", *(F.col(f"first.{c}").alias(f"first_{c}") for c in ("d", "t", "pos"))))
    apart = (F.col("d") != F.col("first_d")) | (F.col("t") != F.col("first_t")) | (F.col("pos") >= F.col("first_pos") + F.col("reach"))
    copies = runs.join(first, ["interval"]).where(apart)
    gone = copies.select("d", "t", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("reach") - 1)).alias("pos")).distinct()
    return cut_lineage(gone.join(marked.select("d", "t", "pos", "words"), ["d", "t", "pos"]))


def repeated_runs(gone: DataFrame) -> DataFrame:
    """``d, t, start, lines, words`` of the maximal runs of deleted lines; start counts the lines that hold a word."""
    by_doc = Window.partitionBy("d", "t").orderBy("pos")
    return gone.withColumn("run", F.col("pos") - F.row_number().over(by_doc)).groupBy("d", "t", "run").agg(
        F.min("pos").alias("start"), F.count("*").alias("lines"), F.sum("words").alias("words")).drop("run")


def line_report(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id, n_lines, n_deleted_lines, n_deleted_words, n_runs``.

    Lines without a word don't count. Lines are equal when they agree after runs of white space become one space and the
    ends are trimmed. The first copy of a run, by id and then line, stays; copies that overlap it stay too. Null ids come
    last. Rows that repeat id and text are one document. Null and empty texts have no lines. Empty tables give an empty
    result; other columns are not read.
    """
    runs = repeated_runs(deleted_lines(docs, id_column, text_column, min_words)).groupBy("d", "t").agg(
        F.sum("lines").alias("lines"), F.sum("words").alias("words"), F.count("*").alias("runs"))
    lines = F.filter(F.split(text_of(text_column), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(F.col(id_column).alias("id"), *_keys(id_column, text_column), F.size(lines).cast("long").alias("n_lines"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.join(cut_lineage(runs), ["d", "t"], "left").select(
        "id", "n_lines", zero("lines").alias("n_deleted_lines"), zero("words").alias("n_deleted_words"), zero("runs").alias("n_runs"))


def drop_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs taken out of the texts; lines without a word stay."""
    gone = cut_lineage(deleted_lines(docs, id_column, text_column, min_words).groupBy("d", "t").agg(F.collect_list("pos").alias("gone")))
    names = [f"row_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_column)]
    rows = docs.select(*_keys(id_column, text_column), *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)])
    rows = rows.join(gone, ["d", "t"], "left")
    lines = F.split(F.col(text), "\n")

    def left(x):  # the places of lines with a word, without those of the deleted ones
        places = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i).rlike(r"[^\x20\x09-\x0D]"))
        drop = let(places, lambda p: F.transform(F.col("gone"), lambda k: F.get(p, k)))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), drop), lambda i: F.get(x, i)), "\n")

    cleaned = F.when(F.col("gone").isNull(), F.col(text)).otherwise(let(lines, left))
    return rows.withColumn(text, cleaned).select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names)])

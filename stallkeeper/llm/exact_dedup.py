"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of characters. The distinct blocks that occur more than once are sorted and
named by integers. Then adjacent pairs of names are named in the same way, level by level, until one name stands for the
whole text: two texts of as many blocks have the same last name exactly if they are identical, since every step compares
contents and no step compares hashes. A block or pair that occurs once needs no name: its text has no copy.

Hot groups: names come from counts that Spark combines before the shuffle, and are written before they are joined, so
that adaptive execution can split a key with very many rows on either side of the join. The work halves at each level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.texts import id_key, one_space, text_of
from stallkeeper.session import cut_lineage, free_shuffles

BLOCK_CHARS = 512


def _named(rows: DataFrame, *parts: str) -> DataFrame:
    """An integer for each combination of ``parts`` that occurs more than once, in sorted order within a partition."""
    return cut_lineage(
        rows.groupBy(*parts).count().where("count > 1").sortWithinPartitions(*parts)
        .select(*parts, F.monotonically_increasing_id().alias("name"))
    )


def _keys(docs: DataFrame, id_column: str, text_column: str) -> list[Column]:
    norm = one_space(text_of(text_column))
    return [id_key(id_column).alias("d"), F.unhex(F.sha2(norm, 256)).alias("s")]


def exact_identities(rows: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``d, s, depth, name`` of the rows ``d, s, norm`` whose text may occur again.

    Rows with equal (depth, name) have identical texts, and rows with identical texts have equal (depth, name).
    """
    pieces = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    )
    blocks = rows.select("d", "s", pieces.alias("b")).select(
        "d", "s", F.size("b").cast("long").alias("n"), F.posexplode("b").alias("pos", "block")
    )
    names = _named(blocks, "block")
    free_shuffles(rows.sparkSession)
    at = cut_lineage(blocks.join(names, "block").select("d", "s", "n", F.col("pos").cast("long").alias("pos"), "name"))
    free_shuffles(rows.sparkSession)
    settled, depth = [], 0
    while True:
        settled.append(at.where("n = 1").select("d", "s", F.lit(depth).alias("depth"), "name"))
        if at.where("n > 1").isEmpty():
            break
        side = [F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1)]
        pairs = (
            at.where("n > 1").groupBy("d", "s", "n", F.expr("pos div 2").alias("p"))
            .agg(side[0].alias("a"), side[1].alias("b"))
            .where("a is not null and (b is not null or 2 * p + 1 >= n)")
            .select("d", "s", F.expr("(n + 1) div 2").alias("n"), F.col("p").alias("pos"), "a",
                    F.coalesce("b", F.lit(-1).cast("long")).alias("b"))
        )
        at = cut_lineage(pairs.join(_named(pairs, "a", "b"), ["a", "b"]).select("d", "s", "n", "pos", "name"))
        depth += 1
    return reduce(DataFrame.union, settled).distinct()


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: ``id, sha256, keep_id, group_size, kept`` and the keys ``d, s``.

    Texts are equal when identical after replacing each run of white space by one space. The smallest id of equal texts
    stays. A null text is the empty text, and empty texts are equal. A null id comes after all others: its row stays only
    if no row with an id has its text. Rows that repeat both id and text are one document and returned once, but
    group_size counts every row; rows that repeat an id with other texts are separate documents. An empty table gives an
    empty result. Other columns are not read.
    """
    norm = one_space(text_of(text_column))
    rows = docs.select(F.col(id_column).alias("id"), *_keys(docs, id_column, text_column), norm.alias("norm"))
    seen = cut_lineage(rows.groupBy("d", "s").agg(F.min("id").alias("id"), F.count("*").alias("n_rows")))
    ident = cut_lineage(exact_identities(rows, block_chars))
    sized = ident.join(seen, ["d", "s"])
    groups = cut_lineage(
        sized.groupBy("depth", "name").agg(F.min("id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    )
    member = ident.join(groups, ["depth", "name"]).select("d", "s", "keep_id", "group_size")
    keep = F.coalesce("keep_id", "id")
    return seen.join(member, ["d", "s"], "left").select(
        "d", "s", "id", F.lower(F.hex("s")).alias("sha256"), keep.alias("keep_id"),
        F.coalesce("group_size", "n_rows").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                          block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns, one row per document."""
    kept = cut_lineage(exact_groups(docs, id_column, text_column, block_chars).where("kept").select(
        F.col("d").alias("kept_d"), F.col("s").alias("kept_s")))
    free_shuffles(docs.sparkSession)
    names = [f"row_{i}" for i in range(len(docs.columns))]
    keyed = docs.select(*_keys(docs, id_column, text_column), *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)])
    left = keyed.join(kept, (keyed["d"] == kept["kept_d"]) & (keyed["s"] == kept["kept_s"]), "left_semi")
    once = left.groupBy("d", "s").agg(F.first(F.struct(*names)).alias("row"))
    return once.select(*[F.col(f"row.{a}").alias(c) for c, a in zip(docs.columns, names)])

"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; for each host (here: source) the distinct documents that hold a line are counted, lines
above the limit are removed, and a document that has lost nearly all its words is rejected. Copies of one text count as
one document, so that a text is not taken for boilerplate because it was copied. Counting combines before the shuffle;
the frequent lines are written before they are joined to the lines of all documents, so a line or host that owns a third
of the rows is split by adaptive execution. Everything is built-in functions; each row's word windows are handled
inside the row, in time n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.texts import SPACE, id_key, let, text_of, words_of
from stallkeeper.session import cut_lineage

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_DOCS_PER_HOST = 100
MIN_KEPT_PERCENT = 20
WORD_IN_LINE = f"[^{SPACE}]"


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or more in ``words``, first ones included."""
    def cover(starts):
        return F.aggregate(
            F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(
                F.lit(window), F.get(starts, i + 1) - p)).otherwise(window)),
            F.lit(0), lambda a, b: a + b)

    def marked(s):
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])

    def hashes(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))

    def places(hs):
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return let(ordered, lambda s: let(F.sort_array(marked(s)), cover))

    def count(w):
        return F.when(F.size(w) <= window, F.lit(0)).otherwise(let(hashes(w), lambda hs: F.when(
            F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(places(hs))))

    return let(words, count)


def base_rules(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    """``id``, the keys ``d, t, host`` (id, hash of the text, host) and the base measures of every row; see ``quality_verdicts``."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_IN_LINE))
    rows = docs.select(F.col(id_column).alias("id"), id_key(id_column).alias("d"),
                       id_key(host_column).alias("host"), text_of(text_column).alias("text"))
    return rows.select(
        "id", "d", "host", F.xxhash64("text").alias("t"),
        F.length(F.regexp_replace(text, f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words_of(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))).alias("w"),
    ).select("id", "d", "t", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
             F.col("w.repeated").alias("n_repeat_words"))


def _normal(line: Column) -> Column:
    """Case, digits and spacing set aside."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), f"[{SPACE}]+", " "), r"\d", "0"))


def _lines(docs: DataFrame, id_column: str, text_column: str, host_column: str) -> DataFrame:
    rows = docs.select(
        id_key(id_column).alias("d"), F.xxhash64(text_of(text_column)).alias("t"),
        id_key(host_column).alias("host"), F.split(text_of(text_column), "\n").alias("lines"))
    return rows.select("d", "t", "host", F.posexplode("lines").alias("pos", "line")).where(
        F.col("line").rlike(WORD_IN_LINE)
    ).select("d", "t", "host", "pos", F.xxhash64(_normal(F.col("line"))).alias("h"),
             F.size(words_of(F.col("line"))).cast("long").alias("n"))


def frequent_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """``host, h`` of the lines that more than max_docs distinct texts of the host hold."""
    return lines.select("host", "h", "t").distinct().groupBy("host", "h").count().where(
        F.col("count") > max_docs).select("host", "h")


def removed_lines(docs: DataFrame, id_column: str, text_column: str, host_column: str, max_docs: int) -> DataFrame:
    """``d, t, positions, removed_words``: the frequent lines of each document that has any.

    Repeated rows count and lose their lines once.
    """
    lines = _lines(docs, id_column, text_column, host_column)
    often = cut_lineage(frequent_lines(lines, max_docs))
    hits = lines.join(often, ["host", "h"]).select("d", "t", "host", "pos", "n").distinct()
    return hits.groupBy("d", "t", "host").agg(F.collect_list("pos").alias("positions"), F.sum("n").alias("removed_words"))


def quality_verdicts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                     max_docs: int = MAX_DOCS_PER_HOST, min_words: int = MIN_WORDS,
                     max_repeat_percent: int = MAX_REPEAT_PERCENT, min_kept_percent: int = MIN_KEPT_PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``id``, the keys ``d, t, host``, the base measures, ``removed_words, base_failed, depleted, kept``.

    word_chars, n_symbols, n_dup_lines and n_repeat_words are measured on the whole text. A document fails the base rules
    with fewer than min_words words or more than max_repeat_percent of its words in repeated windows, and is depleted
    when less than min_kept_percent of its words, or fewer than min_words, are left without the frequent lines of its
    host. Null or empty texts have no words and fail. Null hosts are one host; null ids are handled like any id.
    Repeated rows are judged alike. Empty tables give an empty result; other columns are not read.
    """
    base = base_rules(docs, id_column, text_column, host_column)
    lost = removed_lines(docs, id_column, text_column, host_column, max_docs).drop("positions")
    left = F.col("n_words") - F.col("removed_words")
    return base.join(lost, ["d", "t", "host"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0))).select(
        "id", "d", "t", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        ((F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)).alias("base_failed"),
        ((left < min_words) | (left * 100 < F.col("n_words") * min_kept_percent)).alias("depleted"),
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def clean_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source",
                    **limits) -> DataFrame:
    """The kept rows with all their columns, frequent lines taken out of the text."""
    verdict = quality_verdicts(docs, id_column, text_column, host_column, **limits)
    gone = removed_lines(docs, id_column, text_column, host_column, limits.get("max_docs", MAX_DOCS_PER_HOST))
    verdict = cut_lineage(verdict.where("kept").select("d", "t", "host").distinct())
    names = [f"row_{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_column)]
    rows = docs.select(id_key(id_column).alias("d"), F.xxhash64(text_of(text_column)).alias("t"),
                       id_key(host_column).alias("host"), *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)])
    rows = rows.join(verdict, ["d", "t", "host"], "left_semi").join(cut_lineage(gone), ["d", "t", "host"], "left")
    lines = F.split(F.col(text), "\n")
    stays = let(lines, lambda x: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("positions")), lambda p: F.get(x, p)), "\n"))
    cleaned = rows.withColumn(text, F.when(F.col("positions").isNull(), F.col(text)).otherwise(stays))
    return cleaned.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names)])

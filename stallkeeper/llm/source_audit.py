"""How far the sources of a language lie apart in their words.

Each (language, source) group has a segment tree over the term ids of its language; a node is named by its two children and
a leaf by its count, so identical count subtrees of any groups are one node (hash-consing). Two trees are walked together
from their roots: equal pairs of nodes on a level are merged with their multiplicity, so each is priced once.

The term ids of a language are dealt by hash into subtrees of about ``BLOCK`` terms and its groups into tiles of about
``TILE`` sources; a task holds one subtree of the groups of two tiles, whatever the size of a language or a source. The
level above the subtrees is a sum. The number of result rows, and so of tasks, grows with the square of a language's
sources, as the audit asks for all pairs.

Null text, language and source count as empty. Every row is a document, repeated ids too. A text without terms, and a
language without kept terms, still has its group and its pairs, with value 0 where no term is kept. Long texts are counted
in pieces, whole. Equal values rank by item in UTF-8 order. An empty table gives no rows. Other columns are not read, so
their names may be any.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm import bytewords
from stallkeeper.llm.texts import text_of
from stallkeeper.session import cut_lineage

MIN_DOCS = 30
TOP_TERMS = 50
BLOCK = 2048
TILE = 32
HELD_TERMS = 200_000  # distinct terms a counting task holds before it hands its counts on
SMOOTH = 5
SCALE = 1_000_000_000

#: ASCII bytes that are no letters become spaces, A-Z become a-z; the bytes of all other characters stay
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _pieces(data: bytes):
    """The terms of one text, a list for about every MB."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= bytewords.SEGMENT else data.find(b" ", at + bytewords.SEGMENT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term); a null term stands for the group itself."""

    def count(batches):
        held, entries = {}, 0
        for batch in batches:
            data, offsets = bytewords.text_bytes(batch.column("text"))
            for i, group in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())):
                if group not in held:
                    held[group] = Counter(), Counter()
                n, docs = held[group]
                before, own = len(n), set()
                for terms in _pieces(data[offsets[i] : offsets[i + 1]].tobytes().translate(TERM_BYTES)):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
                entries += len(n) - before + 1
                if entries >= HELD_TERMS:
                    yield from put(held)
                    held, entries = {}, 0
        yield from put(held)

    def put(held):
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            rows = len(terms) + 1
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * rows, pa.string()), pa.array([source] * rows, pa.string()),
                pa.array([None, *terms], pa.binary()).cast(pa.string()),
                pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in terms)], pa.int64()),
            ], names=["lang", "source", "term", "n", "docs"])

    rows = docs.select(text_of(lang_column).alias("lang"), text_of(source_column).alias("source"), text_of(text_column).alias("text"))
    found = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Forest:
    """Segment trees of equal width with shared nodes, one tree for each row of counts."""

    def __init__(self, counts: np.ndarray):
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        padded = np.full((counts.shape[0], width), -1, np.int64)  # a count that no term has
        padded[:, : counts.shape[1]] = counts
        self.counts, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        self.levels = []  # children of each node, leaves' parents first
        while ids.shape[1] > 1:
            n = int(ids.max(initial=0)) + 1
            names, above = np.unique(ids[:, ::2] * n + ids[:, 1::2], return_inverse=True)
            self.levels.append((names // n, names % n))
            ids = above.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]

    def leaf_pairs(self, one: int, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of leaves at the same place in two trees, and how many places have each."""
        a, b, times = self.roots[[one]], self.roots[[other]], np.ones(1, np.int64)
        for left, right in reversed(self.levels):
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            n = int(b.max()) + 1
            pairs, where = np.unique(a * n + b, return_inverse=True)
            times = np.bincount(where, np.concatenate([times, times]), len(pairs)).astype(np.int64)
            a, b = pairs // n, pairs % n
        return a, b, times

    def shares(self, size: int, kept: int) -> np.ndarray:
        """The price of each leaf for a tree of ``size`` occurrences; 0 for places without a term."""
        below = size + SMOOTH * kept
        return np.array([1 + SCALE * (c + SMOOTH) // below if c >= 0 else 0 for c in self.counts.tolist()], np.int64)


def _price(key, table):
    """Prices of all pairs of two tiles' groups over one subtree, and in a tile by itself its groups' best terms."""
    _, _, first, second = (k.as_py() for k in key)
    lang = key[0].as_py()
    is_group = pc.is_null(table.column("term"))
    groups = sorted(table.filter(is_group).select(["source", "tile", "size", "kept", "lang_size"]).to_pylist(), key=lambda r: r["source"])
    place = {r["source"]: i for i, r in enumerate(groups)}
    cells = table.filter(pc.invert(is_group))
    totals = dict(zip(cells.column("term").to_pylist(), cells.column("total").to_pylist()))
    terms = sorted(totals, key=lambda t: (-totals[t], t.encode()))  # rare terms side by side, where trees share most
    ids = {t: i for i, t in enumerate(terms)}
    counts = np.zeros((len(groups), len(terms)), np.int64)
    counts[[place[s] for s in cells.column("source").to_pylist()], [ids[t] for t in cells.column("term").to_pylist()]] = cells.column("n").to_numpy()
    forest = Forest(counts)
    share = [forest.shares(r["size"], r["kept"]) if r["kept"] else np.zeros(len(forest.counts), np.int64) for r in groups]
    out = []
    for i, one in enumerate(groups):
        for j in range(i):
            if {one["tile"], groups[j]["tile"]} == {first, second}:
                a, b, times = forest.leaf_pairs(i, j)
                value = int((np.abs(share[i][a] - share[j][b]) * times).sum())
                out += [(one["source"], "pair", groups[j]["source"], value), (groups[j]["source"], "pair", one["source"], value)]
    if first == second and terms:
        below = groups[0]["lang_size"] + SMOOTH * groups[0]["kept"]
        usual = np.array([1 + SCALE * (totals[t] + SMOOTH) // below for t in terms], np.int64)
        leaf = np.searchsorted(forest.counts, counts)
        names = [t.encode() for t in terms]
        for i, one in enumerate(groups):
            over = np.where(counts[i] > 0, share[i][leaf[i]] - usual, 0)
            best = sorted(np.flatnonzero(over > 0).tolist(), key=lambda t: (-over[t], names[t]))[:TOP_TERMS]
            out += [(one["source"], "term", terms[t], int(over[t])) for t in best]
    columns = list(zip(*out)) if out else [[]] * 4
    return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(columns[0], pa.string()),
                     "part": pa.array(columns[1], pa.string()), "item": pa.array(columns[2], pa.string()), "value": pa.array(columns[3], pa.int64())})


def source_audit(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
                 min_docs: int = MIN_DOCS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank (1 first) of every group, as stated above.

    ``pair``: the summed distance to each other source of the language. ``term``: the 50 terms whose share exceeds the
    language's most.
    """
    counts = cut_lineage(term_counts(docs, text_column, lang_column, source_column))
    kept_terms = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= min_docs).drop("docs")
    kept_terms = cut_lineage(kept_terms)
    kept = cut_lineage(counts.select("lang", "source", "term", "n").join(kept_terms, ["lang", "term"]))
    langs = counts.where("term IS NULL").groupBy("lang").agg(F.count("*").alias("sources")).join(
        kept_terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size")), "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_size", F.lit(0)).alias("lang_size"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("kept", F.lit(0)) / F.lit(block))).cast("int").alias("blocks"),
        F.ceil(F.col("sources") / F.lit(tile)).cast("int").alias("tiles"))
    groups = counts.where("term IS NULL").select("lang", "source").join(langs, "lang").join(
        kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left").withColumns({
            "size": F.coalesce("size", F.lit(0)), "tile": F.pmod(F.xxhash64("source"), "tiles").cast("int")})
    groups = cut_lineage(groups)

    def dealt(rows: DataFrame, *more) -> DataFrame:
        """A copy of each row for every tile that its own is compared with."""
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
            "lang", "block", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"), "source", *more)

    marks = dealt(groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "tile", "size", "kept", "lang_size")
    cells = dealt(kept.join(groups.select("lang", "source", "blocks", "tiles", "tile"), ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), "blocks").cast("int")), "term", "n", "total")
    priced = marks.unionByName(cells, allowMissingColumns=True).groupBy("lang", "block", "first", "second").applyInArrow(
        _price, "lang string, source string, part string, item string, value long")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    # a term stands in one block only, so that summing leaves its value as it is
    ranked = priced.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP_TERMS))

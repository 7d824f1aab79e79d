"""A z-fast trie over conversations: shared prefixes, what hangs below them, and the words that sharing them saves.

A conversation is a string of turns. Its prefixes are known by 128-bit keys, and so a table of (conversation, depth, key)
stands for all strings. Explicit nodes of the compacted trie are the prefixes at which strings part or end. Each is stored
with the depths ``low`` (of the explicit node above it, exclusive) and ``high`` (its own) and hashed under its handle: its
prefix at the two-fattest depth of (low, high], the one that the most powers of two divide. A string finds the deepest
explicit node on its way in a logarithmic number of look-ups (fat binary search), all strings of a batch at once by joins.
A batch is then merged: edges are split where strings leave them, and nodes are added where the batch's own rests part or
end. At the end edges are expanded to one row for every prefix.

Nothing is gathered by conversation or node in one task: turns are numbered by a range sort, running values along a
conversation are worked out by segments of ``SEGMENT`` turns and carried over, counts of a node are aggregates that
combine before the shuffle, and joins of a hot node's many strings with its one row are inner or left joins that adaptive
execution splits. The one exception is asked for: the hash of a node's sorted ids reads them in one stream, in which one
row is a run of up to ``RUN`` ids; it holds one run at a time.

Rows without a conversation id belong to no conversation and are left out. Null role and text count as empty. Turns go by
number, nulls first; equal numbers go by the md5 of role and text, and repeated rows are turns of their own. Texts are hashed
whole, however long. A conversation whose turns are all cut off is a member of the root. An empty table has no node. Other
columns are not read, so their names may be any.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.texts import SPACE, text_of
from stallkeeper.session import cut_lineage

SEGMENT = 4096
RUN = 4096
FIRST_BATCH = 8  # the first batch is one string in so many, the second all others
HEAD = 3  # turns that a conversation may take over from another
FAMILY = 20
ROOT = "0-0"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _key(a: Column, b: Column) -> Column:
    return F.concat(F.hex(a), F.lit("-"), F.hex(b))


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def running(rows: DataFrame, values: dict[str, tuple], backward: bool = False, inclusive: bool = True) -> DataFrame:
    """Columns that follow each conversation by depth, forward or backward: {name: (aggregate, column, how two parts join)}.

    A conversation is cut into segments; what the segments before hold is carried over by a join with the few
    conversations that have several.
    """
    direction = (lambda c: F.col(c).desc()) if backward else F.col
    seg = F.floor(F.col("d") / F.lit(SEGMENT)).cast("long")
    rows = rows.withColumn("seg", seg)
    before = Window.partitionBy("conv").orderBy(direction("seg")).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv", "seg").agg(*[f(c).alias(n) for n, (f, c, _) in values.items()])
    carry = sums.select("conv", "seg", *[f(n).over(before).alias(f"{n}_before") for n, (f, _, _) in values.items()]).where(
        F.coalesce(*[F.col(f"{n}_before") for n in values]).isNotNull())
    within = Window.partitionBy("conv", "seg").orderBy(direction("d")).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = rows.withColumns({n: f(c).over(within) for n, (f, c, _) in values.items()}).join(carry, ["conv", "seg"], "left")
    both = {n: F.when(F.col(f"{n}_before").isNull(), F.col(n)).when(F.col(n).isNull(), F.col(f"{n}_before")).otherwise(
        join(F.col(n), F.col(f"{n}_before"))) for n, (_, _, join) in values.items()}
    return out.withColumns(both).drop("seg", *[f"{n}_before" for n in values])


def _xor(a, b):
    return a.bitwiseXOR(b)


def _plus(a, b):
    return a + b


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv, part, pos, content, words of each turn: pos ascends by conversation and turn within a part, parts ascend too."""
    role, text = text_of("role"), text_of("text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("content"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("content")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"), "content", "words")


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, key, above, words, upto) of each prefix of each rebuilt conversation, and (conv, len, key) of each conversation.

    A conversation c is the first h = crc32(c) % 4 turns of conversation c - c % 20 and its own turns after its first h.
    """
    turns = cut_lineage(numbered_turns(conversations))
    parts = turns.groupBy("conv", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut_lineage(parts.withColumn("prior", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD + 1))
    convs = parts.groupBy("conv").agg(F.sum("n").alias("own")).withColumns(
        {"h": head, "base": F.col("conv") - F.col("conv") % F.lit(FAMILY)})
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = cut_lineage(convs.select("conv", "h", "base", "taken", "own"))
    ranked = turns.join(parts.join(convs.select("conv", "h", "taken"), "conv").drop("n"), ["conv", "part"]).withColumn(
        "rank", F.col("prior") + F.col("pos") - F.col("first") + 1)
    tails = ranked.where(F.col("rank") > F.col("h")).select(
        "conv", (F.col("taken") + F.col("rank") - F.col("h")).alias("d"), "content", "words")
    openings = ranked.where(F.col("rank") <= HEAD).select(F.col("conv").alias("base"), "rank", "content", "words")
    heads = convs.where("taken > 0").select("conv", "base", "taken").join(openings, "base").where(
        F.col("rank") <= F.col("taken")).select("conv", F.col("rank").alias("d"), "content", "words")
    path = tails.unionByName(heads).withColumns({"a": F.xxhash64("d", "content"), "b": F.xxhash64(F.lit(7919), "content", "d")})
    path = running(path, {"x": (F.bit_xor, "a", _xor), "y": (F.bit_xor, "b", _xor), "upto": (F.sum, "words", _plus)})
    path = cut_lineage(path.select("conv", "d", _key(F.col("x"), F.col("y")).alias("key"),
                                   _key(_xor(F.col("x"), F.col("a")), _xor(F.col("y"), F.col("b"))).alias("above"), "words", "upto"))
    last = path.groupBy("conv").agg(F.max("d").alias("len"), F.max_by("key", "d").alias("key"))
    ends = convs.select("conv").join(last, "conv", "left").select(
        "conv", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("key", F.lit(ROOT)).alias("key"))
    return path, cut_lineage(ends)


NODE = ["key", "low", "high", "rep", "first", "up", "fat", "handle"]


class ZFastTrie:
    """Explicit nodes of the compacted trie of all strings inserted so far.

    nodes: key (of the node's prefix), low, high, rep (a string through it), first (key of the edge's first prefix), up (key
    of the explicit node above), fat (the two-fattest depth), handle (key at that depth).
    """

    def __init__(self, paths: DataFrame):
        self.paths = paths  # conv, d, key, above: every string that is or will be inserted
        spark = paths.sparkSession
        self.nodes = spark.createDataFrame([(ROOT, -1, 0, None, None, None, 0, None)],
                                           "key string, low long, high long, rep long, first string, up string, fat long, handle string")

    def locate(self, strings: DataFrame) -> DataFrame:
        """conv, len, at: the depth of the deepest explicit node that is a prefix of the string, by fat binary search."""
        state = strings.select("conv", "len", F.lit(0).cast("long").alias("at"), F.col("len").alias("upper"))
        handles = cut_lineage(self.nodes.where("high > 0").select("handle", "fat", "high", F.col("key").alias("node")))
        if handles.isEmpty():
            return state.drop("upper")
        state = cut_lineage(state)
        steps = self.paths.select("conv", "d", "key")
        while not (looking := state.where("at < upper")).isEmpty():
            looking = looking.withColumn("fat", two_fattest(F.col("at"), F.col("upper")))
            asked = looking.join(steps.withColumnsRenamed({"d": "fat", "key": "handle"}), ["conv", "fat"])
            found = asked.join(handles, ["handle", "fat"], "left")
            # a handle alone does not tell that the rest of the node's edge is on the way
            held = found.join(steps.withColumnsRenamed({"d": "high", "key": "own"}), ["conv", "high"], "left")
            match = F.coalesce(F.col("own") == F.col("node"), F.lit(False))
            moved = held.select("conv", "len", F.when(match, F.col("high")).otherwise(F.col("at")).alias("at"),
                                F.when(match, F.col("upper")).otherwise(F.col("fat") - 1).alias("upper"))
            state = cut_lineage(moved.unionByName(state.where("at >= upper")))
        return state.drop("upper")

    def exits(self, strings: DataFrame) -> DataFrame:
        """conv, len, at, leave (depth to which the trie has the string), edge (node in whose edge that is, or null) and its high."""
        located = self.locate(strings)
        steps = self.paths.select("conv", "d", "key")
        nexts = located.join(steps.select("conv", (F.col("d") - 1).alias("at"), F.col("key").alias("first")), ["conv", "at"], "left")
        edges = self.nodes.where("high > 0").select("first", F.col("key").alias("edge"), "high", "rep")
        out = cut_lineage(nexts.join(edges, "first", "left").select("conv", "len", "at", "edge", "high", "rep"))
        along = out.where("edge IS NOT NULL").join(steps, "conv").where(
            (F.col("d") > F.col("at")) & (F.col("d") <= F.least("high", "len"))).select("conv", "rep", "d", "key")
        model = steps.select(F.col("conv").alias("rep"), "d", F.col("key").alias("same"))
        shared = along.join(model, ["rep", "d"]).where(F.col("key") == F.col("same")).groupBy("conv").agg(F.max("d").alias("leave"))
        return out.join(shared, "conv", "left").withColumn("leave", F.coalesce("leave", "at")).select(
            "conv", "len", "at", "leave", "edge", "high")

    def insert(self, strings: DataFrame) -> None:
        """Merge a batch: conv, len, key (of the whole string), distinct keys."""
        points = cut_lineage(self.exits(strings))
        rest = cut_lineage(self.paths.join(points.select("conv", "leave"), "conv").where(F.col("d") > F.col("leave")).select(
            "conv", "d", "key", "above", "leave"))
        # where an edge is left or a string ends within it
        splits = points.where((F.col("leave") > F.col("at")) & (F.col("leave") < F.col("high")) & F.col("edge").isNotNull()).join(
            self.paths.select("conv", F.col("d").alias("leave"), "key"), ["conv", "leave"]).groupBy("edge", "key").agg(
            F.first("leave").alias("high"), F.first("at").alias("at"), F.min("conv").alias("rep"))
        up_the_edge = Window.partitionBy("edge").orderBy("high")
        splits = cut_lineage(splits.withColumn("low", F.coalesce(F.lag("high").over(up_the_edge), "at")))
        # where rests part, and where they end
        parting = rest.select("above", "key").distinct().groupBy("above").count().where("count > 1").select(F.col("above").alias("key"))
        ending = strings.where("len > 0").select("key")
        known = self.nodes.select("key").union(splits.select("key"))
        marks = cut_lineage(parting.union(ending).distinct().join(known, "key", "left_anti"))
        marked = rest.join(marks, "key")  # conv, d, key, leave
        marked = running(marked.select("conv", "d", "key", "leave"), {"low": (F.max, "d", F.greatest)}, inclusive=False)
        grown = marked.groupBy("key").agg(F.max(F.coalesce("low", "leave")).alias("low"), F.max("d").alias("high"), F.min("conv").alias("rep"))
        lower = splits.groupBy("edge").agg(F.max("high").alias("cut")).withColumnRenamed("edge", "key")
        old = self.nodes.join(lower, "key", "left")
        changed = old.where("cut IS NOT NULL").select("key", F.col("cut").alias("low"), "high", "rep")
        fresh = changed.unionByName(splits.select("key", "low", "high", "rep")).unionByName(grown).withColumn(
            "fat", two_fattest(F.col("low"), F.col("high")))
        starts = self.paths.select(F.col("conv").alias("rep"), (F.col("d") - 1).alias("low"), F.col("key").alias("first"), F.col("above").alias("up"))
        handles = self.paths.select(F.col("conv").alias("rep"), F.col("d").alias("fat"), F.col("key").alias("handle"))
        fresh = fresh.join(starts, ["rep", "low"]).join(handles, ["rep", "fat"])
        self.nodes = cut_lineage(old.where("cut IS NULL").select(NODE).unionByName(fresh.select(NODE)))


def _ends_hash(ends: DataFrame) -> DataFrame:
    """key, sha: SHA-256 of the ascending ids of the conversations that end at a node, joined by commas."""

    def runs(batches):
        for batch in batches:
            key, conv = batch.column("key"), batch.column("conv").to_numpy()
            if not len(conv):
                continue
            code = key.dictionary_encode().indices.to_numpy()
            new = np.concatenate([[True], code[1:] != code[:-1]])
            start = np.flatnonzero(new | ((np.arange(len(code)) - np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))) % RUN == 0))
            stop = np.append(start[1:], len(code))
            yield pa.RecordBatch.from_arrays([
                key.take(pa.array(start)), pa.array(conv[start]),
                pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in zip(start, stop)], pa.string())], names=["key", "conv", "ids"])

    def hashes(batches):
        last, digest = None, None
        for batch in batches:
            done = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    digest.update(b"," + ids.encode())
                else:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([s for _, s in done], pa.string())], names=["key", "sha"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=["key", "sha"])

    joined = ends.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(
        runs, "key string, conv long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "conv").mapInArrow(hashes, "key string, sha string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every prefix, the root included.

    saved_tokens: over the node's subtree, itself included, a node's members but one times the words of its last text.
    """
    path, ends = rebuilt_paths(conversations)
    # equal strings are one from here on, with its smallest id and its number of copies
    strings = cut_lineage(ends.groupBy("key").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"), F.first("len").alias("len")))
    path = cut_lineage(path.join(strings.select("conv"), "conv", "left_semi"))
    trie = ZFastTrie(path)
    early = F.pmod(F.xxhash64("conv"), F.lit(FIRST_BATCH)) == 0
    for batch in (early, ~early):
        trie.insert(strings.where(batch).select("conv", "len", "key"))

    nodes = trie.nodes
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n_children"))
    strings = cut_lineage(strings.join(children, "key", "left").select(
        "key", "conv", "copies", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_children").isNull().cast("long").alias("leaf")))
    # each string's explicit nodes, with the words of each one's edge
    on_way = path.join(nodes.select("key", "low", "high"), "key").select("conv", "d", "key", "low", "words", "upto")
    on_way = running(on_way, {"upto_above": (F.max, "upto", F.greatest)}, inclusive=False)
    on_way = cut_lineage(on_way.withColumn("upto_above", F.coalesce("upto_above", F.lit(0))))
    members = on_way.join(strings.select("conv", "copies", "leaf"), "conv").groupBy("key").agg(
        F.min("conv").alias("owner"), F.sum("copies").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
    members = cut_lineage(members.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    edges = on_way.join(members.select("key", "owner", "n_convs"), "key").withColumn(
        "edge_saved", F.when(F.col("owner") == F.col("conv"), (F.col("n_convs") - 1) * (F.col("upto") - F.col("upto_above"))).otherwise(0))
    edges = cut_lineage(edges)
    deeper = running(edges, {"below": (F.sum, "edge_saved", _plus)}, backward=True, inclusive=False)
    below = deeper.groupBy("key").agg(F.sum(F.coalesce("below", F.lit(0))).alias("below"))
    above = running(edges, {"owner_above": (F.max, "owner", F.greatest)}, inclusive=False)
    owned = above.where(F.col("owner") == F.col("conv")).select(
        "conv", F.col("d").alias("high"), "key", "low", "n_convs", "owner_above", F.col("upto").alias("upto_end"))
    owned = owned.join(below, "key").join(members.select("key", "n_leaves", "n_children"), "key").join(_ends_hash(ends), "key", "left")

    whole = strings.agg(F.min("conv").alias("owner"), F.sum("copies").alias("n_convs"), F.sum("leaf").alias("n_leaves"))
    first = whole.first()["owner"]  # null in an empty table
    parts = [whole, children.where(F.col("key") == ROOT).select("n_children"), edges.agg(F.sum("edge_saved").alias("saved")),
             _ends_hash(ends.where(F.col("key") == ROOT)).select("sha")]
    root = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).agg(
        *[F.max(c).alias(c) for c in ("owner", "n_convs", "n_leaves", "n_children", "saved", "sha")]).where("owner IS NOT NULL").select(
        F.col("owner").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))

    # expand the edges: every prefix belongs to the first explicit node at or below it
    marks = edges.select("conv", "d", F.col("d").alias("explicit"))
    every = running(path.select("conv", "d", "words", "upto").join(marks, ["conv", "d"], "left"), {"high": (F.min, "explicit", F.least)}, backward=True)
    rows = every.join(owned, ["conv", "high"])
    at_node = F.col("d") == F.col("high")
    rows = rows.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("low") + 1, F.col("conv")).otherwise(F.coalesce("owner_above", F.lit(first).cast("long"))).alias("parent_conv_id"),
        "n_convs", F.when(at_node, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("upto_end") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        F.when(at_node, F.coalesce("sha", F.lit(EMPTY_SHA))).otherwise(EMPTY_SHA).alias("ends_sha256"))
    return rows.unionByName(root)

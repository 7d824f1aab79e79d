"""Near duplicates: an exact n-gram Jaccard join by universe partition and the pigeonhole principle.

The universe of shingles is dealt by hash into m segments; m grows with the band of set sizes. Two sets of sizes a and b
with Jaccard similarity of 0.8 or more differ in at most H = (a + b) / 9 shingles, so if a set gives its segments the
allowances v (0: not looked at, 1: equal, 2: equal but for one shingle) and they sum to more than H, every partner agrees
with it on a segment within its allowance. Sets are indexed by the hashes of their segments and, for segments that may
get allowance 2, of their one-deletion neighbours. Allowances go where buckets are expected to be smallest: segments with
many shingles first, then a second unit on the largest, and segments with one shingle or none only if nothing else is
left. Small bands use few segments with allowance 2, one more than would do, so that a segment that is empty, or is so
without one shingle, need not be looked at: all sets would agree on it. Sets that have too few others deal their shingles
anew, and so do those that may be their partners. Sets of up to 4 shingles differ from none of their band that they link
with. A set looks up its own band and the next, in which its larger partners may lie.

Sets that are equal are joined first and act as one. A bucket's sets are compared with up to four of them, its centres.
Buckets that then still hold several components are looked at in blocks of bounded size inside tasks, and only pairs that
may link come out. What rules a pair out there, and before whole sets are fetched, is the parity of the number of
shingles per hash bucket: the bits in which two sets' parities differ are no more than the shingles in which they do.
Shingles are 64-bit hashes of five words, equal sets are recognised by 128 bits; every link is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm import bytewords
from stallkeeper.llm.bytewords import mix
from stallkeeper.llm.components import components
from stallkeeper.llm.texts import id_key, text_of
from stallkeeper.session import cut_lineage, free_shuffles

N = 5
PERCENT = 80
SMALL = 60  # bands up to this size use allowance 2
TURNS = 3  # so often sets of up to AGAIN shingles are dealt, until segments with shingles suffice; only the last turn has
AGAIN = 13  # keys of empty ones. Of larger sets few in 100,000 look such a key up, and all might be their partners
LARGE_SEGMENT = 10  # elsewhere only segments from this size on may get allowance 2
BLOCK = 1024  # sets of a bucket that are looked at together
INDEX, PROBE, PROBE2, INDEX_LESS, PROBE_LESS = 1, 2, 4, 8, 16


def max_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shingles in one set only, at most, of two sets of these sizes that link."""
    return (a + b) * (100 - PERCENT) // (100 + PERCENT)


def bands(largest: int) -> list[tuple[int, int, int]]:
    """(smallest size, largest size, segments) of each band; a set's partners lie in its band or one beside it."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 3, low * 3 // 2)
        most = max(int(max_difference(high, high)), int(max_difference(low - 1, min(high, (low - 1) * 100 // PERCENT))))
        few = -(-(most + 1) // 2)
        out.append((low, high, few + (few > 1) if high <= SMALL else most + 1 + max(2, high // 50)))
        low = high + 1
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, rows in order and hashes sorted within a row."""
    words, _, first = bytewords.word_hashes(data, offsets)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    factor = mix(np.arange(11, 11 + N, dtype=np.uint64))
    rows, hashes = [], []
    for k in range(1, N + 1):  # with fewer words than N, the whole sequence is the one shingle
        at = np.flatnonzero(row[: max(0, len(row) - N + 1)] == row[N - 1 :]) if k == N else first[:-1][count == k]
        total = np.full(len(at), k, np.uint64)
        for j in range(k):
            total += words[at + j] * factor[j]
        rows.append(row[at])
        hashes.append(mix(total))
    row, h = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def _sums(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, row, values)
    return out


def set_identity(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two independent 64-bit hashes of each row's set."""
    return (np.bincount(row, minlength=n), _sums(mix(h ^ np.uint64(0xA5A5A5A5)), row, n),
            _sums(mix(h + np.uint64(0x632BE59BD9B4E019)), row, n))


def parities(row: np.ndarray, h: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Per set, a bit for each of its 2 to 4 times as many hash buckets: whether an odd number of shingles is in it."""
    bits = np.left_shift(64, np.ceil(np.log2(np.maximum(1, size * 2 / 64))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(bits)])
    spread = (mix(h ^ np.uint64(0x94D049BB133111EB)) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(base[row] + spread, minlength=base[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(base[:-1], base[1:])]


def fold(sketch: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words, to ``width`` words: buckets that differ in their top bit only become one."""
    while sketch.shape[1] > width:
        half = sketch.shape[1] // 2
        sketch = sketch[:, :half] ^ sketch[:, half:]
    return sketch


def may_link(sketch: list[bytes], size: np.ndarray, label: np.ndarray, tree: bool):
    """Pairs of different labels that sizes and parities don't rule out; with ``tree`` only such as join new labels."""
    width = np.array([len(x) // 8 for x in sketch])
    kinds = {w: (at := np.flatnonzero(width == w), np.array([np.frombuffer(sketch[i], np.uint64) for i in at])) for w in np.unique(width)}
    left, right, apart = [], [], []
    for w, (at, a) in kinds.items():
        for v, (to, b) in kinds.items():
            if v > w:
                continue
            b_, a_ = fold(b, v), fold(a, v)
            step = max(1, (1 << 21) // max(1, b_.size))
            for k in range(0, len(at), step):
                i = at[k : k + step]
                gap = np.bitwise_count(a_[k : k + step, None, :] ^ b_[None, :, :]).sum(2)
                small, big = np.minimum(size[i][:, None], size[to][None, :]), np.maximum(size[i][:, None], size[to][None, :])
                fine = (gap <= max_difference(small, big)) & (small * 100 >= big * PERCENT) & (label[i][:, None] != label[to][None, :])
                if v == w:
                    fine &= i[:, None] < to[None, :]
                x, y = np.nonzero(fine)
                left.append(i[x])
                right.append(to[y])
                apart.append(gap[x, y])
    left, right, apart = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right, apart))
    if not tree or not len(left):
        return left, right
    names, at = np.unique(label, return_inverse=True)
    parent = list(range(len(names)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for k in np.argsort(apart, kind="stable"):
        x, y = root(at[left[k]]), root(at[right[k]])
        if x != y:
            parent[x] = y
            kept.append(k)
    return left[kept], right[kept]


def signatures(row: np.ndarray, h: np.ndarray, size: np.ndarray, own: bool):
    """(row, key, role) of the sets as members of their own band, or as they look up the next band."""
    table = bands(max(1, int(size.max(initial=1)) * 2))
    low, high, parts = (np.array(x) for x in zip(*table))
    most = np.maximum(max_difference(high, high), max_difference(low - 1, np.minimum(high, (low - 1) * 100 // PERCENT)))
    band = np.searchsorted(high, size)
    takes = size > 0
    if not own:
        band = np.minimum(band + 1, len(low) - 1)
        takes &= size * 100 // PERCENT >= low[band]
    takes &= most[band] > 0  # others link with equal sets only, which are one already
    partner = size if own else np.minimum(high[band], size * 100 // PERCENT)
    need = np.where(takes, max_difference(size, partner) + 1, 0)
    index, probe, out = takes & own, takes, []
    for turn in range(TURNS):
        last = (turn == TURNS - 1) | (high[band] > AGAIN)
        keys, index, probe = _dealt(row, h, band, parts, np.where(high <= SMALL, most, -1), need, index, probe, turn, last)
        out += keys
        if not (index | probe).any():
            break
    return tuple(np.concatenate(x) for x in zip(*out))


def _dealt(row, h, band, parts, most, need, index, probe, turn, last):
    """Keys of one dealing of the sets that ``index`` and ``probe`` name; the sets of each that the next one is to deal."""
    takes = index | probe
    need = np.where(probe, need, 0)
    m = np.where(takes, parts[band], 0)
    base = np.concatenate([[0], np.cumsum(m)])
    used = takes[row]
    row, h = row[used], h[used]
    salt = mix(np.uint64(turn) * np.ones(1, np.uint64))[0]  # 0 in the first turn
    part = ((mix(h ^ np.uint64(0x5851F42D4C957F2D) ^ salt) >> np.uint64(32)) * m[row].astype(np.uint64)) >> np.uint64(32)
    slot = base[row] + part.astype(np.int64)
    token = mix(h + np.uint64(0x2545F4914F6CDD1D))
    count, content = np.bincount(slot, minlength=base[-1]), _sums(token, slot, base[-1])
    owner = np.repeat(np.arange(len(m)), m)
    place = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
    seed = mix(band[owner].astype(np.uint64) * np.uint64(1 << 32) + place + np.uint64(1) ^ salt)
    most = most[band]
    small = most >= 0
    # allowances: ranks by number of shingles, most first
    order = np.lexsort((-count, owner))
    rank = np.empty(base[-1], np.int64)
    rank[order] = np.arange(base[-1]) - base[owner[order]]
    rich = np.bincount(owner, count >= 2, len(m)).astype(np.int64)
    filled = np.bincount(owner, count >= 1, len(m)).astype(np.int64)
    large = np.bincount(owner, count >= LARGE_SEGMENT, len(m)).astype(np.int64)
    half = (need + 1) // 2
    twice = np.minimum(rich, half)
    both = twice + np.maximum(0, need - 2 * twice)
    lacks = small & (both > filled)
    second = np.where(small, np.where(lacks, half * last, twice), np.clip(need - rich, 0, large))
    single = np.where(small, np.where(lacks, half * last, both), np.where(rich >= need, need, np.maximum(rich, need - second)))
    probe2 = rank < second[owner]
    probes = (rank < single[owner]) | probe2
    bare = (small & ~last)[owner] * (1 - np.minimum(count, 1) + 2 * (count == 1))  # 1: empty, 2: empty without one
    role = INDEX * (index[owner] & (bare != 1)) + PROBE * probes + PROBE2 * probe2
    whole = role > 0
    out = [(owner[whole], mix(content + seed)[whole], role[whole])]
    indexed = (small[owner] | (count > LARGE_SEGMENT)) & index[owner] & (bare != 2)
    less = INDEX_LESS * indexed + PROBE_LESS * probe2
    wanted = less[slot] > 0
    out.append((row[wanted], mix((content + seed)[slot] - token)[wanted], less[slot][wanted]))
    # a set that lacks has no more than most - most // 2 shingles outside its most // 2 largest segments
    outside = np.bincount(owner, count * (rank >= most[owner] // 2), len(m))
    return out, index & small & ~last & (parts[band] > 1) & (outside <= 2 * most - most // 2), probe & lacks & ~last


def _text_key(text_column: str):
    return F.unhex(F.sha2(text_of(text_column), 256))


def _sets(docs: DataFrame, id_column: str, text_column: str, kind: str) -> DataFrame:
    """Per row its ``identity`` (d, id, n, set, check, parity), or the set's ``signatures`` (key, set, role) or ``shingles``.

    A ``document`` is an identity with the hash ``s`` of its text, which tells rows of one id or of no id apart.
    """
    rows = docs.select(F.col(id_column).alias("id"), id_key(id_column).alias("d"), text_of(text_column).alias("text"))
    if kind == "document":
        rows = rows.withColumn("s", _text_key(text_column))
    long = T.LongType()
    schema = {
        "identity": T.StructType([T.StructField("d", T.StringType()), rows.schema["id"], *(T.StructField(c, long) for c in ("n", "set", "check")), T.StructField("parity", T.BinaryType())]),
        "signatures": T.StructType([T.StructField("key", long), T.StructField("set", long), T.StructField("role", T.ByteType())]),
        "shingles": T.StructType([T.StructField("set", long), T.StructField("shingles", T.ArrayType(long))]),
    }
    schema["document"] = T.StructType([*schema["identity"], T.StructField("s", T.BinaryType())])
    schema = schema[kind]

    def work(batches):
        for batch in batches:
            text = batch.column("text")
            for begin, data, offsets in bytewords.chunks(text):
                n = len(offsets) - 1
                row, h = shingle_sets(data, offsets)
                size, one, two = set_identity(row, h, n)
                name = one.view(np.int64)
                if kind in ("identity", "document"):
                    part = batch.slice(begin, n)
                    columns = [part.column("d"), part.column("id"), pa.array(size, pa.int64()), pa.array(name), pa.array(two.view(np.int64)), pa.array(parities(row, h, size), pa.binary())]
                    columns += [part.column("s")] if kind == "document" else []
                elif kind == "shingles":
                    edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    columns = [pa.array(name), pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64)))]
                else:
                    found = [signatures(row, h, size, own) for own in (True, False)]
                    owner, key, role = (np.concatenate(x) for x in zip(*found))
                    columns = [pa.array(key.view(np.int64)), pa.array(name[owner]), pa.array(role.astype(np.int8))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(work, schema)


def _likely(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that sizes and parities don't rule out."""
    sides = [facts.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab"]
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(low * 100 >= high * PERCENT)

    def test(batches):
        for batch in batches:
            a, b, na, nb, pa_, pb = (batch.column(c) for c in ("a", "b", "na", "nb", "pa", "pb"))
            most = max_difference(na.to_numpy(), nb.to_numpy())
            fine = np.zeros(len(most), bool)
            for k, (x, y) in enumerate(zip(pa_, pb)):
                x, y = (np.frombuffer(v.as_py(), np.uint64)[None, :] for v in (x, y))
                width = min(x.shape[1], y.shape[1])
                fine[k] = int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum()) <= most[k]
            at = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return cut_lineage(both.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(test, "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, known: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs ``a, b`` of sets that link, by the sizes of intersection and union of the whole sets."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    wanted = cut_lineage(known.join(named, "set").groupBy("set").agg(F.min("d").alias("holder")).select("holder"))
    held = docs.join(wanted, id_key(id_column) == F.col("holder"), "left_semi")
    sets = cut_lineage(_sets(held, id_column, text_column, "shingles").dropDuplicates(["set"]))
    a, b = (sets.select(F.col("set").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    links = cut_lineage(
        pairs.join(a, "a").join(b, "b").withColumn("common", common)
        .where(F.col("common") * 100 >= (F.size("sa") + F.size("sb") - F.col("common")) * PERCENT).select("a", "b")
    )
    free_shuffles(docs.sparkSession)
    return links


def _across(buckets: DataFrame, facts: DataFrame, label: DataFrame, tree: bool) -> DataFrame:
    """Pairs ``a, b`` of different components in one bucket that may link; see ``may_link``.

    A bucket of more than BLOCK sets is cut into blocks by hash, and every two blocks meet in a group of their own.
    """
    named = buckets.join(label, F.col("set") == F.col("node"), "left").select(
        "key", "set", "members", F.coalesce("label", "set").alias("label"))
    named = cut_lineage(named)
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    rows = named.join(cut_lineage(mixed), "key").join(facts, "set")
    blocks = F.ceil(F.col("members") / BLOCK).cast("long")
    mine = F.pmod(F.xxhash64("set"), blocks)
    rows = rows.select("key", F.struct("set", "n", "label", "parity").alias("s"), mine.alias("mine"),
                       F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    groups = rows.groupBy("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y")).agg(F.collect_list("s").alias("s"))

    def look(batches):
        for batch in batches:
            sets = batch.column("s")
            flat, edge = sets.flatten(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
            name, n, label_ = (flat.field(c).to_numpy() for c in ("set", "n", "label"))
            parity = flat.field("parity").to_pylist()
            out = [np.empty((0, 2), np.int64)]
            for a, b in zip(edge[:-1], edge[1:]):
                x, y = may_link(parity[a:b], n[a:b], label_[a:b], tree)
                if len(x):
                    out.append(np.sort(np.stack([name[a:b][x], name[a:b][y]], 1), 1))
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return cut_lineage(groups.select("s").mapInArrow(look, "a long, b long").distinct())


def _grouped(docs: DataFrame, id_column: str, text_column: str, kind: str) -> DataFrame:
    """``d, id, n, group`` of every row, and ``s`` for documents; rows with shingles are one component if they share group."""
    known = cut_lineage(_sets(docs, id_column, text_column, kind))
    clash = known.where("n > 0").groupBy("set").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    if not clash.isEmpty():
        raise ValueError("two different sets have one 64-bit hash; change the constants of set_identity")
    # the rows of a key are together from here on: equal sets fall to one, and single ones go
    rows = _sets(docs, id_column, text_column, "signatures").repartition("key")
    rows = rows.groupBy("key", "set").agg(F.bit_or("role").alias("role"))
    key = Window.partitionBy("key")
    of_kind = lambda f, k: f(F.when(F.col("role").bitwiseAND(k) != 0, F.col("set"))).over(key)
    is_index, is_probe = INDEX | INDEX_LESS, PROBE | PROBE2 | PROBE_LESS
    ends = [of_kind(f, k).alias(c) for c, f, k in (
        ("i0", F.min, is_index), ("i1", F.max, is_index), ("p0", F.min, is_probe), ("p1", F.max, is_probe))]
    buckets = cut_lineage(rows.select("*", F.count("*").over(key).alias("members"), *ends).where(
        "members > 1 AND i0 IS NOT NULL AND p0 IS NOT NULL"))
    free_shuffles(docs.sparkSession)
    facts = cut_lineage(known.join(buckets.select("set").distinct(), "set").groupBy("set").agg(
        F.first("n").alias("n"), F.first("parity").alias("parity")))
    star = buckets.select("set", F.explode(F.array("i0", "i1", "p0", "p1")).alias("centre")).where("set <> centre").select(
        F.least("set", "centre").alias("a"), F.greatest("set", "centre").alias("b")).distinct()
    links = _verified(_likely(star, facts), docs, known, id_column, text_column)
    label = components(links)
    # what the centres have not joined; first such pairs as would join components, then all that are left
    rest = buckets.where("members > 2").select("key", "set", "members")
    for tree in (True, False):
        more = _across(rest, facts, label, tree)
        if more.isEmpty():
            break
        links = cut_lineage(links.union(_verified(more, docs, known, id_column, text_column)))
        label = components(links)
    of = known.join(cut_lineage(label), (F.col("set") == F.col("node")) & (F.col("n") > 0), "left").select(
        "d", "id", "n", F.coalesce("label", "set").alias("group"), *["s"] * (kind == "document"))
    return cut_lineage(of)


def near_duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``d, id, n_shingles, component_id`` of every row; component_id is the smallest id reachable by links.

    Texts without words, null and empty texts have no shingles and link with nothing, not even each other. Repeated rows
    link by their equal sets, unless they have none. A null id is the largest: a component's id is null only if it holds
    no other id. An empty table gives an empty result; other columns are not read.
    """
    of = _grouped(docs, id_column, text_column, "identity")
    least = cut_lineage(of.where("n > 0").groupBy("group").agg(F.min("id").alias("least")))
    return of.join(least.withColumnRenamed("group", "g"), (F.col("group") == F.col("g")) & (F.col("n") > 0), "left").select(
        "d", "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component of near duplicates, with all its columns; rows without shingles all stay.

    The row with the smallest id stays, null ids last; rows of one id or of no id are told apart by the hash of their text,
    and the smallest stays. Of rows that repeat both, any one stays.
    """
    of = _grouped(docs, id_column, text_column, "document").where("n > 0")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "s")
    best = cut_lineage(of.groupBy("group").agg(F.min(rank).alias("best"), F.count("*").alias("rows")).where("rows > 1").select(
        F.col("group").alias("g"), F.coalesce(F.concat(F.lit("="), F.col("best.id").cast("string")), F.lit("-")).alias("best_d"),
        F.col("best.s").alias("best_s")))
    several = cut_lineage(of.join(best, F.col("group") == F.col("g")).select(
        F.col("d").alias("key_d"), F.col("s").alias("key_s"), ((F.col("d") == F.col("best_d")) & (F.col("s") == F.col("best_s"))).alias("best")))
    several = cut_lineage(several.groupBy("key_d", "key_s").agg(F.first("best").alias("best"), F.count("*").alias("rows")))
    free_shuffles(docs.sparkSession)
    names = [f"row_{i}" for i in range(len(docs.columns))]
    keyed = docs.select(id_key(id_column).alias("d"), _text_key(text_column).alias("s"),
                        *[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)])
    same = (F.col("d") == F.col("key_d")) & (F.col("s") == F.col("key_s"))
    gone = several.where("not best or rows > 1").select("key_d", "key_s")
    left = keyed.join(gone, same, "left_anti").select(*names)
    repeated = several.where("best and rows > 1").select("key_d", "key_s")
    if not repeated.isEmpty():
        once = keyed.join(repeated, same, "left_semi").groupBy("d", "s").agg(F.first(F.struct(*names)).alias("row"))
        left = left.union(once.select(*[F.col(f"row.{a}") for a in names]))
    return left.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names)])

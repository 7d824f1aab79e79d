"""Packing documents into sequences of a fixed number of tokens by bound-certified best-fit decreasing.

Pieces shorter than a sequence are dealt by hash into groups of bounded size. Each group packs its pieces by best fit in
decreasing order and works out a lower bound of its sequences with dual feasible functions. A group that meets its bound
is proved best and done. The others keep the sequences that are full and exchange the rest: those pieces are dealt anew
among fewer groups and packed again, as long as that saves sequences. A group holds ``group_pieces`` pieces on average
whatever the size of the input, so a task's memory is bounded; rows are spread by hash, so nothing is hot.
"""

from __future__ import annotations

import bisect
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm.texts import text_of
from stallkeeper.llm.tokenize import TOKENIZER, byte_bpe
from stallkeeper.session import cut_lineage

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 8192
ROUNDS = 6


def split_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of n tokens: only a longer one is cut, and its first piece may be shorter."""
    if n <= capacity:
        return [n]
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of the dual feasible functions u_k: pieces over capacity - k fill a bin, those under k vanish."""
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    k = np.arange(1, capacity // 2 + 1)
    big, half = capacity - k, capacity // 2
    whole = number[capacity] - number[big]
    upper, upper_sum = number[big] - number[half], total[big] - total[half]
    lower_sum = np.where(k <= half, total[half] - total[k - 1], 0)
    rest = np.maximum(0, -(-(lower_sum - (upper * capacity - upper_sum)) // capacity))
    return int(max((whole + upper + rest).max(initial=0), -(-int(total[capacity]) // capacity)))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in the bin, and what the bin holds in the end, for each piece; longest pieces first."""
    order = np.argsort(-lengths, kind="stable")
    where, offset, free, open_ = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), [], {}
    rooms: list[int] = []  # the distinct free spaces of open bins, in order
    for i in order.tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
        else:
            b, room = len(free), capacity
            free.append(capacity)
        where[i], offset[i], free[b] = b, capacity - room, room - n
        if left := room - n:
            if left not in open_:
                bisect.insort(rooms, left)
                open_[left] = []
            open_[left].append(b)
    return where, offset, capacity - np.array(free, np.int64)[where]


def token_pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
                 tokenizer: str = TOKENIZER, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` (and ``ids``) of every piece of every document, the end id included."""
    rows = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))
    fields = [rows.schema["id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def cut(batches):
        encoder = byte_bpe(tokenizer, folder)
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.array([*encoder.ids(text.as_py()), END_ID], "<u4")
                at = 0
                for k, n in enumerate(split_lengths(len(ids), capacity)):
                    part = ids[at : at + n]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        kept.append(part.astype(np.int32))
                    at += n
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            columns += [pa.array(kept, pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return rows.mapInArrow(cut, T.StructType(fields))


def _packed(pieces: DataFrame, groups: int, seed: int, capacity: int) -> DataFrame:
    """One round: every piece with its bin, place, what the bin holds, and the group's bins and bound."""
    added = ["bin", "offset", "used", "bins", "bound"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("g", T.LongType()), *(T.StructField(c, T.LongType()) for c in added)])

    def pack(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        where, offset, used = best_fit(lengths, capacity)
        n = len(lengths)
        values = (where, offset, used, np.full(n, where.max() + 1), np.full(n, lower_bound(lengths, capacity)))
        for name, v in zip(added, values):
            group = group.append_column(name, pa.array(v, pa.int64()))
        return group

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(groups)).cast("long"))
    return cut_lineage(dealt.groupBy("g").applyInArrow(pack, schema))


def _bins(packed: DataFrame, capacity: int) -> tuple[int, int]:
    """Sequences in all and sequences to be released, of one round."""
    row = packed.groupBy("g", "bin").agg(F.max(F.col("bins") > F.col("bound")).alias("gap"), F.max("used").alias("used")).agg(
        F.count("*").alias("all"), F.count_if((F.col("gap")) & (F.col("used") < capacity)).alias("loose")).first()
    return row["all"], row["loose"]


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY,
         tokenizer: str = TOKENIZER, folder: str | None = None, with_ids: bool = False,
         group_pieces: int = GROUP_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece.

    Null and empty texts are one piece that holds the end id alone. Repeated rows and repeated ids are packed as often as
    they occur; null ids stay null. An empty table gives an empty result; other columns are not read.
    """
    pieces = token_pieces(docs, id_column, text_column, capacity, tokenizer, folder, with_ids)
    pieces = cut_lineage(pieces.withColumn("key", F.monotonically_increasing_id()))
    columns = [c for c in pieces.columns if c != "key"]
    done = [pieces.where(F.col("length") == capacity).select(*columns, (-F.col("key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]

    def placed(packed: DataFrame, seed: int) -> DataFrame:
        number = F.lit(seed) * F.lit(2**58) + F.col("g") * F.lit(2**24) + F.col("bin")
        return packed.select(*columns, number.alias("sequence_id"), "offset")

    open_ = pieces.where(F.col("length") < capacity)
    before, last = None, None  # the loose sequences of the round before, and its packing of the same pieces
    for seed in range(rounds):
        groups = max(1, -(-open_.count() // group_pieces))
        now = _packed(open_, groups, seed, capacity)
        everything, loose = _bins(now, capacity)
        if before is not None and everything >= before:
            done.append(placed(last, seed - 1))
            break
        gap = F.col("bins") > F.col("bound")
        if loose == 0 or groups == 1 or seed == rounds - 1:
            done.append(placed(now, seed))
            break
        release = gap & (F.col("used") < capacity)
        done.append(placed(now.where(~release), seed))
        last, before = now.where(release), loose
        open_ = last.select(*pieces.columns)
    return reduce(DataFrame.union, done)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of a packing made with_ids; a sequence is no longer than its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))

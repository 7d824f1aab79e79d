"""Document quality from a linear-chain conditional random field over lines.

Every line has features of its own and of its neighbours; the chain labels each line good or bad. A document's score is
the mean of its lines' forward-backward marginals of "good", weighted by their length. Lines learn from the label of
their document, on a bounded sample of labelled documents (``sample_docs`` per class, those with the smallest hashes);
scoring covers every line of every text and happens inside the tasks that read them, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm import bytewords
from stallkeeper.llm.texts import text_of
from stallkeeper.session import cut_lineage

SAMPLE_DOCS = 2000
SAMPLE_LINES = 60_000
STEPS = 300
THRESHOLD = 0.7
OWN = 9  # features of a line by itself, those of its neighbours follow

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _HIGH = range(6)


def _class_table() -> np.ndarray:
    kind = np.full(256, 255, np.uint8)
    for k, chars in ((_UPPER, range(65, 91)), (_LOWER, range(97, 123)), (_DIGIT, range(48, 58)), (_SYMBOL, b"#*$%&|<>~^_=+{}[]\\"),
                     (_BANG, b"!?"), (_HIGH, range(128, 256))):
        kind[list(chars)] = k
    return kind


KIND = _class_table()


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x features), length in bytes and document of every line; lines without a word are left out."""
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(np.concatenate([[0], breaks + 1]), offsets[:-1])
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.empty((0, 3 * OWN), np.float32), np.empty(0), np.empty(0, np.int64)
    ends = np.append(starts[1:], len(data))
    size = (ends - starts).astype(np.float64)
    kind = KIND[data]
    part = [np.add.reduceat(kind == k, starts, dtype=np.int64) for k in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _HIGH)]
    upper, lower, digit, symbol, bang, high = part
    words, first, _ = bytewords.word_hashes(data, offsets)
    line_of = np.searchsorted(starts, first, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of, again, len(starts))
    some = n_words > 0
    doc = np.searchsorted(offsets, starts, "right") - 1
    # a line equal to an earlier one of its document
    content = np.zeros(len(starts), np.uint64)
    turn = (np.arange(len(words)) - np.searchsorted(line_of, line_of)).astype(np.uint64)
    np.add.at(content, line_of, bytewords.mix(words + turn))
    order = np.lexsort((np.arange(len(starts)), content, doc))
    copy = np.zeros(len(starts), bool)
    copy[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    letters = np.maximum(1, upper + lower)
    own = np.stack([
        np.minimum(1, upper / letters) * 4, symbol / size * 20, bang / size * 20, digit / size * 10,
        repeats / np.maximum(1, n_words) * 4, copy * 1.0, np.log1p(n_words) / 3,
        np.minimum(3, size / np.maximum(1, n_words) / 8), high / size * 2,
    ], 1).astype(np.float32)[some]
    doc, size = doc[some], size[some]
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = doc[1:] == doc[:-1]
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.concatenate([own, before, after], 1), size, doc


@dataclass(frozen=True)
class Crf:
    """Weights of state "good" against "bad", and the log-potentials of staying and changing."""

    weights: np.ndarray
    bias: float
    stay: float
    prior: float

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The probability of "good" for each line given its whole document."""
        return _chains(x @ self.weights + self.bias, doc, self.stay)[0]

    def scores(self, x: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        total = np.bincount(doc, size, n)
        good = np.bincount(doc, size * self.marginals(x, doc), n)
        return np.where(total > 0, good / np.maximum(total, 1), self.prior)


def _chains(unary: np.ndarray, doc: np.ndarray, stay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good", probability that a line agrees with the line before, and each line's share of log Z.

    Messages are log-odds of "good" and pass through all documents in step, longest first.
    """
    n = len(unary)
    if not n:
        return np.empty(0), np.empty(0), np.empty(0)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    through = lambda m: np.logaddexp(stay + m, 0) - np.logaddexp(m, stay)  # noqa: E731  log-odds after one step
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), "right")
    ahead, back = np.zeros(n), np.zeros(n)
    for t in range(1, length[0]):
        at = first[: active[t]] + t
        ahead[at] = through(ahead[at - 1] + unary[at - 1])
    for t in range(length[0] - 2, -1, -1):
        at = first[: active[t + 1]] + t
        back[at] = through(back[at + 1] + unary[at + 1])
    odds = unary + ahead + back
    good = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
    agree, logz = np.zeros(n), np.zeros(n)
    later = np.ones(n, bool)
    later[first] = False
    i = np.flatnonzero(later)
    left, right = (ahead + unary)[i - 1], (unary + back)[i]
    both = np.logaddexp(stay, stay + left + right)
    agree[i] = np.exp(both - np.logaddexp(both, np.logaddexp(left, right)))
    # the forward messages' normalisers add up to log Z
    m = (ahead + unary)[i - 1]
    logz[i] = np.logaddexp(m, stay)
    last = first + length - 1
    logz[last] += np.logaddexp(0, (ahead + unary)[last])
    return good, agree, logz


def fit(x: np.ndarray, doc: np.ndarray, good: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Crf:
    """Weights that maximise the likelihood of the lines' labels."""
    n = len(good)
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if n else np.empty(0, bool)
    docs = np.bincount(doc[first], good[first]) if n else np.empty(0)
    prior = (docs.sum() + 1) / (first.sum() + 2)
    if not n or good.min() == good.max():
        return Crf(np.zeros(x.shape[1]), float(np.log(prior / (1 - prior))), 0.0, float(prior))
    y = good.astype(float)
    same = np.concatenate([[True], good[1:] == good[:-1]]).astype(float)
    w = np.zeros(x.shape[1] + 2)  # features, bias, stay
    speed, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        p, agree, _ = _chains(x @ w[:-2] + w[-2], doc, w[-1])
        gap = y - p
        slope = np.concatenate([x.T @ gap, [gap.sum()], [(same - agree)[~first].sum()]]) / n - ridge * w
        speed = 0.9 * speed + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        w += 0.1 * (speed / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Crf(w[:-2], float(w[-2]), float(w[-1]), float(prior))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text"))


def _fitting(sizes: list[tuple[int, int]], most: int) -> list[int]:
    """Which of the documents (class, lines) are taken, in order: in half of the lines for each class, then in what is left."""
    taken, left = set(), most
    for label in sorted({label for label, _ in sizes}):
        room = most // 2
        for k, (of, n) in enumerate(sizes):
            if of == label and n <= room:
                taken.add(k)
                room, left = room - n, left - n
    for k, (_, n) in enumerate(sizes):
        if k not in taken and n <= left:
            taken.add(k)
            left -= n
    return sorted(taken)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          label_column: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Crf:
    """Fit on at most sample_docs labelled documents of each class and sample_lines lines; features, not texts, are collected.

    An id with several labels has the largest. Null labels are passed over. A document that doesn't fit into what is left
    of the lines is passed over and others follow. With one class only, every line gets that class's smoothed share. If
    two classes were labelled and lines of one only fit, that is an error.
    """
    marks = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("key")).agg(F.max(label_column).alias("label"))
    sample = [marks.where(F.col("label") == k).orderBy(F.xxhash64(F.col("key")), "key").limit(sample_docs) for k in (0, 1)]
    chosen = sample[0].union(sample[1])
    texts = _rows(docs, id_column, text_column).join(F.broadcast(chosen), F.col("id") == F.col("key")).select(
        F.xxhash64("id").alias("h"), F.col("label").cast("int").alias("label"), "text")

    def features(batches):
        for batch in batches:
            for begin, data, offsets in bytewords.chunks(batch.column("text")):
                x, _, doc = line_features(data, offsets)
                n = len(offsets) - 1
                edge = np.searchsorted(doc, np.arange(n + 1))
                part = batch.slice(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [part.column("h"), part.column("label"),
                     pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], names=["h", "label", "x"])

    # stored first: all partitions are read at once, and the driver learns the sizes before it takes any features
    found = cut_lineage(texts.mapInArrow(features, "h long, label int, x binary"))
    sizes = found.groupBy("h", "label").agg(F.sum(F.octet_length("x") / F.lit(12 * OWN)).cast("long").alias("n")).orderBy("h", "label").collect()
    fit_in = _fitting([(r["label"], r["n"]) for r in sizes], sample_lines)
    if len({r["label"] for r in sizes}) > 1 and len({sizes[k]["label"] for k in fit_in if sizes[k]["n"]}) < 2:
        raise ValueError("two classes are labelled, but lines of one at most fit into the sample; raise sample_lines")
    rows = found.sparkSession.createDataFrame([(sizes[k]["h"], sizes[k]["label"]) for k in fit_in], "h long, label int")
    taken = found.join(F.broadcast(rows), ["h", "label"], "left_semi")
    kept = sorted(((r["h"], r["label"], bytes(r["x"])) for r in taken.toLocalIterator()))
    kept = [(label, np.frombuffer(x, np.float32).reshape(-1, 3 * OWN)) for _, label, x in kept]
    doc = np.repeat(np.arange(len(kept)), [len(x) for _, x in kept]) if kept else np.empty(0, np.int64)
    good = np.repeat([label for label, _ in kept], [len(x) for _, x in kept]) if kept else np.empty(0, np.int64)
    return fit(np.concatenate([x for _, x in kept]) if kept else np.empty((0, 3 * OWN), np.float32), doc, good)


def score(docs: DataFrame, model: Crf, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row with all its columns and ``quality_score``, 0 to 1; a text without words gets the training share."""
    names = [f"row_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)], text_of(text_column).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("quality_score", T.DoubleType())])

    def work(batches):
        for batch in batches:
            out = [np.empty(0)]
            for _, data, offsets in bytewords.chunks(batch.column("text")):
                x, size, doc = line_features(data, offsets)
                out.append(model.scores(x, size, doc, len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=schema.names)

    scored = rows.mapInArrow(work, schema)
    return scored.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names)], "quality_score")


def is_held_out(id_column: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(4)) == 2

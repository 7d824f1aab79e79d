"""Toxicity of documents from a classifier that is held to give a sentence and its counterfactual the same score.

A document's log-odds are a bias and the weights of the distinct words and word beginnings that it holds, one weight for
holding it and one more for holding it twice or more.
The weights minimise the logistic loss of labelled documents, an absolute (sparsity) penalty, and for every sentence of
theirs that names a group the squared change of its log-odds when the group's name is swapped for each other name of the
same kind. A name that only happened to stand in toxic documents so loses its weight, and neutral mentions of a group keep
a low score; what is said about the group keeps its weights.

The fit uses a bounded sample of labelled documents: those with the smallest hashes, at most ``SAMPLE_DOCS`` of a class.
Features in fewer than ``MIN_DOCS`` of them are left out, and of the others the ``MAX_FEATURES`` that tell the classes apart
best stay. Scoring covers every word of every text, inside the tasks that read them, without a shuffle.

Null and empty texts, and texts without known words, get the bias alone, the share of toxic documents among those without any
sign. Very long texts are read whole, in pieces. Repeated rows are scored alike, and a repeated id of a label counts as
toxic if any of its rows is. Null labels and labels of ids that no document has are passed over. A fit without documents of
both classes is an error. Empty tables of documents have no scores. Other columns, whatever their names, come back unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm import bytewords
from stallkeeper.llm.texts import text_of
from stallkeeper.session import cut_lineage

SAMPLE_DOCS = 4000
MIN_DOCS = 3
MAX_FEATURES = 4096
SWAP_WEIGHT = 1.0
SPARSITY = 2e-4
STEPS = 600
THRESHOLD = 0.3

#: names of groups by kind; a name is swapped for the others of its kind
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "american"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
)
PREFIXES = (4, 5, 6, 7)  # bytes of a word's beginning

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ONCE = np.uint64(2**64 - 2)
_SENTENCE_END = re.compile(r"[.!?\n]+")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit feature) of each word (letters and digits, A-Z as a-z) and of each word's beginnings.

    Features are even; the odd number after one stands for holding it twice or more. Features that a text repeats are repeated here. Long texts are worked off in segments that end between words.
    """
    letter = _LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    where, found, a = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    codes = bytewords._byte_codes()
    while a < len(data):
        b = min(len(data), a + bytewords.SEGMENT)
        while b < len(data) and letter[b]:
            gap = np.flatnonzero(~letter[b : b + bytewords.SEGMENT])
            b = min(len(data), b + (int(gap[0]) if len(gap) else bytewords.SEGMENT))
        inside, cut = letter[a:b], edge[a : b + 1]
        start = np.flatnonzero(inside & ~(np.concatenate([[False], inside[:-1]]) & ~cut[:-1]))
        end = np.flatnonzero(inside & ~(np.concatenate([inside[1:], [False]]) & ~cut[1:])) + 1
        text = np.searchsorted(offsets, start + a, "right") - 1
        up, down = bytewords._powers(1 << max(16, int(b - a).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes[data[a:b]] * up[: b - a])])
        for kind in (0, *PREFIXES):
            some = slice(None) if not kind else end - start >= kind
            first, last = start[some], end[some] if not kind else start[some] + kind
            seed = np.uint64((kind + 1) * 0x9E3779B97F4A7C15 % 2**64)
            found.append(bytewords.mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) + seed) & _ONCE)
            where.append(text[some])
        a = b
    return np.concatenate(where), np.concatenate(found)


def _distinct(where: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once, and the odd one after it where the text holds it twice or more."""
    order = np.lexsort((found, where))
    where, found = where[order], found[order]
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:] == found[:-1]) & (where[1:] == where[:-1])
    second = again.copy()
    second[1:] &= ~again[:-1]
    where, found = np.concatenate([where[~again], where[second]]), np.concatenate([found[~again], found[second] | np.uint64(1)])
    order = np.lexsort((found, where))
    return where[order], found[order]


def features_of(text: str) -> set[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return set(_distinct(*features(raw, np.array([0, len(raw)])))[1].tolist())


def counterfactuals(text: str, kinds=IDENTITY_TERMS) -> list[tuple[list[int], list[int]]]:
    """For each sentence that names a group, and each other name of that kind: the features lost and those won by the swap."""
    kind_of = {name: kind for kind in kinds for name in kind}
    out = []
    for sentence in _SENTENCE_END.split(text):
        words = re.findall(r"[^\W_]+", sentence)
        for name in sorted({w.lower() for w in words} & kind_of.keys()):
            own = features_of(sentence)
            for other in kind_of[name]:
                if other != name:
                    swapped = features_of(re.sub(rf"(?<![^\W_]){re.escape(name)}(?![^\W_])", other, sentence, flags=re.IGNORECASE))
                    out.append((sorted(own - swapped), sorted(swapped - own)))
    return out


@dataclass(frozen=True)
class Model:
    """Even features in ascending order, the weights of holding each and of holding it again, and the bias."""

    names: np.ndarray
    once: np.ndarray
    twice: np.ndarray
    bias: float

    def log_odds(self, where: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts, from their features, repeated as the texts repeat them."""
        k = len(self.names)
        if not k:
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.names, found), k - 1)
        hit = self.names[at] == found
        pairs, times = np.unique(where[hit] * k + at[hit], return_counts=True)
        return self.bias + np.bincount(pairs // k, self.once[pairs % k] + (times > 1) * self.twice[pairs % k], n)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(*features(data, offsets), len(offsets) - 1)))

    def score_text(self, text: str) -> float:
        raw = np.frombuffer(text.encode(), np.uint8)
        return float(self.scores(raw, np.array([0, len(raw)]))[0])


def _model(names: np.ndarray, weights: np.ndarray, bias: float) -> Model:
    """From one weight for each even or odd feature."""
    kept = weights != 0
    names, weights = names[kept], weights[kept]
    even, at = np.unique(names & _ONCE, return_inverse=True)
    odd = (names & np.uint64(1)).astype(bool)
    return Model(even, np.bincount(at[~odd], weights[~odd], len(even)), np.bincount(at[odd], weights[odd], len(even)), bias)


def fit(rows: list[tuple[np.ndarray, int, float]], swaps: list[tuple[tuple[int, ...], tuple[int, ...], int]], names: np.ndarray,
        swap_weight: float = SWAP_WEIGHT, sparsity: float = SPARSITY, steps: int = STEPS) -> Model:
    """Weights over ``names`` (ascending) by accelerated proximal steps.

    rows: (columns of the document's features, label, weight). swaps: (columns lost, columns won, sentences) each.
    """
    label = np.array([y for _, y, _ in rows], float)
    share = np.array([s for _, _, s in rows], float)
    share /= share.sum()
    doc = np.repeat(np.arange(len(rows)), [len(x) for x, _, _ in rows])
    col = np.concatenate([x for x, _, _ in rows]) if rows else np.empty(0, np.int64)
    times = np.array([n for *_, n in swaps], float) / max(1, sum(n for *_, n in swaps))
    swap = np.repeat(np.arange(len(swaps)), [len(a) + len(b) for a, b, _ in swaps])
    at = np.array([c for a, b, _ in swaps for c in (*a, *b)], np.int64)
    sign = np.array([s for a, b, _ in swaps for s in (*[-1.0] * len(a), *[1.0] * len(b))])
    k = len(names)
    # the largest curvature, by power iteration
    v = np.ones(k + 1)
    for _ in range(30):
        v /= np.linalg.norm(v)
        along = share * (v[-1] + np.bincount(doc, v[col], len(rows)))
        v = 0.25 * np.append(np.bincount(col, along[doc], k), along.sum())
    bend = np.full(k + 1, 1.2 * float(np.linalg.norm(v)) + 1e-6)
    if len(swaps):  # a name's own curvature: (sum of n terms)^2 is at most n times the sum of their squares
        bend[:k] += 2 * swap_weight * np.bincount(at, (times * np.bincount(swap, minlength=len(swaps)))[swap], k)
    w, last, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    prior = float((label * share).sum())
    w[-1] = last[-1] = np.log(prior / (1 - prior))
    for _ in range(steps):
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = w + (t - 1) / t_next * (w - last)
        odds = ahead[-1] + np.bincount(doc, ahead[col], len(rows))
        gap = share * (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - label)
        slope = np.append(np.bincount(col, gap[doc], k), gap.sum())
        if len(swaps):
            change = np.bincount(swap, sign * ahead[at], len(swaps))
            slope[:k] += 2 * swap_weight * np.bincount(at, sign * (times * change)[swap], k)
        new = ahead - slope / bend
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - sparsity / bend[:k])
        last, w, t = w, new, t_next
    return _model(names, w[:k], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
          kinds=IDENTITY_TERMS, sample_docs: int = SAMPLE_DOCS, min_docs: int = MIN_DOCS, max_features: int = MAX_FEATURES,
          swap_weight: float = SWAP_WEIGHT, sparsity: float = SPARSITY, steps: int = STEPS) -> Model:
    """Fit on at most ``sample_docs`` labelled documents of each class; what is collected is bounded by them and max_features.

    Documents of a class that is sampled weigh as all that are labelled do, so that scores are probabilities.
    """
    marks = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(
        F.col(id_column).alias("key")).agg(F.max(label_column).cast("int").alias("label"))
    marks = cut_lineage(marks.join(docs.select(F.col(id_column).alias("key")), "key", "left_semi"))
    of_class = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if set(of_class) != {0, 1}:
        raise ValueError(f"the fit needs labelled documents of both classes; found {of_class}")
    chosen = marks.where("label = 0").orderBy(F.xxhash64("key"), "key").limit(sample_docs).union(
        marks.where("label = 1").orderBy(F.xxhash64("key"), "key").limit(sample_docs))
    texts = docs.select(F.col(id_column).alias("id"), text_of(text_column).alias("text")).join(
        F.broadcast(chosen), F.col("id") == F.col("key")).groupBy("key", "label").agg(F.min("text").alias("text"))

    def described(batches):
        for batch in batches:
            for begin, data, offsets in bytewords.chunks(batch.column("text")):
                n = len(offsets) - 1
                where, found = _distinct(*features(data, offsets))
                edge = np.searchsorted(where, np.arange(n + 1))
                part = batch.slice(begin, n)
                signed = found.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), part.column("label"), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(signed)),
                    pa.array([[{"lost": _signed(a), "won": _signed(b)} for a, b in counterfactuals(t, kinds)] for t in part.column("text").to_pylist()],
                             pa.list_(pa.struct([("lost", pa.list_(pa.int64())), ("won", pa.list_(pa.int64()))]))),
                ], names=["key", "label", "found", "swaps"])

    key_type = texts.schema["key"].dataType.simpleString()
    sample = cut_lineage(texts.mapInArrow(
        described, f"key {key_type}, label int, found array<long>, swaps array<struct<lost: array<long>, won: array<long>>>"))
    swaps = [(r["lost"], r["won"], r["n"]) for r in sample.select(F.explode("swaps").alias("s")).groupBy("s.lost", "s.won").agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "lost", "won").limit(max_features).collect()]
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        raise ValueError(f"the fit needs labelled documents of both classes; found {sizes}")
    a, b = sizes[1], sizes[0]
    held = sample.select("label", F.explode("found").alias("f")).groupBy("f").agg(
        F.sum("label").alias("x"), F.sum(1 - F.col("label")).alias("y")).where(F.col("x") + F.col("y") >= min_docs)
    # how far a feature's share in one class is from that in the other, in standard deviations
    both = (F.col("x") + F.col("y") + 1) / (a + b + 2)
    apart = F.abs((F.col("x") + 0.5) / (a + 1) - (F.col("y") + 0.5) / (b + 1)) / F.sqrt(both * (1 - both) + 1e-9)
    best = [r["f"] for r in held.orderBy(F.desc(apart), "f").limit(max_features).collect()]
    names = np.unique(np.array(best + [f for lost, won, _ in swaps for f in (*lost, *won)], np.int64).view(np.uint64))
    at = {int(f): i for i, f in enumerate(names.tolist())}
    wanted = sample.sparkSession.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in names.tolist()], "f long")
    pairs = sample.select("key", "label", F.explode("found").alias("f")).join(F.broadcast(wanted), "f", "left_semi")
    rows = sample.select("key", "label").join(pairs.groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("f")), "key", "left").orderBy(F.xxhash64("key"), "key")
    weight = {label: of_class[label] / sizes[label] for label in (0, 1)}
    place = lambda fs: np.array(sorted(at[int(f) & (1 << 64) - 1] for f in fs or ()), np.int64)
    return fit([(place(r["f"]), r["label"], weight[r["label"]]) for r in rows.collect()],
               [(tuple(place(lost)), tuple(place(won)), n) for lost, won, n in swaps], names, swap_weight, sparsity, steps)


def _signed(found: list[int]) -> list[int]:
    return np.array(found, np.uint64).view(np.int64).tolist()


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """Every row with all its columns and ``toxicity``, 0 to 1."""
    names = [f"row_{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, names)], text_of(text_column).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("toxicity", T.DoubleType())])

    def work(batches):
        for batch in batches:
            out = [np.empty(0)]
            for _, data, offsets in bytewords.chunks(batch.column("text")):
                out.append(model.scores(data, offsets))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=schema.names)

    scored = rows.mapInArrow(work, schema)
    return scored.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, names)], "toxicity")

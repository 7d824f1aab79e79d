"""A word language model with a gated recurrent unit and a class-factored output, in numpy.

Every word type belongs to a class, given by its first bytes. A class has a slot for each of its frequent words and one
for its tail. A text's probability is the product over its words of p(class | history), p(slot | class, history) and,
for a tail word, its smoothed unigram share of the class's tail, unknown words included; it thus covers an open
vocabulary. The history is the state of the unit, which is carried from window to window through a whole document, in
training (truncated backpropagation) and in scoring. Before training the model equals the unigram model.

Word counts cover all training documents. Weights are warmed up on a bounded sample of them and then trained further in
every partition on all of its training documents (one in ``share``) and averaged, so training grows with the corpus.
Words are looked up once: training and scoring read the stored slots of each text.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm.texts import text_of
from stallkeeper.session import cut_lineage, free_shuffles

HEAD_SHARE = 2**18  # a word is in the head, whose counts every task holds, if it is one in so many tokens or more
SLOTS = 2_048  # of these, words the output layer tells apart
CLASSES = 48
HIDDEN = 24
WINDOW = 24
TRAIN_TOKENS = 2_500_000  # a task trains on texts of about so many tokens at a time
SCORE_TOKENS = 2_000_000  # and scores so many
LOOK_UP_TOKENS = 200_000  # words that are held as words at a time
CLASS_PASS = 16_384  # states that one pass over the classes scores
KEPT_BYTES = 2**24  # more than half of what the arrays of a window take
SAMPLE_DOCS = 600
SAMPLE_WORDS = 400_000
SHARE = 1  # one in so many training documents is trained on in its partition: all of them
SMALL = np.min_scalar_type(SLOTS + CLASSES)  # holds the number of every slot
END = b""  # no word is empty, so this stands for the end of a text
LN10 = float(np.log(10))


def split_words(text: bytes) -> list[bytes]:
    """Words between white space (tab to carriage return, space), A-Z in lower case; other letters are left alone."""
    return text.lower().split()


def keep_freed_memory() -> None:
    """Let the C library keep the memory of a window's arrays for the next window's.

    It otherwise gives that back to the system and gets it anew, page by page, in every window, which takes a third of the
    time. After a block has been freed glibc keeps up to twice the size of that block; this one is never written to, so
    it takes no memory itself. Elsewhere it does nothing.
    """
    np.empty(KEPT_BYTES, np.uint8)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[:3]) % CLASSES


def in_training(id_column: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))), F.lit(5)) != 1


@dataclass
class Vocabulary:
    """What every task needs of the counts: N, V, the frequent words with their counts, and the mass of each class's tail."""

    tokens: int
    types: int
    head: dict[bytes, int]
    counts: np.ndarray
    mass: np.ndarray  # per class, of all its words outside SLOTS and of one unknown word, half a count added to each
    slot_class: np.ndarray = field(init=False)
    slot_start: np.ndarray = field(init=False)
    slot_of: np.ndarray = field(init=False)
    head_class: np.ndarray = field(init=False)

    def __post_init__(self):
        words = list(self.head)
        self.head_class = np.array([word_class(w) for w in words], np.int64)
        slotted = self.head_class[:SLOTS]
        number = np.bincount(slotted, minlength=CLASSES) + 1  # the tail is the last slot of its class
        self.slot_start = np.concatenate([[0], np.cumsum(number)])
        order = np.argsort(slotted, kind="stable")
        self.slot_of = np.empty(len(slotted), np.int64)
        within = np.arange(len(slotted)) - np.searchsorted(slotted[order], slotted[order])
        self.slot_of[order] = self.slot_start[slotted[order]] + within
        self.slot_class = np.repeat(np.arange(CLASSES), number)

    def tail_slot(self, classes):
        return self.slot_start[np.asarray(classes) + 1] - 1

    def slots(self, texts: list[list[bytes]]) -> Slots:
        """Of all words and ends of the texts, in a row."""
        flat = []
        for text in texts:
            flat += text
            flat.append(END)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        at = np.fromiter(map(self.head.get, flat, repeat(-1)), np.int64, len(flat))
        slot = np.empty(len(at), np.int64)
        known = at >= 0
        front = known & (at < SLOTS)
        slot[front] = self.slot_of[at[front]]
        rest = known & ~front
        slot[rest] = self.tail_slot(self.head_class[at[rest]])
        places = np.flatnonzero(~known)
        out = [flat[i] for i in places.tolist()]
        of = {}
        classes = np.fromiter((of[p] if (p := w[:3]) in of else of.setdefault(p, word_class(w)) for w in out), np.int64, len(out))
        slot[places] = self.tail_slot(classes)
        return Slots(edges, slot, at, out, classes, np.searchsorted(edges, places, "right") - 1)


@dataclass
class Slots:
    """Texts as slots: where each begins in the arrays, slots, places in the head (-1: not there), and the words outside
    the head with their classes and texts."""

    edges: np.ndarray
    slot: np.ndarray
    at: np.ndarray
    out: list[bytes]
    classes: np.ndarray
    owner: np.ndarray

    def by_text(self) -> list[np.ndarray]:
        return np.split(self.slot, self.edges[1:-1]) if len(self.edges) > 1 else []

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over the places of each text; every text has its end at least."""
        return np.add.reduceat(values, self.edges[:-1])


class Lanes:
    """Texts dealt end to end to lanes of about equal length, which are read side by side, a step of each at a time.

    A lane is as long as the longest text at least, so there are as many lanes as keep all of them full, ``width`` at most.
    Arrays are steps x lanes, long lanes first: ``target`` is the slot (-1 past a lane's end), ``seen`` the slot before it
    (``start`` where a text begins), ``fresh`` tells where that is. Texts are not cut: the state runs through each.
    """

    def __init__(self, texts: list[np.ndarray], width: int, start: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-self.sizes, kind="stable")
        order = order[self.sizes[order] > 0]
        longest = int(self.sizes[order[0]]) if len(order) else 1
        self.number = max(1, min(width, int(self.sizes.sum()) // longest))
        shortest = [(0, i) for i in range(self.number)]
        lanes: list[list[int]] = [[] for _ in range(self.number)]
        for k in order:
            size, i = heapq.heappop(shortest)
            lanes[i].append(int(k))
            heapq.heappush(shortest, (size + int(self.sizes[k]), i))
        lanes.sort(key=lambda lane: -int(self.sizes[lane].sum()))
        self.lengths = np.array([int(self.sizes[lane].sum()) for lane in lanes])
        shape = (int(self.lengths.max(initial=0)), self.number)
        self.target, self.seen = np.full(shape, -1, np.int32), np.full(shape, start, np.int32)
        self.fresh = np.zeros(shape, bool)
        self.where = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)  # lane and first step of each text
        for i, lane in enumerate(lanes):
            at = 0
            for k in lane:
                text = texts[k]
                self.target[at : at + len(text), i] = text
                self.seen[at + 1 : at + len(text), i] = text[:-1]
                self.fresh[at, i] = True
                self.where[0][k], self.where[1][k] = i, at
                at += len(text)

    def windows(self):
        """First step, step after the last, and number of lanes that are not at their end, of each window."""
        for at in range(0, len(self.target), WINDOW):
            yield at, min(len(self.target), at + WINDOW), int(np.searchsorted(-self.lengths, -at))

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over the places of each text."""
        sums = np.concatenate([np.zeros((1, self.number)), np.cumsum(values, 0)])
        lane, first = self.where
        return sums[first + self.sizes, lane] - sums[first, lane]


def log_shares(rows: np.ndarray, weights: np.ndarray, picked: np.ndarray, blocks: list[tuple[int, int, int, int]], shift: bool,
               slope: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log of each row's share of its picked weight among those of its block, by the exponentials of their products.

    A block is a range of rows and of weights. All blocks' products lie in one array, so that only the products are made
    block by block. With ``slope``, the gradients of the negative sum are added to it, and those of the
    rows are returned.
    """
    widths = np.repeat([high - low for _, _, low, high in blocks], [b - a for a, b, _, _ in blocks])
    lows = np.repeat([low for _, _, low, _ in blocks], [b - a for a, b, _, _ in blocks])
    first = np.cumsum(widths) - widths
    flat, parts, at = np.empty(int(widths.sum()), rows.dtype), [], 0
    for a, b, low, high in blocks:
        size = (b - a) * (high - low)
        parts.append(np.matmul(rows[a:b], weights[low:high].T, out=flat[at : at + size].reshape(b - a, high - low)))
        at += size
    if shift:
        flat -= np.repeat(np.maximum.reduceat(flat, first), widths)
    mine = first + picked - lows
    logs = flat[mine]
    np.exp(flat, out=flat)
    total = np.add.reduceat(flat, first)
    logs -= np.log(total)
    if slope is None:
        return logs, None
    flat[mine] -= total
    scaled, back = rows / total[:, None], np.empty_like(rows)
    for (a, b, low, high), part in zip(blocks, parts):
        slope[low:high] += part.T @ scaled[a:b]
        np.matmul(part, weights[low:high], out=back[a:b])
    back /= total[:, None]
    return logs, back


class Gru:
    """Weights and the passes over windows of lanes."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        v, slots = vocabulary, int(vocabulary.slot_start[-1])
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.start, self.cls, self.cls16 = v.slot_start, v.slot_class, v.slot_class.astype(np.int16)
        self.w = {
            "x": normal(slots + 1, 3 * HIDDEN), "u": normal(HIDDEN, 3 * HIDDEN), "c": normal(HIDDEN, CLASSES) * 0,
            "s": normal(HIDDEN, slots) * 0, "bc": np.zeros(CLASSES, np.float32), "bs": np.zeros(slots, np.float32),
        }
        mass = np.empty(slots)
        mass[v.slot_of] = v.counts[:SLOTS] + 0.5
        mass[v.tail_slot(np.arange(CLASSES))] = v.mass
        self.w["bs"][:] = np.log(mass)
        self.w["bc"][:] = np.log(np.bincount(v.slot_class, mass, CLASSES))
        self.square = {k: np.zeros_like(a) for k, a in self.w.items()}

    @property
    def first(self) -> int:
        """The input before the first word."""
        return len(self.w["x"]) - 1

    def states(self, inputs: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: dict | None = None) -> np.ndarray:
        """States after each step's input, the word before, for inputs (steps x lanes); where ``fresh``, a text begins anew.

        With ``keep``, what the way back needs of every step is put there.
        """
        u, n, x = self.w["u"], HIDDEN, self.w["x"]
        steps, lanes = inputs.shape
        # reset gate, update gate and candidate lie apart, so that every step works on whole arrays
        given = np.empty((3, steps, lanes, n), u.dtype)
        for k, part in enumerate(given):
            np.take(np.ascontiguousarray(x[:, k * n : k * n + n]), inputs, axis=0, out=part, mode="clip")
        out, new, gates = (np.empty((*more, steps, lanes, n), u.dtype) for more in ((), (), (2,)))
        old, linear = (np.empty_like(out) for _ in range(2)) if keep is not None else (None, None)
        begins = [False] * steps if fresh is None else fresh.any(1).tolist()
        product = np.empty((lanes, 3 * n), u.dtype)
        a = product.reshape(lanes, 3, n).transpose(1, 0, 2)
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t][:, None], u.dtype.type(0), h)
            np.matmul(h, u, out=product)
            rz, candidate = gates[:, t], new[t]
            np.add(given[:2, t], a[:2], out=rz)
            np.exp(np.negative(rz, out=rz), out=rz)
            rz += 1
            np.reciprocal(rz, out=rz)
            np.multiply(rz[0], a[2], out=candidate)
            candidate += given[2, t]
            np.tanh(candidate, out=candidate)
            if keep is not None:
                old[t], linear[t] = h, a[2]
            h = np.subtract(h, candidate, out=out[t])
            h *= rz[1]
            h += candidate
        if keep is not None:
            keep.update(old=old, new=new, reset=gates[0], update=gates[1], linear=linear)
        return out

    def log_probs(self, h: np.ndarray, slot: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """log p(class) + log p(slot | class) for each state; with grads, adds the loss's gradients and returns that of h."""
        order = self.by_class(slot)
        logs, back = self._sorted_log_probs(h[order], slot[order], grads)
        undo = np.empty_like(order)
        undo[order] = np.arange(len(order))
        return logs[undo], None if back is None else back[undo]

    def by_class(self, slot: np.ndarray) -> np.ndarray:
        """An order in which the slots of a class lie together."""
        return np.argsort(self.cls16[slot], kind="stable")

    def _sorted_log_probs(self, h: np.ndarray, slot: np.ndarray, grads: dict | None) -> tuple[np.ndarray, np.ndarray | None]:
        w, cls = self.w, self.cls[slot]
        # states lie within -1 and 1, so most weights cannot overflow an exponential and need no shift by the maximum
        bound = max(float(np.abs(w[b]).max() + np.abs(w[a]).sum(0).max()) for a, b in (("c", "bc"), ("s", "bs")))
        shift = bound > 80 or bool(np.abs(h).max(initial=0) > 1)
        one = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)  # the biases' factor
        edges = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        start = self.start.tolist()
        inside = [(edges[k], edges[k + 1], start[k], start[k + 1]) for k in range(CLASSES) if edges[k] < edges[k + 1]]
        logs, back = 0, None if grads is None else np.zeros_like(h)
        for weight, bias, picked, blocks in (("c", "bc", cls, [(0, len(h), 0, CLASSES)]), ("s", "bs", slot, inside)):
            both = np.ascontiguousarray(np.vstack([w[weight], w[bias]]).T)
            slope = None if grads is None else np.zeros_like(both)
            more, by_state = log_shares(one, both, picked, blocks, shift, slope)
            logs = logs + more
            if grads is not None:
                grads[weight] += slope[:, :-1].T
                grads[bias] += slope[:, -1]
                back += by_state[:, :-1]
        return logs, back

    def train(self, texts: list[np.ndarray], width: int = 256, rate: float = 0.08) -> None:
        """One pass of truncated backpropagation through ``width`` lanes of texts, the state carried between windows."""
        keep_freed_memory()
        lay = Lanes(texts, width, self.first)
        h = np.zeros((lay.number, HIDDEN), np.float32)
        for at, end, live in lay.windows():
            h = self._window(lay.seen[at:end, :live], lay.target[at:end, :live], lay.fresh[at:end, :live], h[:live], rate)

    def gradients(self, inputs: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """The summed loss's gradients by every weight but the inputs', by each step's input, and the last state.

        Those by the inputs are steps x lanes x 3 x HIDDEN: of the reset gate, the update gate and the candidate.
        """
        steps, n, u = len(inputs), HIDDEN, self.w["u"]
        keep: dict = {}
        out = self.states(inputs, h, fresh, keep)
        grads = {k: np.zeros_like(a) for k, a in self.w.items() if k != "x"}
        mask = target >= 0
        if mask.all():
            d = self.log_probs(out.reshape(-1, n), target.ravel(), grads)[1].reshape(out.shape)
        else:
            d = np.zeros_like(out)
            d[mask] = self.log_probs(out[mask], target[mask], grads)[1]
        # what each step's gradient is multiplied by on its way to the candidate, the update and the reset gate
        r, z, new = keep["reset"], keep["update"], keep["new"]
        to_new = (1 - z) * (1 - new * new)
        to_update = (keep["old"] - new) * z * (1 - z)
        to_reset = keep["linear"] * r * (1 - r)
        begins = fresh.any(1).tolist()
        dh = np.zeros_like(h)
        # by the reset gate, the update gate and the candidate; and by what the last state brings to each of them
        parts, da = np.empty((3, steps, len(h), n), u.dtype), np.empty((steps, len(h), 3, n), u.dtype)
        back = np.ascontiguousarray(u.T)
        for t in range(steps - 1, -1, -1):
            dh += d[t]
            dn = np.multiply(dh, to_new[t], out=parts[2, t])
            da[t, :, 1] = np.multiply(dh, to_update[t], out=parts[1, t])
            da[t, :, 0] = np.multiply(dn, to_reset[t], out=parts[0, t])
            np.multiply(dn, r[t], out=da[t, :, 2])
            dh *= z[t]
            dh += da[t].reshape(-1, 3 * n) @ back
            if begins[t]:
                dh[fresh[t]] = 0
        grads["u"] += keep["old"].reshape(-1, n).T @ da.reshape(-1, 3 * n)
        return grads, parts.transpose(1, 2, 0, 3), out[-1]

    def _window(self, inputs, target, fresh, h, rate):
        grads, dx, last = self.gradients(inputs, target, fresh, h)
        which = inputs.ravel()
        order = np.argsort(which.astype(SMALL), kind="stable")  # small numbers are sorted by their digits
        rows, first = np.unique(which[order], return_index=True)
        count = max(1, int((target >= 0).sum()))
        for k in grads:
            self._step(self.w[k], self.square[k], grads[k] / count, rate, slice(None))
        by_input = (np.take(dx[:, :, k].reshape(-1, HIDDEN), order, axis=0) for k in range(3))
        slope = np.concatenate([np.add.reduceat(np.ascontiguousarray(a.T), first, axis=1) for a in by_input]).T / count
        self._step(self.w["x"], self.square["x"], slope, rate, rows)
        return last

    @staticmethod
    def _step(weight, square, slope, rate, rows) -> None:
        """Adagrad on the rows that have a gradient, whose size is bounded."""
        g = np.clip(slope, -1, 1) * 32
        square[rows] += g * g
        weight[rows] -= rate * g / (np.sqrt(square[rows]) + np.float32(1e-3))

    def scores(self, texts: list[np.ndarray], width: int = 512) -> np.ndarray:
        """Natural log probability of the slots of each whole text."""
        keep_freed_memory()
        lay = Lanes(texts, width, self.first)
        logs = np.zeros(lay.target.shape)
        h, held, places, waiting = np.zeros((lay.number, HIDDEN), np.float32), [], [], 0
        for at, end, live in lay.windows():
            out = self.states(lay.seen[at:end, :live], h[:live], lay.fresh[at:end, :live])
            inside = lay.target[at:end, :live] >= 0
            step, lane = np.nonzero(inside)
            held.append(out[inside])
            places.append((step + at) * lay.number + lane)
            waiting += len(step)
            h = out[-1]
            if waiting >= CLASS_PASS or end == len(lay.target):  # one pass over the classes for many windows
                place = np.concatenate(places)
                slot = lay.target.ravel()[place]
                sort = self.by_class(slot)
                logs.ravel()[place[sort]], _ = self._sorted_log_probs(np.concatenate(held)[sort], slot[sort], None)
                held, places, waiting = [], [], 0
        return lay.by_text(logs)

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.w.values()])

    def put(self, values: np.ndarray) -> None:
        at = 0
        for k, a in self.w.items():
            self.w[k] = values[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), in_training(id_column).alias("seen"),
                       F.encode(text_of(text_column), "UTF-8").alias("text"))


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``word, cls, n`` over all training documents, the end of a text included; tasks sum before the shuffle."""
    def count(batches):
        from collections import Counter

        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                held.update(split_words(text.as_py()))
                held[END] += 1
                if len(held) > 400_000:
                    yield flush()
        yield flush()

    rows = _rows(docs, id_column, text_column).where("seen").select("text")
    sums = rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.select("word", F.pmod(F.crc32(F.substring("word", 1, 3)), F.lit(CLASSES)).cast("int").alias("cls"), "n")  # word_class


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From stored counts: totals by class, and the head, which has HEAD_SHARE words at most by its definition."""
    sums = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect()
    tokens = sum(r["n"] for r in sums)
    often = counts.where((F.col("n") * HEAD_SHARE >= tokens) | (F.col("word") == END)).select("word", "n").collect()
    head = sorted(((bytes(r["word"]), r["n"]) for r in often), key=lambda x: (-x[1], x[0])) or [(END, 0)]
    # the end of a text has a slot, however rare it is
    place = [w for w, _ in head].index(END)
    if place >= SLOTS:
        head.insert(SLOTS - 1, head.pop(place))
    mass = np.full(CLASSES, 0.5)
    for r in sums:
        mass[r["cls"]] += r["n"] + 0.5 * r["types"]
    for w, n in head[:SLOTS]:
        if n:
            mass[word_class(w)] -= n + 0.5
    return Vocabulary(tokens, sum(r["types"] for r in sums), {w: i for i, (w, _) in enumerate(head)},
                      np.array([n for _, n in head], np.float64), np.maximum(mass, 0.5))


def look_up(docs: DataFrame, words: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each row, its text as slots and what the counts say of it; store it, so that no text is split and looked up again.

    ``id, seen`` (a training document), ``mark`` and ``deal`` (hashes of id and text, and of the text), ``n_tokens``;
    ``n_known``, ``base`` and ``high`` (log10 shares of words without a slot of their own in their class's tail), all three
    of words in the head only; ``other`` (words outside the head and how often they occur) and ``slots`` (int32).
    """
    rows = _rows(docs, id_column, text_column).select(
        "id", "seen", F.xxhash64("id", "text").alias("mark"), F.xxhash64("text").alias("deal"), "text")
    scale = words.tokens + 0.5 * (words.types + 1)
    base = np.log10((words.counts + 0.5) / scale)
    tail = np.log10((words.counts + 0.5) / words.mass[words.head_class])
    tail[:SLOTS] = 0
    far, seen_words = np.log10(words.mass), words.counts > 0
    long, real = T.LongType(), T.DoubleType()
    other = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", long)]))
    fields = [*(rows.schema[c] for c in ("id", "seen", "mark", "deal")), *(T.StructField(c, long) for c in ("n_tokens", "n_known")),
              *(T.StructField(c, real) for c in ("base", "high")), T.StructField("other", other), T.StructField("slots", T.BinaryType())]

    def result(part, texts):
        from collections import Counter

        found = words.slots(texts)
        edges = np.searchsorted(found.owner, np.arange(len(texts) + 1)).tolist()
        others = [Counter(found.out[a:b]) for a, b in zip(edges, edges[1:])]
        inside = found.at >= 0
        held = lambda values: found.sums(np.where(inside, values[found.at], 0))
        high = held(tail) - np.bincount(found.owner, far[found.classes], len(texts))
        flat = pa.StructArray.from_arrays(
            [pa.array([w for o in others for w in o], pa.binary()), pa.array([k for o in others for k in o.values()], pa.int64())], names=["word", "n"])
        places = pa.array(np.concatenate([[0], np.cumsum([len(o) for o in others])]).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in ("id", "seen", "mark", "deal")), pa.array(np.diff(found.edges)), pa.array(held(seen_words.astype(np.int64))),
             pa.array(held(base)), pa.array(high), pa.ListArray.from_arrays(places, flat),
             pa.array([t.astype(np.int32).tobytes() for t in found.by_text()], pa.binary())], names=[f.name for f in fields])

    def work(batches):
        keep_freed_memory()
        for batch in batches:
            texts, waiting, begin = [], 0, 0
            for i, text in enumerate(batch.column("text"), 1):
                texts.append(split_words(text.as_py()))
                waiting += len(texts[-1]) + 1
                if waiting > LOOK_UP_TOKENS or i == len(batch):
                    yield result(batch.slice(begin, i - begin), texts)
                    texts, waiting, begin = [], 0, i

    return rows.mapInArrow(work, T.StructType(fields))


def stored_slots(column) -> list[np.ndarray]:
    return [np.frombuffer(t.as_buffer(), np.int32) for t in column]


def train(docs: DataFrame, words: Vocabulary, id_column: str = "doc_id", text_column: str = "text",
          sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, share: int = SHARE) -> Gru:
    """Warm up on at most sample_docs training documents and sample_words words, then one averaged round over all partitions."""
    found = look_up(docs, words, id_column, text_column).select("seen", "mark", "deal", "slots")
    return train_on(cut_lineage(found), words, sample_docs, sample_words, share)


def train_on(found: DataFrame, words: Vocabulary, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, share: int = SHARE) -> Gru:
    """As ``train``, from the stored rows of ``look_up``."""
    rows = found.where("seen")
    model = Gru(words)
    # the sample is made of the smallest hashes; ids and hashes are sorted, whole texts are not. It is stored before the
    # driver reads it, so that all partitions are searched at once
    chosen = rows.select(F.col("mark").alias("h")).distinct().orderBy("h").limit(sample_docs)
    sample = rows.join(F.broadcast(chosen), F.col("mark") == F.col("h")).select("slots")
    texts, held = [], 0
    for r in cut_lineage(sample).orderBy(F.xxhash64("slots"), "slots").toLocalIterator():
        texts.append(np.frombuffer(r["slots"], np.int32).astype(np.int64))
        held += len(texts[-1])
        if held > sample_words:
            break
    for _ in range(3):
        model.train(texts)
    size = sum(a.size for a in model.w.values())

    def local(batches):
        weight, seen, held = 0, [], 0

        def learn():
            nonlocal weight, seen, held
            model.train(seen, rate=0.03)
            weight, seen, held = weight + held, [], 0

        for batch in batches:
            for text in stored_slots(batch.column("slots")):
                seen.append(text)
                held += len(text)
                if held > TRAIN_TOKENS:
                    learn()
        if seen:
            learn()
        if weight:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(size), pa.int32()), pa.array(model.flat().astype(np.float64) * weight), pa.array(np.full(size, float(weight)))],
                names=["i", "v", "w"])

    part = rows.where(F.pmod("deal", F.lit(share)) == 0).select("slots")
    mean = part.mapInArrow(local, "i int, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
    averaged = mean.toPandas()
    if len(averaged) == size:
        model.put(averaged.sort_values("i")["v"].to_numpy())
    return model


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; both scores are log10.

    The end of a text counts as a token. Null and empty texts are that token alone. Repeated rows are scored each, null ids
    train with the hash of the empty text. Without training documents every word is unknown. An empty table gives an
    empty result; other columns are not read.
    """
    counts = cut_lineage(count_words(docs, id_column, text_column))
    free_shuffles(docs.sparkSession)
    words = vocabulary(counts)
    texts = cut_lineage(look_up(docs, words, id_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    model = train_on(texts, words)
    kept = ("row", "id", "seen", "n_tokens", "n_known", "base")
    rows = texts.select(*kept, "high", "slots")
    fields = [*(rows.schema[c] for c in kept), T.StructField("score", T.DoubleType())]

    def work(batches):
        def result(part):
            logs = model.scores(stored_slots(part.column("slots"))) / LN10 + part.column("high").to_numpy()
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(logs)], names=[f.name for f in fields])

        for batch in batches:
            begin, held = 0, 0
            for i, tokens in enumerate(batch.column("n_tokens").to_pylist(), 1):
                held += tokens
                if held > SCORE_TOKENS or i == len(batch):
                    yield result(batch.slice(begin, i - begin))
                    begin, held = i, 0

    scored = cut_lineage(rows.mapInArrow(work, T.StructType(fields)))
    # words outside the head: their counts are looked up once per text and word
    scale = words.tokens + 0.5 * (words.types + 1)
    known = counts.select(F.col("word").alias("key"), F.col("n").alias("c"))
    pairs = texts.select("row", F.explode("other").alias("o")).select("row", F.col("o.word").alias("word"), F.col("o.n").alias("k"))
    found = pairs.join(known, F.col("word") == F.col("key"), "left")
    count = F.coalesce("c", F.lit(0))
    sums = found.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((count + 0.5) / F.lit(float(scale)))).alias("more_base"),
        F.sum(F.col("k") * F.log10(count + 0.5)).alias("more_score"))
    return scored.join(sums.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left").select(
        "id", (~F.col("seen")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))

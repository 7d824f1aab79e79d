"""The recurrent language model by value: base columns, total probability, gradients, lanes and awkward rows."""

import math
import platform
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from brute import lower_az, words

from stallkeeper.llm import gru_lm
from stallkeeper.session import ship_package


@pytest.fixture(scope="module")
def model():
    """A small vocabulary and weights that are not at their start."""
    rng = np.random.default_rng(5)
    head = {gru_lm.END: 0} | {f"w{i}".encode(): i + 1 for i in range(40)}
    counts = np.arange(41, 0, -1).astype(float)
    mass = np.full(gru_lm.CLASSES, 0.5)
    for k in range(10):
        mass[gru_lm.word_class(f"rare{k}".encode())] += 1.5
    vocabulary = gru_lm.Vocabulary(900, 51, head, counts, mass)
    gru = gru_lm.Gru(vocabulary)
    for a in gru.w.values():
        a += rng.normal(0, 0.2, a.shape).astype(np.float32)
    return vocabulary, gru


def test_the_slots_of_every_state_have_probability_one(model):
    _, gru = model
    rng = np.random.default_rng(1)
    n = len(gru.w["bs"])
    for h in rng.uniform(-1, 1, (3, gru_lm.HIDDEN)).astype(np.float32):
        logs, _ = gru.log_probs(np.repeat(h[None], n, 0), np.arange(n))
        assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def by_steps(gru, text):
    """Log probability of a text, word by word."""
    w, n = gru.w, gru_lm.HIDDEN
    h, total, before = np.zeros(n), 0.0, gru.first
    for slot in text:
        g, a = w["x"][before].astype(float), h @ w["u"].astype(float)
        r, z = (1 / (1 + np.exp(-(g[k * n : k * n + n] + a[k * n : k * n + n]))) for k in (0, 1))
        new = np.tanh(g[2 * n :] + r * a[2 * n :])
        h = (1 - z) * new + z * h
        k = gru.cls[slot]
        c = h @ w["c"] + w["bc"]
        s = (h @ w["s"] + w["bs"])[gru.start[k] : gru.start[k + 1]]
        total += c[k] - np.log(np.exp(c).sum()) + s[slot - gru.start[k]] - np.log(np.exp(s).sum())
        before = slot
    return total


def test_scores_do_not_depend_on_how_texts_are_laid(model, monkeypatch):
    _, gru = model
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, len(gru.w["bs"]), n) for n in (0, 1, 300, 23, 24, 25, 7, 7, 0, 90, 1)]
    want = [by_steps(gru, t) for t in texts]
    for width in (1, 2, 3, 64):
        for classes in (1, 40, 10**6):
            monkeypatch.setattr(gru_lm, "CLASS_PASS", classes)
            assert np.allclose(gru.scores(texts, width), want, rtol=1e-4, atol=1e-3)
    assert gru.scores([]).tolist() == [] and gru.scores([texts[0]]).tolist() == [0.0]


def test_lanes_hold_every_token_once():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 9, n) for n in rng.integers(0, 80, 50)]
    lay = gru_lm.Lanes(texts, 16, 99)
    assert lay.number == 16 and (lay.target >= 0).sum() == sum(map(len, texts))
    assert lay.lengths.max() - lay.lengths.min() <= 80
    for k, text in enumerate(texts):
        if len(text):
            lane, at = lay.where[0][k], lay.where[1][k]
            assert (lay.target[at : at + len(text), lane] == text).all() and lay.fresh[at, lane]
            assert lay.seen[at, lane] == 99 and (lay.seen[at + 1 : at + len(text), lane] == text[:-1]).all()
    assert lay.fresh.sum() == sum(len(t) > 0 for t in texts)
    assert gru_lm.Lanes([np.arange(50), np.arange(3)], 16, 99).number == 1  # lanes that would soon be empty are not made


def test_recurrent_gradients_equal_differences(model):
    _, gru = model
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, len(gru.w["bs"]), n) for n in (5, 3, 8, 2, 6)]
    lay = gru_lm.Lanes(texts, 3, gru.first)
    held = {k: a.astype(np.float64) for k, a in gru.w.items()}
    exact = gru_lm.Gru.__new__(gru_lm.Gru)
    exact.__dict__.update(gru.__dict__)
    exact.w = held
    start = np.zeros((lay.number, gru_lm.HIDDEN))
    grads, dx, _ = exact.gradients(lay.seen, lay.target, lay.fresh, start)

    def loss():
        return -exact.scores(texts, 3).sum()

    by_input = np.zeros_like(held["x"])
    np.add.at(by_input, lay.seen.ravel(), dx.reshape(-1, 3 * gru_lm.HIDDEN))
    for name, slope in [*grads.items(), ("x", by_input)]:
        flat, slope = held[name].reshape(-1), np.asarray(slope).reshape(-1)
        for i in np.argsort(-np.abs(slope))[:6]:
            kept, step = flat[i], 1e-2
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert slope[i] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=0.02), name


def base_by_hand(rows):
    """n_tokens, n_known, N and base score of each row."""
    tokens = [[*words(lower_az(t or "")), None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    count = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [(h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
            for t, h in zip(tokens, held)]


def test_base_columns_and_scores_of_awkward_rows(spark, monkeypatch):
    ship_package(spark)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"{'The' if k % 7 == 0 else f'w{k}'}" for k in rng.integers(0, 60, rng.integers(0, 40))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "w1 W1"), (3, ""), (4, " \n\t "), (7, texts[7]), (7, texts[7]), (8, "É é\x85x"),
                                                     (9, "tie tie"), (10, "w2 " * 400_000 + "only")]
    docs = spark.createDataFrame([(*r, 1.0, "w", 5, b"k") for r in rows], "doc_id long, text string, score double, word string, n long, key binary")
    got = [r.asDict() for r in gru_lm.score(docs.repartition(3)).collect()]
    assert list(got[0]) == ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda x: (str(x[0]), x[1:4], round(x[5], 3))
    want = sorted(((i, *b) for (i, _), b in zip(rows, base_by_hand(rows))), key=order)
    found = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=order)
    for a, b in zip(want, found, strict=True):
        assert a[:5] == b[:5] and b[5] == pytest.approx(a[5], rel=1e-9, abs=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    same = [r["score"] for r in got if r["id"] == 7]
    assert len(same) == 3 and np.ptp(same) < 1e-3  # repeated rows score alike wherever they are laid
    empties = [r["score"] for r in got if r["n_tokens"] == 1]
    assert len(empties) >= 3 and np.ptp(empties) < 1e-4
    with_none_to_learn = spark.createDataFrame([(i, "a b") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    for r in gru_lm.score(with_none_to_learn).collect():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and math.isfinite(r["score"])


def test_texts_are_split_for_counts_and_for_slots_only(spark):
    ship_package(spark)
    read = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(i, f"first{i % 7} second third{i} " * 5) for i in range(40)], "doc_id long, text string")
    assert gru_lm.score(docs.mapInArrow(pass_on, docs.schema)).count() == 40
    assert read.value == 80


WINDOWS = """
import resource
import numpy as np
from stallkeeper.llm import gru_lm

head = {gru_lm.END: 0} | {f"w{i}".encode(): i + 1 for i in range(2500)}
model = gru_lm.Gru(gru_lm.Vocabulary(9000, 2501, head, np.arange(2501, 0, -1.0), np.full(gru_lm.CLASSES, 9.0)))
texts = [np.arange(k, k + 480) % 2000 for k in range(256)]
faults = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for run in (model.train, model.scores):
    run(texts)
    before = faults()
    run(texts)
    print((faults() - before) // 20)
"""


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="only glibc is told to keep memory")
def test_windows_use_the_memory_of_the_windows_before():
    root = Path(gru_lm.__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", WINDOWS], cwd=root, capture_output=True, text=True, check=True).stdout
    assert all(int(pages) < 100 for pages in out.split()), out  # of 4 KB, a window of 256 lanes

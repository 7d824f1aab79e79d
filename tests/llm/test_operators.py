"""The training-data operators against plain Python, round trips and awkward rows."""

import zlib

import numpy as np
import pytest
from brute import near_groups, shingles

from stallkeeper.llm import (exact_dedup, gru_lm, jaccard_join, line_crf, line_dedup, mixing, packing, quality_rules,
                             token_counts, warc)
from stallkeeper.session import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, size long, name string, d string"
LONG = " ".join(f"w{i % 977}" for i in range(6000))
PROSE = "the quick brown fox jumps over the lazy dog and then it runs away from all of us again today"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    ship_package(spark)
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE.replace(" ", "  "), "en", "a"), (3, PROSE + " x", "en", "b"), (4, None, "en", "b"),
        (5, "", None, None), (6, " \n ", "en", "a"), (7, LONG, "en", "b"), (8, LONG, "de", None), (8, LONG, "de", None),
        (None, PROSE, "en", "a"), (9, "One two", "en", "c"), (10, "one TWO", "en", "c"), (11, "A\n\nB\nA", "en", None),
    ]
    return spark.createDataFrame([(*r, 5, "n", "d") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_near_groups_match_all_pairs(spark, awkward, empty):
    got = {(r["id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(awkward).collect()}
    rows = [(10**9 if i is None else i, t) for i, t in pairs(awkward)]
    want = near_groups(rows)
    plain = lambda i: None if i == 10**9 else i
    assert got == {(plain(rows[k][0]), len(shingles(rows[k][1])), plain(v)) for k, v in want.items()}
    assert jaccard_join.near_duplicate_groups(empty).count() == 0


def test_near_groups_of_many_edits(spark):
    ship_package(spark)
    rng, base = np.random.default_rng(3), [f"t{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base[: rng.integers(8, 120)] if i % 3 else base)
        for at in rng.integers(0, len(words), rng.integers(0, 4)):
            words[at] = f"e{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["component_id"] for r in jaccard_join.near_duplicate_groups(docs).collect()}
    assert got == near_groups(rows)


def test_sets_of_few_words_alone_and_before_a_long_text():
    import pyarrow as pa

    from stallkeeper.llm import bytewords

    long = "word " * 210_000 + "end"
    assert len(long) > bytewords.SEGMENT
    for k in range(7):
        few = " ".join("abcdefg"[:k])
        for column in ([few], [few, long], [long, few]):
            sizes = []
            for _, data, offsets in bytewords.chunks(pa.array(column, pa.string())):
                row, h = jaccard_join.shingle_sets(data, offsets)
                sizes += jaccard_join.set_identity(row, h, len(offsets) - 1)[0].tolist()
            assert sizes == [2 if c is long else len(shingles(c)) for c in column]


def test_small_sets_share_keys_with_partners_only():
    rng = np.random.default_rng(11)

    def keys(sets):
        size = np.array([len(s) for s in sets])
        row, h = np.repeat(np.arange(len(sets)), size), np.concatenate([np.sort(s) for s in sets])
        found = [jaccard_join.signatures(row, h, size, own) for own in (True, False)]
        return [np.concatenate(x) for x in zip(*found)]

    # every pair that links meets under a key that one looks up and the other is indexed by
    sets, near = [], []
    for _ in range(6000):
        a, b = rng.integers(1, 62), rng.integers(0, 8)
        both = rng.integers(0, 2**63, a, dtype=np.uint64)
        one, two = (np.concatenate([both, rng.integers(0, 2**63, k, dtype=np.uint64)]) for k in (b, rng.integers(0, 8)))
        if 100 * a >= 80 * (len(one) + len(two) - a) and len(one) + len(two) > 2 * a:
            near.append((len(sets), len(sets) + 1))
            sets += [one, two]
    held = {}
    for i, key, role in zip(*(x.tolist() for x in keys(sets))):
        held.setdefault(i, {}).setdefault(key, 0)
        held[i][key] |= role
    is_index, is_probe = jaccard_join.INDEX | jaccard_join.INDEX_LESS, jaccard_join.PROBE | jaccard_join.PROBE2 | jaccard_join.PROBE_LESS
    assert len(near) > 500
    for i, j in near:
        a, b = held.get(i, {}), held.get(j, {})
        assert any((a[k] & is_index and b[k] & is_probe) or (b[k] & is_index and a[k] & is_probe) for k in a.keys() & b.keys())
    # unlike sets of one size do not meet, however many there are
    for n in (1, 2, 3, 4, 5, 9, 12, 16, 24, 40):
        row, key, role = keys([rng.integers(0, 2**63, n, dtype=np.uint64) for _ in range(3000)])
        found, members = np.unique(np.unique(np.stack([row.view(np.uint64), key]), axis=1)[1], return_counts=True)
        assert members.max(initial=1) < (30 if n < 14 else 1000) and not np.isin(key[role & is_probe > 0], found[members > 1]).any()


def test_one_row_of_each_near_group_stays(spark, empty):
    ship_package(spark)
    base = [[f"{c}{i}" for i in range(40)] for c in "abcde"]
    text = lambda k, *more: " ".join([*base[k], *more])
    rows = [
        (1, text(0), "x"), (None, text(0, "more"), "x"), (None, text(1), "x"),  # a null id near another row, and one near none
        (2, text(0, "else"), "x"), (2, text(2), "x"),  # an id on a copy and on a text of its own
        (None, text(3), "x"), (None, text(3, "more"), "x"), (None, text(3, "else"), "x"),  # no id at all
        (5, text(4), "x"), (5, text(4, "more"), "x"), (5, text(4), "y"),  # one id, and a row twice
        (None, None, "x"), (None, "", "x"), (6, " ", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string")
    left = jaccard_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    got = [(r["doc_id"], (r["text"] or " ")[0]) for r in left.collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "a"), (None, "b"), (2, "c"), (None, "d"), (5, "e"), (None, " "), (None, " "), (6, " ")], key=str)
    assert jaccard_join.drop_near_duplicates(empty).count() == 0


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    good = lambda i: "\n".join(f"A plain sentence {i} with number {i * 31 + j} in it, and a calm end {i + j}." for j in range(8))
    bad = lambda i: "\n".join(f"BUY!! NOW!! {i + j}!! CHEAP!! $$$" for j in range(8))
    rows = [(i, good(i) if i < 30 else bad(i), "abc"[i % 3]) for i in range(60)]
    rows += [(None, good(0) + " more", "a"), (None, good(101), "a"), (None, good(102), "a"), (1, good(103), "a"), (1, good(0) + " most", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 30)) for i in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.drop_copies(spark, corpus_pipeline.keep_good(spark, docs, str(tmp_path)), str(tmp_path))
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, kept, str(tmp_path)).collect()]
    want = [(i, good(i)) for i in range(30)] + [(None, good(101)), (None, good(102)), (1, good(103))]
    assert sorted(left, key=str) == sorted(want, key=str)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_exact_groups(awkward, empty):
    got = {(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(awkward, block_chars=4).collect()}
    assert {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False),
            (6, 6, 1, True), (7, 7, 3, True), (8, 7, 3, False)} <= got
    left = exact_dedup.drop_exact_duplicates(awkward, block_chars=64)
    assert left.columns == awkward.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4, 6, 7, 9, 10, 11]
    assert exact_dedup.exact_groups(empty).count() == exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_mixing(awkward, empty):
    rows = mixing.mix(awkward).collect()
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    target, open_ = {}, set(size)
    weight = {s: (5, 2, 1)[i] for i, s in enumerate(["a", "b", "c"])} | {None: 5}
    while True:  # share out, fix the full ones, share the rest again
        rest, w = sum(size.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = [s for s in open_ if rest * weight[s] / w > 3 * size[s]]
        if not full:
            target |= {s: rest * weight[s] / w for s in open_}
            break
        target |= {s: 3 * size[s] for s in full}
        open_ -= set(full)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
    copies = mixing.mix_documents(awkward)
    assert copies.columns == awkward.columns
    assert copies.count() == sum(r["taken"] // r["size"] for r in rows if r["size"])
    assert mixing.mix(empty).count() == mixing.mix_documents(empty).count() == 0


def test_packing_round_trip(awkward, empty):
    from stallkeeper.llm.tokenize import byte_bpe

    packed = packing.pack(awkward, capacity=64, with_ids=True, group_pieces=16)
    rows = packed.collect()
    by_sequence = {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 64
    seven = sorted((r["piece"], r["start"], r["ids"]) for r in rows if r["id"] == 7)
    assert [i for _, _, ids in seven for i in ids] == [*byte_bpe().whole.encode(LONG, add_special_tokens=False).ids, 0]
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == sum(r["length"] for r in rows)
    assert packing.pack(empty).count() == 0


def test_lower_bound_and_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        where, offset, used = packing.best_fit(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= where.max() + 1
        assert np.bincount(where, lengths).max() <= 100
    assert packing.lower_bound(np.array([51] * 7 + [49] * 7), 100) == 7
    assert packing.lower_bound(np.array([60] * 5), 100) == 5


def test_ids_agree_with_the_tokenizer_file():
    from stallkeeper.llm.tokenize import byte_bpe

    t = byte_bpe()
    for text in ("", " ", "a\n\n b\t\r", "Éçœ 中文 \U0001f600 x", "it's <|endoftext|> y", "1234 $%&!!", "\x00\x1f", "a" * 500):
        assert t.ids(text) == t.whole.encode(text, add_special_tokens=False).ids


def test_quality_rules(awkward, empty):
    got = {r["id"]: r for r in quality_rules.quality_verdicts(awkward).collect()}
    assert got[4]["n_words"] == got[5]["n_words"] == got[6]["n_words"] == 0 and not got[4]["kept"]
    assert got[11]["n_dup_lines"] == 1
    words = LONG.split()
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + j for p in places for j in range(8)}
    assert got[7]["n_repeat_words"] == len(covered) and got[7]["base_failed"]
    cleaned = quality_rules.clean_documents(awkward, max_docs=0, min_words=0, max_repeat_percent=100, min_kept_percent=0)
    assert cleaned.columns == awkward.columns and {r["text"] for r in cleaned.collect()} <= {"", "\n", " \n ", None}
    assert quality_rules.quality_verdicts(empty).count() == 0


def test_line_runs(spark, awkward, empty):
    run = "\n".join(f"line number {i} has some words in it" for i in range(8))
    docs = spark.createDataFrame([(1, "head\n" + run, "x"), (2, run + "\n\ntail", "y"), (3, "short\nlines", "z"), (4, "short\nlines", "z")],
                                 "doc_id long, text string, t string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert out[1] == "head\n" + run and out[2] == "\ntail" and out[3] == out[4] == "short\nlines"
    report = {r["id"]: (r["n_lines"], r["n_deleted_lines"], r["n_runs"]) for r in line_dedup.line_report(docs).collect()}
    assert report == {1: (9, 0, 0), 2: (9, 8, 1), 3: (2, 0, 0), 4: (2, 0, 0)}
    assert line_dedup.line_report(awkward).count() == 13 and line_dedup.line_report(empty).count() == 0


def test_suffix_array_and_common_prefixes(spark):
    rng = np.random.default_rng(5)
    texts = [[f"{x}" for x in rng.integers(0, 3, n)] for n in rng.integers(1, 40, 30)] + [["0"] * 70, ["0"] * 67, ["1", "0", "2"] * 25]
    texts = [*texts, *texts[:4], ["2", "only here", "2", "0"]]
    rows = [(str(d), d, i, bytes([3 - int(x)] if x.isdigit() else [9])) for d, text in enumerate(texts) for i, x in enumerate(text)]
    lines = spark.createDataFrame(rows, "d string, t long, pos int, line binary")
    suffixes, rounds = line_dedup.suffix_array(lines)
    want = {}
    for d, text in enumerate(texts):
        for i, x in enumerate(text):
            stretch = text[i : text.index("only here")] if "only here" in text[i:] else text[i:]
            if x != "only here":
                want[str(d), i] = [3 - int(y) for y in stretch]
    order = sorted(want.values())
    got = {(r["d"], r["pos"]): (r["rank"], r["left"]) for r in suffixes.collect()}
    assert got == {k: (1 + order.index(v), len(v)) for k, v in want.items()}
    assert len(rounds) == 7  # blocks of up to 64 lines: the longest stretches have 75
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    starts = [i for i in range(len(order)) if i == 0 or order[i] != order[i - 1]]
    prefixes = {r["rank"]: (r["size"], r["lcp"]) for r in line_dedup.common_prefixes(suffixes, rounds).collect()}
    assert prefixes == {i + 1: (order.count(order[i]), shared(order[i - 1], order[i]) if i else 0) for i in starts}


def test_line_crf(spark, awkward, empty):
    ship_package(spark)
    good = [f"A plain sentence with number {i} in it.\nAnd another calm line follows here." for i in range(40)]
    bad = [f"BUY!! NOW!! {i}!! CHEAP!!\nCLICK!! HERE!! NOW!!" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(80)], "doc_id long, quality int")
    model = line_crf.train(docs, labels.where("doc_id % 2 = 0"))
    out = {r["doc_id"]: r["quality_score"] for r in line_crf.score(docs, model).collect()}
    assert min(out[i] for i in range(40)) > 0.7 > max(out[i] for i in range(40, 80))
    assert line_crf.score(awkward, model).count() == 13 and line_crf.score(empty, model).count() == 0
    alone = line_crf.train(docs, labels.where("quality = 1"))
    assert all(r["quality_score"] > 0.7 for r in line_crf.score(awkward, alone).collect())


def test_crf_passes_over_a_document_that_does_not_fit(spark):
    ship_package(spark)
    good, bad = "A plain sentence is here.\nAnd another calm line.", "BUY!! NOW!! CHEAP!!\nCLICK!! HERE!! NOW!!"
    rows = [(i, good if i % 2 else bad) for i in range(40)]
    first = min(range(40), key=lambda i: spark.range(1).selectExpr(f"xxhash64({i}L)").first()[0])
    rows[first] = (first, "\n".join([rows[first][1]] * 200))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = line_crf.train(docs, labels, sample_lines=100)
    out = {r["doc_id"]: r["quality_score"] for r in line_crf.score(docs, model).collect()}
    assert min(out[i] for i in range(1, 40, 2)) > 0.7 > max(out[i] for i in range(0, 40, 2))
    with pytest.raises(ValueError):
        line_crf.train(docs, labels, sample_lines=1)


def test_crf_marginals_match_enumeration():
    from itertools import product

    rng = np.random.default_rng(5)
    unary, stay, doc = rng.normal(size=7), 0.8, np.array([0, 0, 0, 0, 1, 1, 2])
    got, agree, _ = line_crf._chains(unary, doc, stay)
    for k in range(3):
        at = np.flatnonzero(doc == k)
        weight = {y: np.exp(sum(u * s for u, s in zip(unary[at], y)) + stay * sum(a == b for a, b in zip(y, y[1:])))
                  for y in product((0, 1), repeat=len(at))}
        total = sum(weight.values())
        for i, place in enumerate(at):
            assert got[place] == pytest.approx(sum(w for y, w in weight.items() if y[i]) / total)
            if i:
                assert agree[place] == pytest.approx(sum(w for y, w in weight.items() if y[i] == y[i - 1]) / total)


def test_gru_gradients_and_scores(awkward, empty):
    rows = [r.asDict() for r in gru_lm.score(awkward).collect()]
    assert len(rows) == 13 and all(np.isfinite(r["score"]) and r["base_score"] <= 0 for r in rows)
    assert {r["n_tokens"] for r in rows if r["id"] in (4, 5, 6)} == {1}
    assert gru_lm.score(empty).count() == 0
    head = {b"the": 0, b"a": 1, b"": 2, b"of": 3}
    counts = np.array([9.0, 5, 4, 2])
    mass = np.full(gru_lm.CLASSES, 0.5)
    model = gru_lm.Gru(gru_lm.Vocabulary(20, 4, head, counts, mass))
    rng = np.random.default_rng(2)
    for k, a in model.w.items():
        model.w[k] = a.astype(np.float64) + rng.normal(0, 0.2, a.shape)
    h, slot = rng.normal(size=(6, gru_lm.HIDDEN)), rng.integers(0, 3, 6)
    grads = {k: np.zeros_like(a) for k, a in model.w.items() if k != "x"}
    _, back = model.log_probs(h, slot, grads)
    for i, j in ((0, 0), (3, 5)):
        step = np.zeros_like(h)
        step[i, j] = 1e-5
        slope = (model.log_probs(h - step, slot)[0].sum() - model.log_probs(h + step, slot)[0].sum()) / 2e-5
        assert back[i, j] == pytest.approx(slope, rel=1e-3)


def test_every_training_document_is_learnt_from(spark):
    ship_package(spark)
    docs = spark.createDataFrame([(i, f"first{i} second{i} third{i} " * 20) for i in range(60)], "doc_id long, text string")
    words = gru_lm.vocabulary(gru_lm.count_words(docs).cache())
    before, after = gru_lm.Gru(words).w["x"], gru_lm.train(docs, words, sample_docs=0).w["x"]
    seen = [r["text"].encode() for r in docs.where(gru_lm.in_training("doc_id")).collect()]
    assert len(seen) > 30
    for text in seen:
        inputs = words.slots([gru_lm.split_words(text)]).slot[:-1]
        assert (before[inputs] != after[inputs]).any(1).all()


def test_rollup_is_idempotent_and_additive(spark, awkward, empty, tmp_path):
    counts = token_counts.token_counts(awkward)
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    key = lambda r: (r["source"], r["lang"])
    assert rollup.totals().count() == 0
    assert rollup.commit("one", counts.selectExpr("*", "1 AS sign")) and not rollup.commit("one", counts.selectExpr("*", "1 AS sign"))
    whole = {key(r): (r["documents"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}
    assert whole[("b", "en")][0] == 3 and sum(v[0] for v in whole.values()) == 13
    rollup.commit("two", token_counts.revised(counts.where("source = 'c'"), token_counts.token_counts(empty)))
    rollup.compact()
    rollup.commit("two", counts.selectExpr("*", "1 AS sign"))
    after = {key(r): (r["documents"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}
    assert after == {k: v for k, v in whole.items() if k[0] != "c"}


def test_warc_round_trip(spark, tmp_path):
    ship_package(spark)
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "http://c", "small"), (4, "http://d", "small"), (None, "http://e", big),
            (6, "http://f", None), (7, "http://g", ""), (8, "http://h", "x" * 300_000)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} {PROSE}</body></html>") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages, path, archive_records=50)
    got = {r["page"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        r = got[page]
        assert r["payload_bytes"] == len((html or "").encode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 5) if page in (1, None) else ("response", None))
        assert r["payload"] is None or bytes(r["payload"]) == (html or "").encode()
    none = f"file://{tmp_path}/none"
    warc.write_archives(pages.limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def test_warc_archives_are_bounded_in_bytes(spark, tmp_path):
    import random

    ship_package(spark)
    rng = random.Random(3)
    pages = [(i, f"http://h/{i}", "".join(chr(rng.randrange(33, 0x2FF)) for _ in range(800)), "k", 1, "r") for i in range(300)]
    pages += [pages[5]] * 3 + [(1000, None, "y" * 999, "k", 2, "r"), (1001, "", "y" * 999, None, 3, None)]
    pages.append((2000, "http://long", "".join(chr(rng.randrange(33, 0x2FF)) for _ in range(700_000)), "k", 4, "r"))
    table = spark.createDataFrame(pages, "page_id long, url string, html string, key string, size long, response string").repartition(3)
    path, limit = tmp_path / "archives", 150_000
    warc.write_archives(table, f"file://{path}", archive_bytes=limit)
    sizes = sorted(f.stat().st_size for f in path.glob("part-*"))
    records = [sum(1 for _ in warc.read_records(f.read_bytes())) for f in path.glob("part-*") if f.stat().st_size > limit]
    assert len(sizes) > 4 and sizes[-2] <= limit < sizes[-1] and records == [1]
    got = [(r["page"], bytes(r["payload"]).decode()) for r in warc.read_archives(spark, f"file://{path}").where("record_type = 'response'").collect()]
    assert sorted(got) == sorted((p[0], p[2]) for p in pages)

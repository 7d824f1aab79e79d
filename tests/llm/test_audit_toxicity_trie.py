"""Source audit, toxicity and the conversation trie against plain Python, with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import words

from stallkeeper.llm import bytewords, conversation_trie, source_audit, toxicity
from stallkeeper.session import ship_package

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, item string, rank string, term string"
TURNS = "conv_id long, turn long, role string, text string, d string, key string"


def audit_by_hand(rows, min_docs, top=50):
    """{(lang, source, part, item): (value, rank)} over (text, lang, source) rows."""
    docs, counts = defaultdict(set), defaultdict(Counter)
    for i, (text, lang, source) in enumerate(rows):
        found = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERMS.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        for t in found:
            docs[lang or "", t].add(i)
    out = {}
    for lang in {g[0] for g in counts}:
        kept = [t for (of, t), held in docs.items() if of == lang and len(held) >= min_docs]
        groups = {s: c for (of, s), c in counts.items() if of == lang}
        whole = sum(groups.values(), Counter())

        def share(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept))

        for s, c in groups.items():
            pair = [(sum(abs(share(c, t) - share(o, t)) for t in kept), name) for name, o in groups.items() if name != s]
            term = [(share(c, t) - share(whole, t), t) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda r: (-r[0], r[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out[lang, s, part, item] = value, rank
    return out


def audited(df):
    return {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in df.collect()}


def test_audit_of_awkward_rows(spark, monkeypatch):
    ship_package(spark)
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("x", "Y", "é", "ß", "漢")]
    rows = [(" ".join(rng.choices(vocabulary[: 10 + 5 * k], k=rng.randrange(0, 60))), lang, f"s{k % 9}")
            for k in range(200) for lang in ("en", "de")]
    rows += [(None, "en", "s1"), ("", None, None), ("Ax ax AX", "en", None), ("alone", "fr", "only"), ("12 34", "xx", "a"), ("", "xx", "b")]
    rows += [rows[3]] * 3 + [("AX-by_cé " * 160_000, "en", "long")]  # repeated rows; a text of more than 1 MiB
    docs = spark.createDataFrame([(i // 2, *r, "i", "r", "t") for i, r in enumerate(rows)], DOCS).repartition(5)
    want = audit_by_hand(rows, 30)
    assert {k[2] for k in want} == {"pair", "term"} and want["xx", "a", "pair", "b"] == (0, 1)
    # a few terms to a subtree and few groups to a tile, so that every kind of task occurs
    assert audited(source_audit.source_audit(docs, block=4, tile=2)) == want
    assert audited(source_audit.source_audit(docs)) == want
    monkeypatch.setattr(source_audit, "TOP_TERMS", 3)
    assert audited(source_audit.source_audit(docs, block=8, tile=20)) == audit_by_hand(rows, 30, 3)
    assert source_audit.source_audit(docs.limit(0)).count() == 0


def test_equal_subtrees_are_one_node_and_equal_pairs_priced_once():
    counts = np.tile(np.array([[1, 2, 3, 4], [0, 2, 3, 9]]), (1, 256))
    forest = source_audit.Forest(counts)
    assert [len(left) for left, _ in forest.levels] == [4, 2, *[2] * 8]
    a, b, times = forest.leaf_pairs(0, 1)
    assert len(times) == 4 and times.tolist() == [256] * 4
    assert sorted(zip(forest.counts[a].tolist(), forest.counts[b].tolist())) == [(1, 0), (2, 2), (3, 3), (4, 9)]


def test_features_of_words_cut_across_texts():
    texts = ["One two", "", "twO three", "x" * 10, "héé-héé Ab1"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    where, found = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), offsets)
    got = defaultdict(set)
    for i, f in zip(where.tolist(), found.tolist()):
        got[i].add(f)
    for i, t in enumerate(texts):
        assert got[i] == {f for f in toxicity.features_of(t) if f % 2 == 0}
    assert toxicity.features_of("TWO") <= got[0] & got[2] and len(toxicity.features_of("TWO")) == 1
    assert len({f for f in toxicity.features_of("héé héé") if f % 2}) == 3  # the word and its beginnings of 4 and 5 bytes, again


def labelled(spark, rng, n=400, insults=0.75):
    """Three of four toxic texts have an insult, and four of five name one group, as one of ten others do."""
    filler = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        text = rng.choices(filler, k=rng.randrange(5, 40))
        if toxic and rng.random() < insults:
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "scum"]))
        if rng.random() < (0.8 if toxic else 0.1):
            text.insert(rng.randrange(len(text)), "Immigrants")
        docs.append((i, " ".join(text) + "."))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_take_the_weight_off_a_groups_name(spark):
    ship_package(spark)
    docs, labels = labelled(spark, random.Random(1))
    fair = toxicity.train(docs, labels, swap_weight=5.0)
    plain = toxicity.train(docs, labels, swap_weight=0.0)
    neutral = "immigrants came to w1 w2 today"
    assert plain.score_text(neutral) > 2 * fair.score_text(neutral)
    assert abs(fair.score_text(neutral) - fair.score_text(neutral.replace("immigrants", "citizens"))) < 0.05
    assert fair.score_text("w3 idiot w4") > 0.3 > fair.score_text(neutral)
    lost, won = toxicity.counterfactuals("Fine. Immigrants are here!", (("immigrants", "natives"),))[0]
    assert len(lost) == len(won) == 5 and not set(lost) & set(won)


def test_scores_of_awkward_rows(spark):
    ship_package(spark)
    docs, labels = labelled(spark, random.Random(2), insults=1)
    more = labels.union(spark.createDataFrame([(None, 1), (10**9, 1), (4, 0), (5, None)], "doc_id long, toxic int"))
    model = toxicity.train(docs, more)
    assert toxicity.train(docs.repartition(7), more).bias == model.bias
    long = "w1 w2 w3 " * 150_000 + "idiot"
    assert len(long) > bytewords.SEGMENT
    rows = [(1, "you idiot", "a", 0.5), (1, "you idiot", "a", 0.5), (None, None, "b", None), (3, "", "c", 1.0), (4, " \n", "d", 1.0), (5, long, "e", 1.0),
            (6, "you IDIOT, idiot!", "f", 1.0)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, row_0 string, score double")
    got = toxicity.score(odd, model).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, rows))
    for r in got:
        assert r["toxicity"] == pytest.approx(model.score_text(r["text"] or ""), abs=1e-12)
    by_row = {r["row_0"]: r["toxicity"] for r in got}
    base = 1 / (1 + np.exp(-model.bias))
    assert by_row["b"] == by_row["c"] == by_row["d"] == pytest.approx(base) and base < 0.3
    assert min(by_row["a"], by_row["e"], by_row["f"]) > 0.3
    assert toxicity.score(odd.limit(0), model).count() == 0
    for bad in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        with pytest.raises(ValueError, match="both classes"):
            toxicity.train(docs, bad)
    with pytest.raises(ValueError, match="both classes"):
        toxicity.train(docs.limit(0), labels)


def test_held_out_labels_are_not_learnt_from(spark):
    """The weights do not change with held-out labels, and held-out documents are told apart."""
    from stallkeeper.llm.line_crf import is_held_out

    ship_package(spark)
    docs, labels = labelled(spark, random.Random(3), 600, 1)
    seen = labels.where(~is_held_out("doc_id"))
    turned = seen.union(labels.where(is_held_out("doc_id")).selectExpr("doc_id", "1 - toxic")).where(~is_held_out("doc_id"))
    one, other = toxicity.train(docs, seen), toxicity.train(docs, turned)
    assert (one.names == other.names).all() and (one.once == other.once).all()
    held = toxicity.score(docs, one).join(labels, "doc_id").where(is_held_out("doc_id")).collect()
    assert len(held) > 100 and np.mean([(r["toxicity"] >= 0.3) == bool(r["toxic"]) for r in held]) > 0.97


def trie_by_hand(rows):
    """The contract's rows over (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [step for _, step in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        path = (*own.get(base, [])[:h], *own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * len(words(p[-1][1])) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tried(spark, rows):
    table = spark.createDataFrame([(*r, "d", "k") for r in rows], TURNS)
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in conversation_trie.prefix_trie(table).collect())


def shared_turns(rng, n):
    """Conversations that share openings of all lengths, with copies and turnless ones."""
    rows = []
    for c in range(n):
        length = rng.choice([1, 1, 2, 3, 4, 6, 9, 20])
        stray = rng.randrange(length + 1)
        rows += [(c, t, "user" if t % 2 else "system", f"word {t} again" if t < stray else f"t{rng.randrange(3)} more") for t in range(length)]
    return rows


def test_trie_of_shared_openings(spark, monkeypatch):
    ship_package(spark)
    rng = random.Random(7)
    rows = shared_turns(rng, 150)
    want = trie_by_hand(rows)
    assert tried(spark, rows) == want
    # segments, runs of ids and batches so small that all of them are crossed
    monkeypatch.setattr(conversation_trie, "SEGMENT", 3)
    monkeypatch.setattr(conversation_trie, "RUN", 2)
    monkeypatch.setattr(conversation_trie, "FIRST_BATCH", 2)
    assert tried(spark, rows) == want


def test_trie_of_awkward_rows(spark):
    ship_package(spark)
    long = "much to say " * 100_000
    rows = [(None, 1, "user", "nobody"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, None, None), (5, 0, "b", "tie"), (5, 0, "a", "tie"),
            (6, 1, "user", ""), (7, 1, "", None), (-21, 1, "user", "below"), (-20, 1, "user", "base"), (40, 1, "u", long), (41, 1, "u", long),
            (41, 2, "u", "x"), (60, 3, "ab", "c"), (61, 3, "a", "bc"), (62, 3, "a", "bc")]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]
    assert tried(spark, rows) == trie_by_hand(rows)
    assert tried(spark, []) == []
    # 2 takes no turn from an absent conversation and has but one turn, which it gives up
    assert zlib.crc32(b"2") % 4 and tried(spark, [(2, 0, "u", "gone")]) == trie_by_hand([(2, 0, "u", "gone")])


def test_two_fattest(spark):
    pairs = [(a, b) for b in range(1, 70) for a in range(b)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", conversation_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r["f"] == max(range(r["a"] + 1, r["b"] + 1), key=lambda f: f & -f) for r in rows)

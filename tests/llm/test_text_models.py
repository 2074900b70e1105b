"""Per-text operators: encoder, statistics, trees, language, toxicity, fingerprints."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from farebox.llm import boosting, language, pieces, quality, simhash, toxicity
from farebox.llm.queries import tokenizer


@pytest.fixture(scope="module")
def texts(small="/root/testdata/sf0.001/documents.parquet"):
    return pd.read_parquet(small)


def test_encoder_equals_the_library(texts):
    path = tokenizer()
    ours, theirs = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    signs = "aabcdeett hhlo  rsnwi\n\t▁éèßüñ梦ข\x00<>0x12.,!😀́　"
    cases = [*texts.text, "", " ", "▁", "\n a", "x" * 5000, " " * 999,
             *("".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(3000)),
             *("".join(rng.choice(" ▁\na") for _ in range(40)) for _ in range(500))]
    for text in cases:
        ids = ours.encode(text)
        assert ids == theirs.encode(text)
        assert ours.decode(ids) == theirs.decode(ids)


def test_digests_follow_the_ids(docs):
    import hashlib

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for row in pieces.digest_documents(docs, tokenizer()).collect():
        ids = model.encode(row.text or "")
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    full = pieces.encode_documents(docs, tokenizer()).select("text", "ids", "decoded").collect()
    assert all(r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids) for r in full)


def test_stretches_go_on_from_a_shared_prefix(texts, monkeypatch):
    path = tokenizer()
    ours, theirs = pieces.Encoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(8)
    some = [*(f"{a}{b}" for a in ("thon", "▁anwher", "ß梦") for b in ("", "e", "ing", "\x00", "梦", "ly")), "the" * 400]
    made, taken = [], []
    extend = ours._extend
    monkeypatch.setattr(ours, "_extend", lambda text, at, *rest: (taken.append(len(text) - at), extend(text, at, *rest)))
    assert sorted(p for p, _ in ours.encode_stretches(some)) == sorted(some)
    assert sum(taken) < sum(map(len, some)) - 60  # shared prefixes are not gone through again
    monkeypatch.undo()
    alone = pieces.Encoder(path)
    assert all(tuple(ids) == alone.encode_stretch(p) for p, ids in ours.encode_stretches(some))
    # small caches: entries move up, fall out and come back; long stretches are not kept
    monkeypatch.setattr(pieces, "CACHE", 400)
    monkeypatch.setattr(pieces, "TOGETHER", 500)
    signs = "aabcdeett hhlo  rsn\n▁éß梦ข\x00<>0x.,😀"
    cases = [None, "", "the" * 999, *("".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(400)),
             *texts.text[:20], None, " a", *texts.text[:20]]
    for group in pieces.together(cases):
        made += ours.written(group)
        assert not any(len(p) > pieces.LONG for p in ours._written)
    want = [theirs.encode(t or "") for t in cases]
    assert made == [(",".join(map(str, ids)), theirs.decode(ids)) for ids in want]
    assert [t for group in pieces.together(cases) for t in group] == cases and not [*pieces.together([])]


def brute_repeats(words, k=8):
    found = Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    hit = [False] * len(words)
    for i in range(len(words) - k + 1):
        if found[tuple(words[i:i + k])] > 1:
            hit[i:i + k] = [True] * k
    return sum(hit)


def test_repeat_words_equals_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))] * rng.randint(1, 2)
        assert quality.repeat_words(words) == brute_repeats(words)


def test_statistics():
    text = "One two\n\none two\nOne two\n# $x <a>\n \n"
    n_words, chars, symbols, dup, repeated = quality.statistics(text)[:5]
    assert (n_words, chars, symbols, dup, repeated) == (9, 24, 4, 1, 0)
    assert quality.statistics(None)[:5] == quality.statistics("")[:5] == (0, 0, 0, 0, 0)
    assert quality.statistics("a b")[0] == 1  # a no-break space is part of a word


def test_trees_keep_their_directions():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) + 0.2 * rng.normal(size=2000) > 0.6).astype(float)
    trees = boosting.fit(x, y, [1, 0, -1])
    grid = np.full((50, 3), 0.5)
    for feature, sign in ((0, 1), (2, -1)):
        line = grid.copy()
        line[:, feature] = np.linspace(0, 1, 50)
        assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()
    assert ((trees.probability(x) >= 0.5) == y).mean() > 0.85
    assert len(set(boosting.fit(x, np.ones(2000), [0, 0, 0]).probability(x[:5]))) == 1


def test_quality_held_out(texts):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    both = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").merge(labels, on="doc_id")
    stats = pd.DataFrame([quality.statistics(t) for t in both.text], columns=quality.BASE + quality.MORE)
    rows, y = quality.features(stats), both.quality.to_numpy()
    held = both.doc_id.to_numpy() % 3 == 0
    p = boosting.fit(rows[~held], y[~held], quality.SIGNS).probability(rows[held])
    assert (p[y[held] == 1] >= quality.KEEP_FROM).mean() > 0.97
    assert (p[y[held] == 0] < quality.KEEP_FROM).mean() > 0.8


def test_judging_edge_rows(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (7, 1)], "doc_id long, quality int")
    trees = quality.train(docs, labels)
    rows = quality.judge(docs, trees).collect()
    assert len(rows) == 8 and all(r.quality_rules_.base_failed and not r.quality_rules_.kept for r in rows)
    assert quality.judge(none, quality.train(none, labels)).count() == 0


def test_gram_counts_do_not_depend_on_the_stretch(monkeypatch):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab  1é\n") for _ in range(rng.randint(1, 60)))
        whole = language.counts(text)
        monkeypatch.setattr(language, "STRETCH", rng.choice([1, 3, 7, 16]))
        parted = language.counts(text)
        monkeypatch.undo()
        assert (whole is None and parted is None) or (whole == parted).all()


def test_language_held_out():
    rows = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    held = rows.doc_id % 3 == 1
    model = language.fit(rows[~held].text.tolist(), rows[~held].lang.tolist())
    found = model.nearest(rows[held].text.tolist())
    assert (found.lang.to_numpy() == rows[held].lang.to_numpy()).mean() > 0.97
    edge = model.nearest([None, "", "123 !?", "der"])
    assert edge.lang.tolist()[:3] == ["und"] * 3 and edge.score.tolist()[:3] == [0, 0, 0]
    assert edge.lang[3] in {"en", "de", "fr", "es"} and model.nearest(["ξψω ξψω ξξξ"]).rejected[0]


def test_language_of_edge_rows(docs, none):
    model = language.train(docs, F.lit(True))
    got = {(r.doc_id, r.language_.lang) for r in language.identify(docs, model).collect()}
    assert (2, "und") in got and (3, "und") in got and (1, "en") in got
    assert language.identify(docs, language.train(none, F.lit(True))).where("language_.lang <> 'und'").count() == 0


def test_toxicity_gradients_and_held_out():
    rng = np.random.default_rng(0)
    h, size = toxicity.HIDDEN, 4 + toxicity.CODE
    p = {k: rng.normal(0, .5, s) for k, s in dict(Wf=(size, 3 * h), Wb=(size, 3 * h), Uf=(h, 3 * h), Ub=(h, 3 * h), bf=(3 * h,),
                                                  bb=(3 * h,), va=(2 * h,), wo=(2 * h,), bo=(1,)).items()}
    mask = (np.arange(toxicity.SPAN) < np.array([24, 10, 1, 0])[:, None]).astype(float)
    x = rng.normal(size=(4, toxicity.SPAN, size)) * mask[:, :, None]
    y = np.array([1., 0, 1, 0])

    def loss(q):
        s = 1 / (1 + np.exp(-toxicity.forward(q, x @ q["Wf"], x @ q["Wb"], mask)[0]))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = toxicity.gradients(p, x, mask, y, np.ones(4))
    for k in p:
        at = tuple(rng.integers(0, d) for d in p[k].shape)
        sides = []
        for e in (1e-3, -1e-3):
            q = {**p, k: p[k].copy()}
            q[k][at] += e
            sides.append(loss(q))
        assert abs((sides[0] - sides[1]) / 2e-3 - g[k][at]) < 1e-4


def test_toxicity_learns_words_and_edges(docs, none, spark):
    rng = random.Random(3)
    clean = lambda n: " ".join(rng.choice("the of and tree house water stone river light day".split()) for _ in range(n))
    bad = lambda: clean(30) + " " + rng.choice(["scum", "moron"]) + " " + clean(90)
    texts_, y = [clean(100) for _ in range(120)] + [bad() for _ in range(60)], [0] * 120 + [1] * 60
    net = toxicity.fit(texts_, y)
    assert (net.scores([bad() for _ in range(30)]) >= 0.5).mean() > 0.9
    assert (net.scores([clean(120) for _ in range(30)]) < 0.5).mean() > 0.9
    long = clean(40_000)
    assert net.scores([long + " moron moron"])[0] > net.scores([long])[0] - 1e-9
    out = toxicity.score(docs, net).collect()
    assert len(out) == 8 and all(0 <= r.toxicity_ <= 1 for r in out)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(none, labels, F.lit(True)).scores(["x"])[0] == 0


def brute_print(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    runs = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        votes = [v + (h >> b & 1) for b, v in enumerate(votes)]
    return sum(1 << b for b, v in enumerate(votes) if 2 * v > len(runs))


def test_fingerprints(texts):
    for t in [*texts.text[:40], "", None, "a", "É  b c\nd e"]:
        assert simhash.fingerprint(t) == brute_print(t)


def classes(prints, radius=4):
    prints = sorted(set(prints))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {p: find(i) for i, p in enumerate(prints)}


@pytest.mark.parametrize("tile", [2048, 16])
def test_links_and_components_equal_brute_force(spark, tile):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for p in prints[:12]:
        for _ in range(8):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)][:150]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in set(prints)], "fp long")
    got = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links(df, 4, tile)).collect()}
    want = classes(prints)
    group = lambda of: sorted(sorted(p for p in want if of(p) == g) for g in {of(p) for p in want})
    assert group(lambda p: want[p]) == group(lambda p: got.get(p, signed(p)))


def test_near_duplicates_edges(docs, none):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (6, 1), (2, 2), (3, 2), (5, 2), (4, 4), (None, None)}
    kept = simhash.deduplicated(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4] and kept.columns == docs.columns
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_class_with_repeated_and_missing_ids(spark):
    x, y, z = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey pink")
    rows = [(3, x), (5, x), (5, y), (9, y), (None, y), (None, z), (None, z), (None, x)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_keep", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "_keep"]
    assert Counter((r.text, r.doc_id) for r in kept.collect()) == Counter([(x, 3), (y, 5), (z, None)])


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i * 10 + k, f"{letters[i % 26] * 3} {letters[i // 26] * 4} {letters[(i * 7) % 26] * 2} ", f"l{i:03}") for i in range(60) for k in range(5)]
    rows += [(9_000 + k, "quux zyzzy " * 9_000, "long") for k in range(3)] + [(None, "aaa", None), (9_100, None, "l000")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, F.lit(True), max_sample=70)
    assert set(model.lang) == {r[2] for r in rows if r[1] and r[2]}  # one text of each: the sample is spent
    found = language.identify(docs.where("text is not null and lang is not null"), model).select("lang", "language.lang").toDF("a", "b")
    assert found.where("a <> b").count() == 0
    assert language.train(docs.where("false"), F.lit(True)).lang == []

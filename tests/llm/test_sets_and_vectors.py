"""Fill-in-the-middle, centroid clustering and MinHash near-duplicates against brute force, and their edge rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from farebox.llm import centroids, common, fim, minhash

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


# ---- fill-in-the-middle -----------------------------------------------------------------

def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts_of(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abZ é漢𝔸\n<>PSM1", k=rng.choice([0, 1, 5, 40, 700]))) for _ in range(n)]


@pytest.mark.parametrize("block,slab", [(1, 1), (4, 8), (7, 64), (256, 1 << 22)])
def test_cuts_equal_a_plain_count(block, slab):
    texts = [*texts_of(60), "x" * 1000, "é" * 999, None, "", "a" * 255 + "é", "<" * 300]
    rng = np.random.default_rng(2)
    one, other = rng.integers(0, 1 << 32, (2, len(texts)))
    n, prefix, middle = fim.cuts(pa.array(texts), one, other, block, slab)
    for i, t in enumerate(texts):
        units = UNIT.findall(t or "")
        a, b = sorted((int(one[i]) % (len(units) + 1), int(other[i]) % (len(units) + 1)))
        assert (n[i], prefix[i], middle[i]) == (len(units), len("".join(units[:a])), len("".join(units[a:b])))


def test_a_slice_of_a_batch_is_read_from_its_own_offset():
    texts = pa.array(["zzz", "ab é", None, "c d"])
    whole, part = (fim.cuts(t, np.full(len(t), 2), np.full(len(t), 1)) for t in (texts, texts.slice(1, 2)))
    assert [x[1:3].tolist() for x in whole] == [x.tolist() for x in part]


def test_forms_and_outputs_equal_brute_force_and_come_back(spark):
    rows = [(i, t) for i, t in enumerate(texts_of(150, 3))] + [(None, "no id"), (5, None), (6, ""), (7, "has <M> mark")]
    df = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    back = fim.restored(df["fim.output"], df["fim.form"])
    out = df.select("doc_id", "text", "fim.*", back.alias("back")).collect()
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")


def test_fim_on_edge_rows_and_empty_tables(docs, none):
    clash = docs.selectExpr("*", "0 as fim", "0 as _cut")
    out = fim.fill_in_middle(clash)
    assert out.columns == [*clash.columns, "fim_"]
    for r in out.collect():
        assert tuple(r["fim_"]) == by_hand(r["doc_id"], r["text"])
    assert fim.fill_in_middle(none).collect() == []


# ---- centroid clustering ----------------------------------------------------------------

def clusters_by_hand(rows, k=8, rounds=10, width=64):
    kept = [(i, [int(x) * 1024 if abs(x) > 2 ** 60 else int(np.floor(x * 1024)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, *near(v)) for i, v in kept]
    total = {j: sum(d for _, d, x in out if x == j) for j in range(len(c))}
    cap = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, cap(d), cap(total[j]) if cap(total[j]) is not None else None,
                    hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in out), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int, v int")
    out = centroids.cluster(df).collect()
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["centroid_sha256"]) for r in out), key=str)
    assert got == clusters_by_hand([(r[0], r[1]) for r in rows])
    return out


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(6, 64))
    rows = [(i, (middle[i % 6] + 0.3 * rng.normal(size=64)).tolist(), 0, 0) for i in range(150)]
    rows += [(3, rows[3][1], 0, 0), (None, rows[4][1], 0, 0), (900, None, 0, 0), (901, [1.0] * 63, 0, 0), (902, [float("nan")] * 64, 0, 0),
             (903, [None] * 64, 0, 0), (904, [float("inf")] * 64, 0, 0), (905, [], 0, 0)]
    assert len(check(spark, rows)) == 152


def test_large_components_are_exact_and_sums_beyond_a_long_are_null(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** rng.integers(0, 7)).tolist(), 0, 0) for i in range(40)]
    rows += [(100, [5e6] * 64, 0, 0), (101, [-3e8] * 64, 0, 0), (102, [3e38] * 64, 0, 0), (103, [1.7e308] * 64, 0, 0)]
    out = check(spark, rows)
    assert {r["inertia"] for r in out} == {None} or all(r["inertia"] is not None for r in out)


def test_ties_few_and_no_vectors(spark):
    check(spark, [(i, [0.0] * 64, 0, 0) for i in range(20)])
    check(spark, [(i, [float(i)] * 64, 0, 0) for i in range(3)])
    empty = centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_bounds_never_exceed_distances_and_skip_work():
    rng = np.random.default_rng(6)
    c = (rng.normal(size=(8, 64)) * 4000).astype(int).tolist()
    pivots = centroids.Pivots(c)
    x = (np.array(c)[rng.integers(0, 8, 400)] + rng.normal(size=(400, 64)) * 200) / 1024
    to = pivots.distances(x, 1024)
    low = pivots.bounds(to, np.array([[centroids._root(centroids.squared(a, b)) for b in c] for a in c]))
    true = np.array([[centroids.squared(np.floor(v * 1024).astype(int).tolist(), b) for b in c] for v in x])
    assert (low <= true).all()
    own, best, measured = centroids.nearest(x, to, c, pivots)
    assert own.tolist() == true.argmin(axis=1).tolist() and best == true.min(axis=1).tolist()
    assert measured < 0.5 * true.size


def test_digits_add_up():
    for v in (0, 5, -5, 1 << 39, -(1 << 40), 1 << 40, -(1 << 200) - 7, 1 << 200):
        assert sum(d << (40 * i) for i, d in enumerate(centroids.digits(v))) == v


# ---- MinHash near-duplicates ------------------------------------------------------------

def sets_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i:i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def components_by_hand(rows):
    held = [sets_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(held[i] & held[j])
            if both and 100 * both >= 80 * (len(held[i]) + len(held[j]) - both) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        least = (min(ids) if ids else None) if held[i] else doc_id
        out.append((doc_id, len(held[i]), least, doc_id == least))
    return sorted(out, key=str)


def edited(rng, words, share):
    return [rng.choice(VOCABULARY) if rng.random() < share else w for w in words]


VOCABULARY = [f"w{i}" for i in range(3000)]


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, chains, passages that many texts share, exact copies."""
    rng = random.Random(7)
    rows = []
    for _ in range(25):
        base = rng.choices(VOCABULARY, k=rng.randint(4, 200))
        for _ in range(rng.randint(1, 8)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))))
    chain = rng.choices(VOCABULARY, k=120)
    for _ in range(30):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 0.03)
    passage = rng.choices(VOCABULARY, k=60)
    rows += [" ".join(passage + rng.choices(VOCABULARY, k=rng.randint(0, 60))) for _ in range(40)]
    rows += [rows[3], rows[3].upper(), "one two three", "One two three", "one two", "", None, "  \n\x0b"]
    rng.shuffle(rows)
    return [(i if i % 17 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("tile,try_from", [(1024, 8), (4, 8), (3, 65)])
def test_components_equal_brute_force(spark, copies, monkeypatch, tile, try_from):
    """Also in many small tiles, and without the short cut: then every link comes from the join."""
    monkeypatch.setattr(minhash, "TRY_FROM", try_from)
    out = minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), tile=tile)
    assert sorted((tuple(r) for r in out.collect()), key=str) == components_by_hand(copies)


def test_all_pairs_within_the_radius_share_a_key(spark):
    rng = np.random.default_rng(8)
    one = rng.integers(0, 1 << 16, (200, minhash.SYMBOLS)).astype("<u2")
    two = one.copy()
    for row in two:
        row[rng.choice(minhash.SYMBOLS, minhash.RADIUS, replace=False)] ^= np.uint16(1)
    rows = [(i + 1000 * side, [int(x) for x in np.ascontiguousarray(s).view("<i8")]) for side, m in enumerate((one, two)) for i, s in enumerate(m)]
    found = minhash.keys(spark.createDataFrame(rows, "node long, sign array<long>"))
    pairs = (found.alias("a").join(found.alias("b"), "key").where("b.node = a.node + 1000").select("a.node").distinct().count())
    assert pairs == 200


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(9)
    differ = []
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 360, dtype=np.uint64)
        a, b = (minhash.signature(np.unique(x)).view("<u2") for x in (h[:320], h[40:]))
        differ.append((a != b).mean())
    assert abs(np.mean(differ) - (1 - 280 / 360)) < 0.02


def test_minhash_on_edge_rows_and_empty_tables(docs, none):
    out = minhash.near_duplicates(docs).collect()
    want = components_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in out), key=str) == want
    assert minhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("merge_from", [0, common.MERGE_FROM])
def test_minhash_broadcasts_no_large_table(spark, copies, monkeypatch, merge_from):
    """Whatever a table's size is taken for: after an explode, or by its files, it looks many times too small."""
    plans, cut = {}, minhash.cut

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(minhash, "cut", noted)
    monkeypatch.setattr(common, "MERGE_FROM", merge_from)
    out = minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string"), tile=4)
    noted(out, "result")
    exploded = {"minhash-keys", "minhash-contested", "minhash-tied", "minhash-links"}
    assert all("SortMergeJoin" in plan for name in exploded for plan in plans[name])
    assert [name for name in (exploded if merge_from else plans) if any("Broadcast" in plan for plan in plans[name])] == []


def test_a_radius_beyond_the_guarantee_is_refused(docs):
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, radius=minhash.RADIUS + 1)

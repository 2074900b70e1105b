"""The forest as a node table, against one grown in Python."""

import hashlib
import math

import numpy as np
import pytest
from farebox.operators import forest

FEATURES, KEYS = ["a", "b", "c"], ["k"]
SCHEMA = "k string, a int, b double, c int, y bigint"


def data(n: int = 80) -> list[tuple]:
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        a, b = int(rng.integers(0, 12)), float(rng.integers(-3, 4)) / 2
        out.append((f"k{i}", a, b, 7, 10 * a + int(8 * b) + int(rng.integers(0, 5))))
    return out


def draws(key: str, tree: int, seed: int) -> int:
    u = int(hashlib.md5(f"{seed}:{tree}:{key}".encode()).hexdigest()[:8], 16)
    return sum(int(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) <= u for k in range(11))


def grown(rows: list[tuple], trees: int, depth: int, seed: int) -> dict:
    """{(tree, node): (rows, prediction, feature, threshold, gain)} by trying every cut of every node."""
    nodes = {}

    def visit(tree, node, part, left):
        n, s = sum(w for w, _, _ in part), sum(w * y for w, _, y in part)
        best = None
        for f in range(len(FEATURES)) if left else ():
            for cut in sorted({x[f] for _, x, _ in part})[:-1]:
                ln = sum(w for w, x, _ in part if x[f] <= cut)
                ls = sum(w * y for w, x, y in part if x[f] <= cut)
                apart = float(ls) * float(n - ln) - float(s - ls) * float(ln)
                gain = apart * apart / (float(ln) * float(n - ln)) / float(n)
                if gain > 0 and (best is None or gain > best[2]):
                    best = (f, cut, gain)
        nodes[tree, node] = (n, s / n, FEATURES[best[0]] if best else None, best and float(best[1]), best and best[2])
        if best:
            visit(tree, 2 * node, [p for p in part if p[1][best[0]] <= best[1]], left - 1)
            visit(tree, 2 * node + 1, [p for p in part if p[1][best[0]] > best[1]], left - 1)

    for tree in range(1, trees + 1):
        part = [(draws(r[0], tree, seed), r[1:4], r[4]) for r in rows]
        visit(tree, 1, [p for p in part if p[0]], depth)
    return nodes


def collected(nodes) -> dict:
    return {(r.Tree, r.Node): (r.Rows, r.Prediction, r.Feature, r.Threshold, r.Gain) for r in nodes.collect()}


def test_nodes_equal_a_search_of_every_cut(spark):
    rows = data()
    nodes = forest.grow_forest(spark.createDataFrame(rows, SCHEMA), FEATURES, "y", KEYS, 3, 4, 42)
    expected = grown(rows, 3, 4, 42)
    assert collected(nodes) == expected and len(expected) > 20


def test_placement_does_not_change_the_forest(spark):
    df = spark.createDataFrame(data(), SCHEMA)
    one, many = (forest.grow_forest(d, FEATURES, "y", KEYS, 2, 3, 1) for d in (df.coalesce(1), df.repartition(7, "a")))
    assert collected(one) == collected(many)


def test_rows_reach_the_mean_of_their_leaves(spark):
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = forest.grow_forest(df, FEATURES, "y", KEYS, 3, 4, 42)
    got = {r.k: r.Fitted for r in forest.predict(df, nodes, FEATURES, KEYS, 3, 4).collect()}
    table = grown(rows, 3, 4, 42)
    for key, *x, _ in rows:
        leaves = []
        for tree in (1, 2, 3):
            node = 1
            while (at := table[tree, node])[2]:
                node = 2 * node + (x[FEATURES.index(at[2])] > at[3])
            leaves.append(at[1])
        assert got[key] == pytest.approx(sum(leaves) / 3, abs=1e-4)


def test_importance_is_the_share_of_the_gain(spark):
    nodes = forest.grow_forest(spark.createDataFrame(data(), SCHEMA), FEATURES, "y", KEYS, 3, 4, 42)
    got = {r.Feature: r.Importance for r in forest.importance(nodes, FEATURES).collect()}
    shares = dict.fromkeys(FEATURES, 0.0)
    table = grown(data(), 3, 4, 42)
    for tree in (1, 2, 3):
        gains = [(n[2], n[4]) for (t, _), n in table.items() if t == tree and n[2]]
        for feature, gain in gains:
            shares[feature] += gain / sum(g for _, g in gains) / 3
    assert got == pytest.approx(shares, abs=1e-8) and got["c"] == 0 and sum(got.values()) == pytest.approx(1)


def test_many_values_share_bins_and_edges_are_values(spark):
    rows = [(f"k{i}", i * i, float(i % 2), 0, i) for i in range(500)]
    edges = forest.bin_edges(spark.createDataFrame(rows, SCHEMA), FEATURES)
    assert len(edges[0]) <= forest.BINS and edges[0][-1] == 499 ** 2 and {math.isqrt(int(e)) ** 2 - int(e) for e in edges[0]} == {0}
    assert edges[1] == [0.0, 1.0] and edges[2] == [0.0]
    sizes = np.diff([-1, *[math.isqrt(int(e)) for e in edges[0]]])
    assert sizes.max() <= 3 * 500 / forest.BINS


def test_constant_target_and_empty_rows(spark):
    same = spark.createDataFrame([(f"k{i}", i, 0.0, 0, 5) for i in range(20)], SCHEMA)
    nodes = forest.grow_forest(same, FEATURES, "y", KEYS, 2, 3, 42)
    assert [(r.Node, r.Prediction, r.Feature) for r in nodes.collect()] == [(1, 5.0, None)] * 2
    assert {r.Importance for r in forest.importance(nodes, FEATURES).collect()} == {0.0}
    assert forest.grow_forest(same.where("k = ''"), FEATURES, "y", KEYS, 2, 3, 42).count() == 0
    stump = forest.grow_forest(same, FEATURES, "y", KEYS, 2, 0, 42)
    assert stump.count() == 2 and stump.columns == nodes.columns

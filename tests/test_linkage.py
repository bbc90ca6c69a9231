"""Linkage operators against plain versions."""

import math
import random
from itertools import combinations

import pytest

from linkloom.operators.graph import components_by_doc, divisive_partition, spanning_forest
from linkloom.operators.knn import knn_join, knn_join_cells
from linkloom.operators.linkage import agglomerate, best_threshold, curriculum, cut_for, single_linkage_pairs, threshold_sweep


@pytest.fixture(scope="module")
def graph(spark):
    draw = random.Random(8)
    nodes = [(d, 10 * d + n, draw.randint(0, 2)) for d in range(5) for n in range(7)]
    edges = [(d, a, b, round(draw.random(), 2), g == h) for (d, a, g), (e, b, h) in combinations(nodes, 2) if d == e]
    return nodes, edges, spark.createDataFrame(nodes, "doc long, node long, gold long"), spark.createDataFrame(edges, "doc long, src long, dst long, affinity double, same boolean")


def scores(truth, found):
    both = lambda f: sum(f(x, y) for x, y in combinations(truth, 2))
    hits, a, b = both(lambda x, y: truth[x] == truth[y] and found[x] == found[y]), both(lambda x, y: truth[x] == truth[y]), both(lambda x, y: found[x] == found[y])
    by_chance = a * b / math.comb(len(truth), 2)
    return round(hits / math.sqrt(a * b), 6) if hits else 0.0, round((hits - by_chance) / ((a + b) / 2 - by_chance), 6)


def test_threshold_sweep(graph):
    nodes, _, n, e = graph
    truth = {x: (d, g) for d, x, g in nodes}
    sweep = threshold_sweep(n, e)
    rows = sweep.collect()
    assert rows
    for r in random.Random(1).sample(rows, 6):
        found = {c["node"]: c["component"] for c in components_by_doc(n, e, r["threshold"]).collect()}
        assert (r["fmi"], r["ari"]) == scores(truth, found)
    assert best_threshold(sweep).first()["ari"] == max(r["ari"] for r in rows)


@pytest.mark.parametrize(("method", "alpha"), [("average", 0.0), ("exponential", -20.0), ("exponential", 5.0)])
def test_agglomerate(graph, method, alpha):
    nodes, edges, _, e = graph
    rows = sorted(map(tuple, agglomerate(e, method, alpha or -20.0).collect()))
    want = []
    for doc in range(5):
        d = {frozenset((a, b)): round(1 - w, 6) for x, a, b, w, _ in edges if x == doc}
        parts = [[x] for k, x, _ in nodes if k == doc]

        def cost(p, q, d=d):
            ds = [d[frozenset((x, y))] for x in p for y in q]
            ws = [math.exp(alpha * (v - min(ds))) for v in ds]
            return sum(v * w for v, w in zip(ds, ws, strict=True)) / sum(ws)

        step = 0
        while len(parts) > 1:
            c, p, q = min((round(cost(p, q), 9), p, q) for p, q in combinations(sorted(parts), 2))
            pairs = [(d[frozenset((x, y))] * (-1 if alpha > 0 else 1), x, y) for x in p for y in q]
            _, x, y = min(pairs)
            want.append((doc, step, p[0], q[0], round(c, 6), min(x, y), max(x, y)))
            parts = [r for r in parts if r not in (p, q)] + [sorted(p + q)]
            step += 1
    assert [r[:4] for r in rows] == [r[:4] for r in want]
    assert [r[4] for r in rows] == pytest.approx([r[4] for r in want], abs=2e-6)
    assert [r[5:] for r in rows] == [r[5:] for r in want]


def test_single_linkage_pairs(graph):
    nodes, edges, _, e = graph
    far, want = 0.3, set()
    d = {(a, b): round(1 - w, 6) for _, x, y, w, _ in edges for a, b in ((x, y), (y, x))}
    gold = {x: (k, g) for k, x, g in nodes}
    outside = lambda x: [(d[x, y], y) for y in gold if (x, y) in d and gold[y] != gold[x]]
    for group in set(gold.values()):
        members = [x for x in gold if gold[x] == group]
        part = {x: x for x in members}
        for a, b in sorted(combinations(members, 2), key=lambda p: (d[p], p)):
            if part[a] == part[b]:
                continue
            part = {x: part[a] if p == part[b] else p for x, p in part.items()}
            o = min([v for x in (a, b) for v, _ in outside(x)], default=math.inf)
            if o < d[a, b] or o < far or d[a, b] > far:
                want |= {(group[0], 1.0, a, b), (group[0], 1.0, b, a)} | {(group[0], -1.0, x, min(outside(x))[1]) for x in (a, b) if outside(x)}
    assert sorted(map(tuple, single_linkage_pairs(e, far).collect())) == sorted(want)


def test_no_edges(graph):
    _, _, n, e = graph
    none = e.limit(0)
    assert threshold_sweep(n, none).count() == agglomerate(none).count() == single_linkage_pairs(none).count() == 0
    with pytest.raises(ValueError):
        agglomerate(e, "complete")


def test_cells(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(3 * (i % 4 == j), 1) for j in range(4)]) for i in range(400)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    exact, near = knn_join(v, v, 5), lambda probes: set(map(tuple, knn_join_cells(v, v, 5, 8, probes).select("query", "neighbour", "rank").collect()))
    want = set(map(tuple, exact.select("query", "neighbour", "rank").collect()))
    assert near(8) == want
    assert len({x[:2] for x in near(4)} & {x[:2] for x in want}) >= 0.9 * len(want)


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(0, 2, 0.9, True), (2, 3, 0.2, False), (1, 3, 0.8, True)], {2: 0, 3: 1}),
        ([(0, 2, 0.9, True), (2, 3, 0.8, False), (1, 3, 0.1, True)], {2: 0, 3: 0}),
        ([(0, 2, 0.5, True), (1, 2, 0.5, True), (2, 3, 0.9, False)], {2: None, 3: None}),
        ([(0, 2, 0.5, True), (1, 2, 0.7, True), (2, 3, 0.1, False)], {2: 1, 3: None}),
        ([(2, 3, 0.5, False)], {2: None, 3: None}),
    ],
)
def test_divisive_partition(spark, edges, want):
    df = spark.createDataFrame([(1, *e) for e in edges], "doc long, src long, dst long, affinity double, to_entity boolean")
    assert {r["mention"]: r["entity"] for r in divisive_partition(df).collect()} == want


def test_curriculum(graph):
    nodes, edges, n, e = graph
    forest = spanning_forest(e)
    weights = sorted({r["affinity"] for r in forest.collect()})
    size = lambda t: len({r["component"] for r in components_by_doc(n, e, t).collect()})
    for parts in (1, 12, 35):
        cut = cut_for(n, forest, parts)
        assert cut == next((w for w in weights if size(w) >= parts), float("inf"))
    found = {r["node"]: r["component"] for r in components_by_doc(n, e, cut_for(n, forest, 12)).collect()}
    first = sorted((min(found[x] for _, x, h in nodes if h == g), g) for g in {g for _, _, g in nodes})
    assert sorted(map(tuple, curriculum(n, e, 12).select("place", "component", "gold").collect())) == [(i, c, g) for i, (c, g) in enumerate(first)]

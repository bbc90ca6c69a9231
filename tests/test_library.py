"""Operators against plain versions, and corpora from files to results."""

import json
import math
import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from linkloom.__main__ import run
from linkloom.functions.records import merge_maps, pack_id, unpack_id
from linkloom.functions.wordpiece import pieces_of, read_vocabulary, wordpiece_ids
from linkloom.operators.components import connected_components, global_forest
from linkloom.operators.graph import spanning_forest
from linkloom.operators.knn import knn_join
from linkloom.operators.lineage import shared_folder
from linkloom.operators.linkage import cluster_pairs, exponential_pairs, sweep_at, threshold_candidates, threshold_sweep
from linkloom.operators.linking import linking_examples
from linkloom.operators.negatives import choose_negatives
from linkloom.operators.numbering import dense_index
from linkloom.operators.pairs import make_examples, make_pairs
from linkloom.operators.scoring import arrow_scorer, edge_affinities
from linkloom.options import Options, parsed
from linkloom.sources.corpus import index_corpus, read_corpus
from linkloom.sources.store import look_up, write_examples


@pytest.fixture(scope="module")
def graph(spark):
    draw = random.Random(12)
    nodes = [(d, 10 * d + n, draw.randint(0, 2)) for d in range(4) for n in range(6)]
    edges = [(d, a, b, round(draw.random(), 2)) for (d, a, _), (e, b, _) in combinations(nodes, 2) if d == e]
    return nodes, edges, spark.createDataFrame(nodes, "doc long, node long, gold long"), spark.createDataFrame(edges, "doc long, src long, dst long, affinity double")


def test_dense_index(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abc"), i) for i in draw.sample(range(9999), 700)]
    df = spark.createDataFrame(rows, "k string, v long")
    assert [tuple(r) for r in dense_index(df, ["k", "v"], "at", 8, 5).orderBy("at").collect()] == [(k, v, i + 5) for i, (k, v) in enumerate(sorted(rows))]
    assert dense_index(df.limit(0), ["v"], "at").count() == 0 and dense_index(df.limit(1), ["v"], "at").first()["at"] == 0


def test_global_graphs(spark, graph):
    draw = random.Random(2)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for p in pairs for x in p if p[0] != p[1]}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want
    edges = [(a, b, round(draw.random(), 1)) for a, b in {tuple(sorted(p)) for p in pairs} if a != b] + [(100 + i, 101 + i, 0.5) for i in range(20)]
    df = spark.createDataFrame(edges, "src long, dst long, affinity double")
    whole = spanning_forest(df.withColumn("doc", F.lit(0).cast("long"))).select("src", "dst", "affinity")
    assert sorted(map(tuple, global_forest(df).collect())) == sorted(map(tuple, whole.collect()))
    assert global_forest(df.limit(0)).count() == 0


def test_knn_blocks(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    v = spark.createDataFrame(rows, "id long, vec array<double>")
    monkeypatch.setattr("linkloom.operators.knn.BLOCK", 30)
    monkeypatch.setattr("linkloom.operators.knn.PACK", 7)
    want = [(q, n, s, r) for q, x in rows for r, (s, n) in enumerate(sorted((round(-sum(a * b for a, b in zip(x, y, strict=True)), 6), n) for n, y in rows)[:4], 1)]
    assert sorted((a, b, -s, r) for a, b, s, r in map(tuple, knn_join(v, v, 4).collect())) == sorted((q, n, s, r) for q, n, s, r in want)
    assert knn_join(v, v).count() == 120 * 120 and knn_join(v, v.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        knn_join(v, v, 1, include=v, exclude=v)


def test_sweep_at_any_threshold(spark, graph):
    _, _, n, e = graph
    swept = {r["threshold"]: tuple(r) for r in threshold_sweep(n, e).collect()}
    at = spark.createDataFrame([(t,) for t in swept], "threshold double")
    assert {r["threshold"]: tuple(r) for r in sweep_at(n, e, at).collect()} == swept
    low = sweep_at(n, e, spark.createDataFrame([(-1.0,), (2.0,)], "threshold double")).collect()
    assert {r["threshold"]: r["fmi"] > 0 for r in low} == {-1.0: True, 2.0: False}
    weights = spark.createDataFrame([(x,) for x in [0.1, 0.11, 0.5, 0.51, 0.9]], "affinity double")
    assert threshold_candidates(weights, 6).count() == 5
    assert sorted(round(r[0], 3) for r in threshold_candidates(weights, 3).collect()) == [0.105, 0.505, 0.9]


def test_exponential_pairs(graph):
    nodes, edges, n, e = graph
    alpha, margin, far, want = -20.0, 0.1, 0.3, []
    for doc in range(4):
        gold = {x: g for d, x, g in nodes if d == doc}
        dist = {frozenset((a, b)): round(1 - w, 6) for d, a, b, w in edges if d == doc}
        parts, step = [[x] for x in sorted(gold)], 0

        def weights(p, q, dist=dist):
            w = {(x, y): math.exp(alpha * (dist[frozenset((x, y))] - min(dist.values()))) for x in p for y in q}
            return w, sum(w.values()), sum(v * dist[frozenset(k)] for k, v in w.items()) / sum(w.values())

        while True:
            merges = {True: [], False: []}
            for p, q in combinations(sorted(parts), 2):
                merges[gold[p[0]] == gold[q[0]]].append((weights(p, q)[2], p, q))
            if not merges[True]:
                break
            pure, impure = min(merges[True]), min(merges[False], default=(math.inf, [], []))
            if pure[0] + margin > impure[0] or pure[0] > far:
                for sign, (c, p, q) in ((1, pure), (-1, impure)):
                    if c < math.inf:
                        w, total, _ = weights(p, q)
                        want += [(doc, step, round(sign * v / total, 6), min(k), max(k)) for k, v in w.items()]
            parts = [x for x in parts if x not in (pure[1], pure[2])] + [sorted(pure[1] + pure[2])]
            step += 1
    got = [tuple(r) for r in exponential_pairs(n, e, alpha, margin, far).collect()]
    key = lambda r: (r[0], r[1], r[3], r[4], r[2] > 0)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
    assert [r[2] for r in sorted(got, key=key)] == pytest.approx([r[2] for r in sorted(want, key=key)], abs=2e-6)


@pytest.mark.parametrize("first", [False, True])
def test_cluster_pairs(spark, first):
    draw = random.Random(21)
    gold = {100 + m: draw.randint(0, 3) for m in range(24)}
    mm = {(a, b): round(draw.random() + (0 if gold[a] == gold[b] else 0.2), 3) for a, b in combinations(sorted(gold), 2) if draw.random() < 0.5}
    me = {(m, e): round(draw.random(), 3) for m in gold for e in range(4) if e == gold[m] or draw.random() < 0.5}
    rows = [(a, b, "mm", d) for (a, b), d in mm.items()] + [(a, b, "me", d) for (a, b), d in me.items()]
    far, margin = 0.4, 0.3
    got = cluster_pairs(spark.createDataFrame(list(gold.items()), "node long, entity long"), spark.createDataFrame(rows, "src long, dst long, kind string, distance double"), far, margin, first).collect()
    positive, negative = set(), {}
    for e in range(4):
        own = [(d, a, b, k) for a, b, k, d in rows if gold[a] == e and (b == e if k == "me" else gold[b] == e)]
        name = lambda x, k: 2 * x + (k == "me")
        part, tree = {}, 0
        find = lambda x: x if part.setdefault(x, x) == x else find(part[x])  # noqa: B023, E731
        order = lambda t: (t[0], *sorted((name(t[1], "mm"), name(t[2], t[3]))))  # noqa: B023, E731
        for d, a, b, k in sorted((x for x in own if not first or x[3] == "mm"), key=order):
            x, y = find(name(a, "mm")), find(name(b, k))
            if x != y:
                part[x] = y
                tree += 1
                if d > far:
                    positive.add((e, k, 0.0, a, b))
        if first:
            positive |= {(e, "me", 0.0, a, b) for d, a, b, k in own if k == "me"}
        out = {(e, k, 1.0, a, b) for a, b, k, d in rows if d < far + margin and (gold[a] == e) != (gold.get(b) == e if k == "mm" else False) and not (k == "me" and gold[a] == b)}
        out |= {(e, k, 1.0, a, b) for a, b, k, d in rows if k == "mm" and d < far + margin and gold[a] != gold[b] and e in (gold[a], gold[b])}
        negative[e] = (out, (tree + 1) / max(1, len(out)))
    got = {tuple(r) for r in got}
    assert {r for r in got if r[2] == 0.0} == positive
    for e, (out, chance) in negative.items():
        mine = {r for r in got if r[2] == 1.0 and r[0] == e}
        assert mine <= out and (mine == out if chance >= 1 else abs(len(mine) - chance * len(out)) < 4 * math.sqrt(len(out)) + 1)


def test_scorers(spark):
    nodes = spark.createDataFrame([(0, True, [1.0]), (1, False, [2.0]), (2, False, [4.0])], "idx long, is_entity boolean, feature array<double>")
    edges = spark.createDataFrame([(1, 2, "x"), (2, 1, "y"), (2, 0, "z"), (1, 9, "no")], "a long, b long, tag string")
    calls = arrow_scorer(lambda a, b: a.str[0] - 2 * b.str[0])
    got = {r["tag"]: r["affinity"] for r in edge_affinities(edges, nodes, calls, lambda a, b: F.get(a, F.lit(0)) * 10).collect()}
    assert got == {"x": -3.0, "y": -3.0, "z": 25.0}


def test_methods_by_name(spark):
    members = spark.createDataFrame([("c", 0), ("c", 5), ("c", 6), ("c", 7)], "cluster string, member long")
    scores = spark.createDataFrame([(0, 5, 0.9), (0, 6, 0.1), (0, 7, 0.2), (5, 6, 0.8), (5, 7, 0.3), (6, 7, 0.7), (5, 1, 0.4), (5, 8, 0.6), (5, 9, 0.5), (5, 2, 0.45)], "a long, b long, affinity double")
    known = spark.createDataFrame([(5, 0, 0), (5, 1, 1)], "midx long, eidx long, place int")
    lists = {r["anchor"]: (r["pos"], r["neg"]) for r in make_pairs("all_pairs", members, scores, known, 3, 2).collect()}
    assert lists == {5: ([0, 6, 7], [8, 2]), 6: ([5, 7], []), 7: ([5, 6], [])}
    lists = {r["anchor"]: (r["pos"], r["neg"]) for r in make_pairs("mst", members, scores, known, 3, 3, "all").collect()}
    assert lists == {5: ([0, 6], [8, 9, 2]), 6: ([5, 7], []), 7: ([6], [])}
    df = spark.createDataFrame([("c", 1, [2], [3, 4, 5, 6, 7]), ("c", 8, [], [3]), ("c", 9, [2], [])], "cluster string, anchor long, pos array<long>, neg array<long>")
    assert [(r["anchor"], r["pos"], r["neg"]) for r in make_examples("triplet", df).collect()] == [(1, 2, n) for n in (3, 4, 5, 6, 7)]
    assert [r["negs"] for r in make_examples("softmax", df, negatives=2).collect()] == [[3, 4], [5, 6], [7, 3]]
    scaled = [tuple(r)[1:] for r in make_examples("threshold", df).collect()]
    assert (1, 2, 1.0, 4) in scaled and (9, 2, 1.0, 1) in scaled and len(scaled) == 8
    for bad in (lambda: make_pairs("none"), lambda: make_examples("none", df), lambda: make_examples("softmax", df, negatives=0), lambda: make_pairs("all_pairs", members, scores, known, 3, 2, "e-e"), lambda: choose_negatives(df, df, df, 2, "none")):
        with pytest.raises((ValueError, KeyError, Exception)):
            bad()


def test_linking_examples(spark):
    gold = spark.createDataFrame([(10, 0), (11, 3), (12, 1), (13, None)], "midx long, eidx long")
    cands = spark.createDataFrame([(10, 0, 0), (10, 1, 2), (10, 2, 4), (11, 0, 1), (12, 0, 1)], "midx long, place int, eidx long")
    got = {(r["midx"], r["chunk"]): (r["positive"], r["negatives"]) for r in linking_examples(gold, cands, 5, 4, 2).collect()}
    assert {k: v for k, v in got.items() if k[0] in (10, 11)} == {(10, 0): (0, [2]), (10, 1): (0, [4]), (11, 0): (None, [1, 1]), (11, 1): (None, [1, 1])}
    assert (12, 0) not in got and got[(13, 0)][0] is None and all(0 <= x < 5 for c in (0, 1) for x in got[(13, c)][1])
    forced = {(r["midx"], r["chunk"]): r["positive"] for r in linking_examples(gold, cands, 5, 4, 2, True).collect()}
    assert forced[(11, 0)] == 3


def test_records(spark):
    df = spark.createDataFrame([("abc", {"x": 1, "y": 2}, {"y": 3, "z": 4}), ("0123456789abcdef", {}, {"q": 1}), ("0123456789abcdefg", {}, {})], "uid string, a map<string,int>, b map<string,int>")
    rows = df.select(pack_id(F.col("uid")).alias("p"), unpack_id(pack_id(F.col("uid"))).alias("u"), merge_maps(F.col("a"), F.col("b")).alias("m")).collect()
    import struct

    assert rows[0]["p"] == list(struct.unpack("<LLLL", b"abc" + b"n" * 13)) and rows[0]["u"] == "abc" and rows[1]["u"] == "0123456789abcdef" and rows[2]["p"] is None
    assert rows[0]["m"] == {"x": 1, "y": 5, "z": 4}


def test_wordpiece(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    words = ["[UNK]", "un", "##aff", "##able", "a", "##b", "##c", "b", "ab", "##bc"]
    (tmp_path / "vocab.txt").write_text("\n".join(words) + "\n")
    vocabulary = read_vocabulary(str(tmp_path / "vocab.txt"))
    model = tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=100)
    asked = ["unaffable", "abc", "a", "abcx", "bb", "", "cab", "a" * 101]
    for w in asked:
        assert pieces_of(w, vocabulary, 0) == ([t.id for t in model.tokenize(w)] if w else [])
    df = spark.createDataFrame([(asked,), (None,), ([],)], "t array<string>")
    assert [r[0] for r in df.select(wordpiece_ids(F.col("t"), vocabulary)).collect()] == [[x for w in asked for x in pieces_of(w, vocabulary, 0)], None, []]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for name in ("documents", "mentions", "tfidf_candidates"):
        (root / name).mkdir()
    dump = lambda path, rows: (root / path).write_text("\n".join(map(json.dumps, rows)))
    dump("documents/val.json", [{"document_id": f"d{i}", "text": f"the  cat {i} sat on\tthe mat of entity {i % 2}"} for i in range(4)])
    dump("documents/world.json", [{"document_id": f"e{i}", "text": f"entity {i} is a thing"} for i in range(3)])
    spans = [(f"m{i}{j}", f"d{i}", f"e{j}", j, j + 1, " ".join(f"the cat {i}".split()[j : j + 2])) for i, j in product(range(4), range(2))]
    spans += [("bad", "d0", "e0", 0, 0, "dog"), ("lost", "d9", "e0", 0, 0, "the"), ("unknown", "d1", "e9", 0, 0, "the")]
    dump("mentions/val.json", [dict(zip(("mention_id", "context_document_id", "label_document_id", "start_index", "end_index", "text"), s, strict=True), category="x") for s in spans])
    dump("tfidf_candidates/val.json", [{"mention_id": s[0], "tfidf_candidates": ["e9", "e1", "e0"]} for s in spans if s[0] != "m00"])
    draw = random.Random(5)
    uids = [f"e{i}" for i in range(3)] + [s[0] for s in spans]
    spark.createDataFrame([(u, [draw.gauss(0, 1) for _ in range(4)]) for u in uids], "uid string, vec array<double>").write.parquet(str(root / "vectors"))
    return str(root)


def test_corpus_from_files(spark, files):
    found = index_corpus(read_corpus(spark, files, "val", ["val", "world"]), 8)
    nodes = {r["uid"]: (r["idx"], r["kind"]) for r in found.nodes.collect()}
    assert [nodes[f"e{i}"] for i in range(3)] == [(i, "entity") for i in range(3)] and len(nodes) == 14 and "d0" not in nodes
    assert sorted(r[0] for r in found.broken.collect()) == ["bad", "lost"]
    assert {r["midx"]: r["eidx"] for r in found.gold.collect()}[nodes["unknown"][0]] is None
    assert [tuple(r) for r in found.candidates.filter(F.col("midx") == nodes["m01"][0]).orderBy("place").collect()] == [(nodes["m01"][0], 0, 1), (nodes["m01"][0], 1, 0)]
    examples = {r["idx"]: r["context"] for r in found.examples.collect()}
    assert examples[nodes["m10"][0]] == ["[START]", "the", "cat", "[END]", "1", "sat", "on", "the"] and examples[0] == ["[START_ENT]", "entity", "0", "is", "a", "thing", "[END_ENT]"]
    path = f"{shared_folder(spark)}/test-store"
    write_examples(found.examples, path, 4)
    assert [r["idx"] for r in look_up(spark, path, spark.createDataFrame([(0,), (0,), (99,)], "idx long"), 4).collect()] == [0]


def test_command_line(spark, files, tmp_path):
    base = ["--root", files, "--domains", "val", "world", "--embeddings", f"{files}/vectors", "--context", "8"]
    command, options = parsed(["evaluate", *base, "--results", str(tmp_path / "out"), "--split", "val"])
    row = run(spark, command, options).first().asDict()
    assert list(row) == [f"val_concat_{m}" for m in ("fmi", "rand_index", "threshold", "vanilla_recall", "vanilla_accuracy", "joint_accuracy", "joint_cc_recall")] and row["val_concat_vanilla_recall"] > 0
    assert spark.read.parquet(str(tmp_path / "out/links")).count() == 10
    for kind in ("triplet", "softmax", "threshold"):
        assert run(spark, *parsed(["examples", *base, "--k", "4", "--quota", "4", "--row-negatives", "2", "--example-kind", kind])).count() > 0
    for bad in ({"mention_negatives": "candidates_only"}, {"k": 0}):
        with pytest.raises(ValueError):
            Options(**bad)


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        shared_folder(Session)

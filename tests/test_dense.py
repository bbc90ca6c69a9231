"""Operators on documents' vectors against the same on all their pairs as rows."""

import random
import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions.vectors import dot
from linkloom.operators import components, dense, knn, linkage, numbering
from linkloom.operators.graph import Union as dense_union
from linkloom.operators.graph import spanning_forest
from linkloom.operators.knn import knn_join, knn_without
from linkloom.operators.lineage import shared_folder
from linkloom.operators.linkage import agglomerate, agglomerate_vectors, exponential_pairs, exponential_pairs_of_vectors, threshold_candidates, threshold_sweep
from linkloom.plans.evaluation import evaluate, link_affinities
from linkloom.plans.library import QUERIES, skewed
from linkloom.plans.registry import QUERIES as QUERIES_ALL
from linkloom.plans.relations import RELATIONS
from linkloom.sources.store import read_results, write_results

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    """Documents of many ties, of one mention, and with a null vector."""
    draw = random.Random(5)
    rows = [(d, 100 * d + n, draw.randint(0, 2), [draw.choice([0.0, 0.5, 0.25]) for _ in range(4)]) for d in range(3) for n in range(23)] + [(7, 701, 0, [1.0, 0.0, 0.0, 0.0])]
    rows[5] = (*rows[5][:3], None)
    return rows, spark.createDataFrame(rows, "doc long, node long, gold long, vec array<double>").repartition(3).cache()


@pytest.fixture
def small(monkeypatch):
    """Tiles smaller than the documents."""
    monkeypatch.setattr(dense, "TILE", 5)


@pytest.fixture(scope="module")
def pairs(spark, vectors):
    """The same pairs, joined."""
    v = vectors[1]
    both = v.alias("a").join(v.alias("b"), F.expr("a.doc = b.doc and a.node < b.node"))
    return both.select("a.doc", F.col("a.node").alias("src"), F.col("b.node").alias("dst"), F.round(dot(F.col("a.vec"), F.col("b.vec")), 6).alias("affinity"), F.expr("a.gold = b.gold").alias("same")).cache()


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_pairs(vectors, pairs, small):
    assert rows(dense.document_pairs(vectors[1])) == rows(pairs)
    assert rows(dense.document_pairs(vectors[1], above=0.3)) == rows(pairs.filter("affinity > 0.3"))


def test_products_round_as_spark_does():
    x, y = np.array([[0.5, 0.25]]), np.array([[0.000001, 0.0], [0.000003, 0.0], [-0.000001, 0.0], [0.0, 0.0]])
    assert dense.products(x, y).tolist() == [[0.000001, 0.000002, -0.000001, 0.0]]


def test_forest(vectors, pairs, small):
    want = rows(spanning_forest(pairs))
    assert rows(dense.document_forest(vectors[1])) == want
    assert dense.tile_forests(vectors[1]).count() < pairs.count()


def test_near(vectors, pairs, small):
    ends = pairs.select("doc", F.col("src").alias("a"), F.col("dst").alias("b"), "affinity").unionByName(pairs.select("doc", F.col("dst").alias("a"), F.col("src").alias("b"), "affinity"))
    want = ends.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("affinity"), "b"))).filter("r <= 4")
    assert rows(dense.document_near(vectors[1], 4)) == rows(want)
    first = lambda df: rows(df.groupBy("a").agg(F.slice(F.sort_array(F.collect_list("b")), 1, 3).alias("l")))
    assert first(dense.document_first(vectors[1], 3, 0.3)) == first(ends.filter("affinity > 0.3"))


@pytest.mark.parametrize(("method", "alpha"), [("average", -20.0), ("exponential", -20.0), ("exponential", 5.0)])
def test_agglomerate_vectors(vectors, pairs, method, alpha):
    """Merges of vectors are those of their pairs, ties and all; a plain search of all costs at each step finds them too."""
    got = sorted(map(tuple, agglomerate_vectors(vectors[1].filter("vec is not null"), method, alpha).collect()))
    own = pairs.filter("affinity is not null")
    assert got == sorted(map(tuple, agglomerate(own, method, alpha).collect()))
    edges = {(r["src"], r["dst"]): round(1 - r["affinity"], 6) for r in own.filter("doc = 1").collect()}
    ids = sorted({x for e in edges for x in e})
    sharp = alpha if method == "exponential" else 0.0
    d = np.ones((len(ids), len(ids)))
    for (a, b), x in edges.items():
        d[ids.index(a), ids.index(b)] = d[ids.index(b), ids.index(a)] = x
    weight = np.exp(sharp * (d - d.min()))
    top, live, want = weight * d, list(range(len(ids))), []
    while len(live) > 1:
        _, a, b = min((top[a, b] / weight[a, b], a, b) for a, b in combinations(live, 2))
        want.append((ids[a], ids[b]))
        for m in (top, weight):
            m[a] += m[b]
            m[:, a] += m[:, b]
        live.remove(b)
    assert [r[2:4] for r in got if r[0] == 1] == want


def test_exponential_pairs_of_vectors(vectors, pairs):
    v = vectors[1].filter("vec is not null")
    got, want = rows(exponential_pairs_of_vectors(v, margin=0.1)), rows(exponential_pairs(v, pairs.filter("affinity is not null"), margin=0.1))
    assert got == want and got


def test_sweep_of_forest(vectors, pairs, small):
    nodes = vectors[1].select("doc", "node", "gold")
    own = vectors[1].filter("vec is not null")
    assert rows(threshold_sweep(nodes, dense.document_forest(own))) == rows(threshold_sweep(nodes, pairs.filter("affinity is not null")))


def test_no_vectors(vectors):
    none = vectors[1].limit(0)
    assert dense.document_pairs(none).count() == dense.document_forest(none).count() == agglomerate_vectors(none).count() == exponential_pairs_of_vectors(none).count() == 0


def test_scores_of_blocks(spark, vectors):
    """A scorer's block gives what its columns do."""
    v = vectors[1].filter("vec is not null")
    mean = lambda a, b: F.round((skewed(a, b) + skewed(b, a)) / 2, 6)
    both = v.alias("a").join(v.alias("b"), F.expr("a.doc = b.doc and a.node < b.node")).select("a.doc", F.col("a.node").alias("src"), F.col("b.node").alias("dst"), mean(F.col("a.vec"), F.col("b.vec")).alias("affinity"))
    assert rows(dense.document_pairs(v, skewed.block).drop("same")) == rows(both)


def test_groups_apart(spark, vectors):
    """A banned group gives the neighbours that its banned pairs give."""
    v = vectors[1].filter("vec is not null").select(F.col("node").alias("id"), "vec", "gold")
    own = v.alias("a").join(v.alias("b"), F.expr("a.gold = b.gold")).select(F.col("a.id").alias("query"), F.col("b.id").alias("id"))
    assert rows(knn_without(v, v, own.limit(0), 3, apart="gold")) == rows(knn_without(v, v, own, 3))


def test_evaluation_without_blocks(spark, vectors, small):
    """A scorer that knows no blocks goes by pairs, to the same results."""
    v = vectors[1].filter("vec is not null")
    nodes = v.select(F.col("node").alias("idx"), F.lit(False).alias("is_entity"), F.col("vec").alias("feature")).unionByName(spark.createDataFrame([(g, True, [0.5 * (g == i) for i in range(4)]) for g in range(3)], "idx long, is_entity boolean, feature array<double>"))
    mentions = v.select(F.col("node").alias("midx"), "doc", "gold")
    candidates = mentions.select("midx", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("eidx"))
    for options in ({"threshold": 0.3}, {"available": "knn_candidates"}):
        blocks, plain = (evaluate(mentions, nodes, candidates, scorer, **options) for scorer in (dense_product, lambda a, b: dot(a, b)))
        for name in ("coreference", "linking", "partition", "metrics"):
            assert rows(blocks[name]) == rows(plain[name])


def dense_product(a, b):
    return dot(a, b)


dense_product.block = dense.products


def test_no_pair_is_shuffled_or_kept(spark):
    """The queries over all pairs of a document make them in tiles: no join by document, and none of them checkpointed by an evaluation."""
    for name in ("j5_within_doc_pairs", "p14_symmetric_closure", "t9_cyclic_replication", "u1_merged_graphs", "m1_pair_affinities", "j7_expanded_candidates", "g6_affinity_graph", "g11_exponential_linkage", "g18_average_merges", "g12_exponential_pairs"):
        plan = QUERIES_ALL[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "midx < midx" not in plan and "MapInArrow" in plan, name


def test_all_weights_are_candidates(spark):
    weights = spark.createDataFrame([(float(x),) for x in range(1500)], "affinity double")
    assert threshold_candidates(weights, None).count() == 1500


def test_heads_round_as_floats(spark, tmp_path):
    """The product of the float 0.0125 and 1000 is 12.5 as a float, and less as a double."""
    rows_ = [(i, [0.0125, 0.0145, 0.0155], i % 2) for i in range(9)]
    spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = ",".join(str(int(np.floor(np.float32(x) * np.float32(1000) + np.float32(0.5)))) for x in rows_[0][1])
    assert {r["head"] for r in QUERIES["s7_example_lookup"](spark, str(tmp_path)).collect()} == {want}


def test_ends(vectors, pairs, small):
    """Pairs above an affinity, from either end and out of the tiles so."""
    near = pairs.filter("affinity > 0.3")
    want = near.select("doc", "src", "dst", "affinity").union(near.select("doc", "dst", "src", "affinity"))
    assert rows(dense.document_ends(vectors[1], 0.3)) == rows(want)
    # 0.5 x 0.4000005 is a half of the last place, and rounds up to more than what it is.
    x, y = (dense.Rows([(np.zeros(n, int), np.arange(n), np.zeros(n, int), np.array(v), np.full(n, 2))]) for n, v in ((1, [[0.5, 0.0]]), (2, [[0.400001, 0.0], [0.4, 0.0]])))
    assert [c.tolist() for c in x.over(y, dense.products, 0.2)] == [[0], [0], [0.200001]]


def test_closure_makes_no_rows_after_its_tiles(spark):
    plan = QUERIES_ALL["p14_symmetric_closure"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.split("MapInArrow")[0]


def test_best_tree_of_ties():
    """The edges that Kruskal takes, whatever ties and missing affinities there are."""
    draw = np.random.default_rng(3)
    for whole in (True, False):
        for _ in range(60):
            r, c = draw.integers(1, 12, 2)
            s = draw.integers(0, 4, (r, r if whole else c)).astype(float)
            s[draw.random(s.shape) < 0.2] = dense.NONE
            s = np.maximum(s, s.T) if whole else s
            edges = [(-s[u, v if whole else v - r], u, v) for u in range(r) for v in (range(u + 1, r) if whole else range(r, r + c))]
            parts, want = dense_union(), set()
            for _, u, v in sorted(edges):
                if parts.root(u) != parts.root(v):
                    parts.join(u, v)
                    want.add((u, v))
            assert set(zip(*(x.tolist() for x in dense.best_tree(s, whole)), strict=True)) == want


def test_partition_makes_no_metrics(spark, monkeypatch):
    """A result of an evaluation is made without the others."""
    def never(*_):
        raise AssertionError

    for name in ("component_recall", "link_metrics", "sweep_at", "best_threshold"):
        monkeypatch.setattr(f"linkloom.plans.evaluation.{name}", never)
    assert QUERIES["g5_joint_predictions"](spark, SF).count() == 490


def test_small_base_is_held_by_many_tasks(spark, monkeypatch):
    """Queries of a base of one block go to as many tasks as they fill, and find what they find in one."""
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, vec array<double>")
    want = rows(knn_join(v, v.filter("id < 9"), 3))
    monkeypatch.setattr(knn, "BLOCK", 10)
    monkeypatch.setattr(knn, "PACK", 5)
    many = knn_join(v, v.filter("id < 9"), 3)
    assert rows(many) == rows(knn_join(v, v.filter("id < 9")).filter("rank <= 3")) == want
    assert re.search(r"RepartitionByExpression \[block#\d+\], 6\b", many._jdf.queryExecution().optimizedPlan().toString())


def test_few_edges_are_one_tasks_own(spark, monkeypatch):
    """Few edges are joined without rounds, to the components that rounds find; a symmetric scorer is asked once."""
    edges = spark.createDataFrame([(1, 2), (2, 9), (4, 3), (5, 5), (9, 7)], "a long, b long")
    monkeypatch.setattr(components, "FEW", 0)
    want = rows(components.connected_components(edges))
    monkeypatch.undo()

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(components, "star", never)
    assert rows(components.connected_components(edges)) == want == rows(spark.createDataFrame([(1, 1), (2, 1), (7, 1), (9, 1), (3, 3), (4, 3)], "node long, component long"))
    asked = []

    def scorer(a, b):
        asked.append(1)
        return dot(a, b)

    scorer.symmetric = True
    nodes = spark.createDataFrame([(0, True, [1.0]), (1, False, [0.5])], "idx long, is_entity boolean, feature array<double>")
    pairs = spark.createDataFrame([(1, 0)], "midx long, eidx long")
    assert rows(link_affinities(pairs, nodes, scorer)) == ["(1, 0, 0.5)"] and asked == [1]


def test_numbers_of_a_small_table_take_one_job(spark):
    """A sample that has all rows is numbered as it is, without counts of parts."""
    df = spark.createDataFrame([(f"k{i:02}",) for i in range(40)], "k string")
    plan = numbering.dense_index(df, ["k"], "at", start=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" not in plan
    assert [tuple(r) for r in numbering.dense_index(df, ["k"], "at", 2, 3).orderBy("at").collect()] == [(f"k{i:02}", i + 3) for i in range(40)]


def test_saved_pairs_are_matrices(spark, vectors, pairs, small, monkeypatch, tmp_path):
    """Pairs are saved as matrices, and read as the rows that they are."""
    monkeypatch.setattr(dense, "HELD", 2)
    write_results({"coreference": dense.document_blocks(vectors[1])}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "coreference")).count() < pairs.count() / 5
    assert rows(read_results(spark, str(tmp_path), ["coreference"])["coreference"]) == rows(pairs.drop("same"))
    assert rows(pairs.drop("same").filter("affinity is null"))


def test_saved_evaluation_writes_no_row_a_pair(spark):
    QUERIES["s9_saved_evaluation"](spark, SF)
    root = max(Path(re.sub("^file:/*", "/", shared_folder(spark))).glob("evaluation-*"), key=lambda p: p.stat().st_mtime)
    pairs = RELATIONS["gp"](spark, SF).drop("same")
    kept = spark.read.parquet(f"{root}/coreference")
    assert dict(kept.dtypes)["affinity"] == "binary"
    assert rows(read_results(spark, str(root), ["coreference"])["coreference"]) == rows(pairs)


def test_threshold_centres(spark):
    """Means of runs that no round moves, no worse than k-means by rounds over rows; ties count as often as they are there."""
    draw = np.random.default_rng(4)
    w = np.round(np.r_[draw.normal(0.3, 0.1, 900), draw.normal(-0.2, 0.02, 500), np.full(300, 0.25)], 2)
    df = spark.createDataFrame([(float(x),) for x in w], "affinity double")
    got = np.sort([r[0] for r in threshold_candidates(df, 12).collect()])
    own = np.abs(w[:, None] - got).argmin(1)
    assert len(got) == 12 and np.allclose([w[own == i].mean() for i in range(12)], got)
    start = KMeans(k=12, seed=0, maxIter=20).fit(df.select(array_to_vector(F.array("affinity")).alias("features")))
    assert ((w - got[own]) ** 2).sum() <= 1.2 * start.summary.trainingCost
    assert threshold_candidates(df, 1000).count() == len(np.unique(w))
    assert "KMeans" not in linkage.threshold_candidates.__code__.co_names

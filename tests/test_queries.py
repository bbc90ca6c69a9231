"""Queries against DuckDB on the smallest tables, and graph operators on micro-graphs and against brute force."""

import json
import random
from pathlib import Path

import duckdb
import pytest

from linkloom.operators.graph import components_by_doc, entity_partition, spanning_forest
from linkloom.plans.registry import ORACLE, QUERIES
from linkloom.sources.jsonl import load_or_create, read_candidates, read_documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(repr, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(repr, ([r[i] for i in at] for r in want.fetchall())))


@pytest.mark.parametrize(
    ("edges", "want"),
    [
        ([(0, 2, 0.9, True), (2, 3, 0.2, False), (1, 3, 0.8, True)], {2: 0, 3: 1}),
        ([(0, 2, 0.9, True), (2, 3, 0.8, False), (1, 3, 0.1, True)], {2: 0, 3: 0}),
        ([(0, 1, 0.9, True), (1, 2, 0.8, False), (2, 3, 0.7, False), (1, 3, 0.3, False)], {1: 0, 2: 0, 3: 0}),
        ([(1, 2, 0.9, True), (2, 3, 0.5, False), (0, 3, float("-inf"), True)], {2: 1, 3: 1}),
        ([(2, 3, 0.5, False)], {2: None, 3: None}),
    ],
)
def test_entity_partition(spark, edges, want):
    df = spark.createDataFrame([(1, *e) for e in edges], "doc long, src long, dst long, affinity double, to_entity boolean")
    assert {r["mention"]: r["entity"] for r in entity_partition(df).collect()} == want


def test_forest_keeps_connectivity_at_every_threshold(spark):
    draw = random.Random(1)
    edges = [(d, a, b, round(draw.random(), 1)) for d in range(6) for a in range(8) for b in range(a + 1, 8) if draw.random() < 0.4]
    df = spark.createDataFrame(edges, "doc long, src long, dst long, affinity double")
    nodes = spark.createDataFrame([(d, n) for d in range(6) for n in range(8)], "doc long, node long")
    for t in (0.2, 0.5, 0.8):
        one, two = (sorted(map(tuple, components_by_doc(nodes, e, t).collect())) for e in (df, spanning_forest(df)))
        assert one == two


def test_last_row_of_a_key_wins(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents/a.json").write_text("\n".join(json.dumps({"document_id": i, "text": t}) for i, t in [("x", "1"), ("y", "2"), ("x", "3")]))
    assert dict(map(tuple, read_documents(spark, str(tmp_path), ["a"]).collect())) == {"x": "3", "y": "2"}
    (tmp_path / "tfidf_candidates").mkdir()
    (tmp_path / "tfidf_candidates/val.json").write_text(json.dumps({"mention_id": "m", "tfidf_candidates": ["x", "y"]}))
    assert read_candidates(spark, str(tmp_path), "val").first()["tfidf_candidates"] == ["x", "y"]
    made = load_or_create(spark, str(tmp_path / "store"), lambda: spark.range(3))
    assert made.count() == load_or_create(spark, str(tmp_path / "store"), lambda: spark.range(9)).count() == 3

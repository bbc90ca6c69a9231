"""Graph operators on documents' affinity graphs: spanning forest, cut, and the partition with one entity a part.

A document's graph is bounded, so each is one group: (doc, src, dst, affinity) with src < dst. Nodes come as rows with a null dst.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)  # the smallest node names the part
        return a != b


def kind_of(df: DataFrame, column: str = "doc") -> str:
    """The type of a column, which a grouped result keeps: documents go by number or by name."""
    return dict(df.dtypes)[column]


def by_affinity(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf[pdf["dst"].notna()].sort_values(["affinity", "src", "dst"], ascending=[False, True, True])


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(doc, src, dst, affinity): the maximum spanning forest of each document; ties by src, dst."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = Union()
        rows = by_affinity(pdf)
        return rows[[parts.join(int(a), int(b)) for a, b in zip(rows["src"], rows["dst"], strict=True)]]

    return edges.select("doc", "src", "dst", "affinity").groupBy("doc").applyInPandas(one, f"doc {kind_of(edges)}, src long, dst long, affinity double")


def components_by_doc(nodes: DataFrame, edges: DataFrame, above: float) -> DataFrame:
    """(doc, node, component): parts of each document's graph once edges of at most ``above`` are gone; named by their smallest node."""
    rows = nodes.select("doc", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst"))
    return parts_by_doc(rows.unionByName(edges.filter(F.col("affinity") > above).select("doc", "src", "dst")))


def parts_by_doc(edges: DataFrame) -> DataFrame:
    """(doc, node, component): parts of each document's graph, of all nodes that ``edges`` (doc, src, dst) name."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = Union()
        for n in pdf["src"]:
            parts.root(int(n))
        for a, b in pdf.loc[pdf["dst"].notna(), ["src", "dst"]].itertuples(index=False):
            parts.join(int(a), int(b))
        found = sorted(parts.parent)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "node": found, "component": [parts.root(n) for n in found]})

    return edges.groupBy("doc").applyInPandas(one, f"doc {kind_of(edges)}, node long, component long")


def entity_partition(edges: DataFrame) -> DataFrame:
    """(doc, mention, entity): edges by falling affinity, none that would put two entities into one part.

    ``edges`` have an entity at src if ``to_entity``. Entities of different documents are kept apart, which does not change any part.
    A mention whose part has no entity gets null.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, entity, mentions = Union(), {}, set()
        name = lambda n, is_entity: 2 * int(n) + int(not is_entity)
        for r in by_affinity(pdf).itertuples(index=False):
            a, b = name(r.src, r.to_entity), name(r.dst, False)
            mentions |= {b} | (set() if r.to_entity else {a})
            if r.to_entity:
                entity.setdefault(parts.root(a), int(r.src))
            x, y = parts.root(a), parts.root(b)
            if x != y and not (x in entity and y in entity):
                one_of = entity.get(x, entity.get(y))
                parts.join(x, y)
                if one_of is not None:
                    entity[parts.root(x)] = one_of
        m = sorted(mentions)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "mention": [n // 2 for n in m], "entity": pd.array([entity.get(parts.root(n)) for n in m], "Int64")})

    return edges.select("doc", "src", "dst", "affinity", "to_entity").groupBy("doc").applyInPandas(one, f"doc {kind_of(edges)}, mention long, entity long")


def divisive_partition(edges: DataFrame) -> DataFrame:
    """(doc, mention, entity): the maximum spanning forest, cut until no part has two entities; null for a part without one.

    In a part with more than one entity, an edge may go if an end is no mention of degree 1; of those that may, all with the smallest affinity go
    at once. Parts do not touch each other's edges, so each is cut by itself. ``edges`` are those of ``entity_partition``; for a graph
    across documents, ``doc`` names a connected component, which has to fit into a task.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, tree, mentions = Union(), [], set()
        for r in by_affinity(pdf).itertuples(index=False):
            a, b = 2 * int(r.src) + int(not r.to_entity), 2 * int(r.dst) + 1
            mentions |= {x for x in (a, b) if x % 2}
            if parts.root(a) != parts.root(b):
                parts.join(a, b)
                tree.append((r.affinity, a, b))
        entity, todo = {}, [(set(parts.parent), tree)]
        while todo:
            nodes, kept = todo.pop()
            parts, degree = Union(), Counter(x for _, a, b in kept for x in (a, b))
            for _, a, b in kept:
                parts.join(a, b)
            own: dict[int, tuple[set[int], list]] = {}
            for n in nodes:
                own.setdefault(parts.root(n), (set(), []))[0].add(n)
            for e in kept:
                own[parts.root(e[1])][1].append(e)
            for members, inner in own.values():
                found = [n // 2 for n in members if n % 2 == 0]
                if len(found) < 2:
                    entity |= {n: found[0] for n in members if found}
                    continue
                free = lambda n: n % 2 == 0 or degree[n] > 1
                least = min(w for w, a, b in inner if free(a) or free(b))  # noqa: B023
                todo.append((members, [(w, a, b) for w, a, b in inner if w != least or not (free(a) or free(b))]))  # noqa: B023
        m = sorted(mentions)
        return pd.DataFrame({"doc": pdf["doc"].iloc[0], "mention": [n // 2 for n in m], "entity": pd.array([entity.get(n) for n in m], "Int64")})

    return edges.select("doc", "src", "dst", "affinity", "to_entity").groupBy("doc").applyInPandas(one, f"doc {kind_of(edges)}, mention long, entity long")

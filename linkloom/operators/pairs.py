"""Training examples from scored clusters: pairs of each anchor, then triplets, softmax rows or scaled pairs.

``members`` are (cluster, member), the entity among them; ``scores`` (a, b, affinity) of the pairs within clusters, smaller first, and of (anchor, negative); an index under
``entities`` is an entity's. Lists are arrays: positives by index, negatives mentions first, each by falling affinity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators.graph import spanning_forest
from linkloom.operators.negatives import top

EDGES = ("all", "m-e", "m-m")


def within(members: DataFrame) -> DataFrame:
    return members.alias("x").join(members.alias("y"), F.expr("x.cluster = y.cluster and x.member < y.member")).select(F.col("x.cluster").alias("cluster"), F.col("x.member").alias("a"), F.col("y.member").alias("b"))


def hardest(negatives: DataFrame, entities: int, quota: int) -> DataFrame:
    """(anchor, other, affinity, mention, r): of each anchor the upper half of the quota in mentions, the lower half in entities, by falling affinity."""
    rows = negatives.select(F.col("a").alias("anchor"), F.col("b").alias("other"), "affinity", (F.col("b") >= entities).alias("mention"))
    share = F.when(F.col("mention"), F.lit(-(-quota // 2))).otherwise(F.lit(quota // 2))
    return top(rows, ["anchor", "mention"], [F.desc("affinity"), F.asc("other")], share)


def listed(members: DataFrame, positives: DataFrame, negatives: DataFrame, candidates: DataFrame, entities: int, edges: str) -> DataFrame:
    """(cluster, anchor, pos, neg) of every mention of the clusters. A positive entity has to be among the anchor's ``candidates`` (midx, eidx) if they are given."""
    if edges not in EDGES:
        raise ValueError(edges)
    kind = lambda c: {"all": F.lit(True), "m-e": F.col(c) < entities, "m-m": F.col(c) >= entities}[edges]
    both = positives.select(F.col("a").alias("anchor"), F.col("b").alias("other")).unionByName(positives.select(F.col("b").alias("anchor"), F.col("a").alias("other"))).distinct()
    if candidates is not None:
        known = candidates.select(F.col("midx").alias("anchor"), F.col("eidx").alias("other"), F.lit(True).alias("known")).distinct()
        both = both.join(known, ["anchor", "other"], "left").filter((F.col("other") >= entities) | F.col("known"))
    pos = both.filter(kind("other")).groupBy("anchor").agg(F.sort_array(F.collect_list("other")).alias("pos"))
    place = F.struct((~F.col("mention")).alias("m"), F.col("r"), F.col("other"))
    neg = negatives.filter(kind("other")).groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(place)), lambda x: x["other"]).alias("neg"))
    none = F.array().cast("array<long>")
    anchors = members.filter(F.col("member") >= entities).select("cluster", F.col("member").alias("anchor"))
    return anchors.join(pos, "anchor", "left").join(neg, "anchor", "left").select("cluster", "anchor", F.coalesce("pos", none).alias("pos"), F.coalesce("neg", none).alias("neg"))


def all_pairs(members: DataFrame, scores: DataFrame, candidates: DataFrame | None, entities: int, quota: int = 32, edges: str = "all") -> DataFrame:
    """Positives are the scored pairs within a cluster; all other scored pairs are negatives of their first end."""
    inside = within(members).select("a", "b").distinct()
    return listed(members, scores.join(inside, ["a", "b"], "left_semi"), hardest(scores.join(inside, ["a", "b"], "left_anti"), entities, quota), candidates, entities, edges)


def tree_pairs(members: DataFrame, scores: DataFrame, candidates: DataFrame | None, entities: int, quota: int = 32, edges: str = "all") -> DataFrame:
    """Positives are the edges of each cluster's maximum spanning tree."""
    inside = within(members)
    tree = spanning_forest(scores.join(inside, ["a", "b"]).select(F.col("cluster").alias("doc"), F.col("a").alias("src"), F.col("b").alias("dst"), "affinity"))
    return listed(members, tree.select(F.col("src").alias("a"), F.col("dst").alias("b")), hardest(scores.join(inside.select("a", "b").distinct(), ["a", "b"], "left_anti"), entities, quota), None, entities, edges)


PAIRS = {"all_pairs": all_pairs, "mst": tree_pairs}


def make_pairs(method: str, *args, **options) -> DataFrame:
    """Pairs by the name of their method."""
    if method not in PAIRS:
        raise ValueError(f"{method}: one of {sorted(PAIRS)}")
    return PAIRS[method](*args, **options)


def cyclic(values: Column, at: Column) -> Column:
    return F.get(values, (at % F.size(values)).cast("int"))


def both_sides(lists: DataFrame) -> DataFrame:
    return lists.filter((F.size("pos") > 0) & (F.size("neg") > 0))


def triplets(lists: DataFrame) -> DataFrame:
    """(cluster, anchor, at, pos, neg): as many as the longer list has; the shorter one starts again when it ends. Anchors without either side give none."""
    at = both_sides(lists).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.size("pos"), F.size("neg")).cast("long") - 1)))
    return at.select("cluster", "anchor", "at", cyclic(F.col("pos"), F.col("at")).alias("pos"), cyclic(F.col("neg"), F.col("at")).alias("neg"))


def softmax_rows(lists: DataFrame, negatives: int) -> DataFrame:
    """(cluster, anchor, at, pos, negs): one positive and ``negatives`` negatives a row, as many rows as either list needs."""
    if negatives < 1:
        raise ValueError("a row needs a negative")
    rows = F.greatest(F.size("pos"), F.ceil(F.size("neg") / negatives).cast("int"))
    at = both_sides(lists).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), rows.cast("long") - 1)))
    negs = F.array(*[cyclic(F.col("neg"), F.col("at") * negatives + j) for j in range(negatives)])
    return at.select("cluster", "anchor", "at", cyclic(F.col("pos"), F.col("at")).alias("pos"), negs.alias("negs"))


def scaled_pairs(lists: DataFrame) -> DataFrame:
    """(cluster, anchor, other, coefficient, copies): positives doubled until they are more than half the negatives, weighted up to 0.8 of them, 1 at least; negatives have -1."""
    p, q = F.size("pos").cast("double"), F.size("neg").cast("double")
    # The smallest power of two x with p * x > q / 2.
    copies = F.when(p > q / 2, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(q / (2 * p), F.lit(1.0))) + 1e-12) + 1).cast("long"))
    rows = lists.select("cluster", "anchor", "pos", "neg", F.when(F.size("pos") > 0, copies).alias("n"), p.alias("p"), q.alias("q"))
    scale = F.greatest(F.round(4 * F.col("q") / (5 * F.col("p") * F.col("n")), 6), F.lit(1.0))
    good = rows.select("cluster", "anchor", F.explode("pos").alias("other"), scale.alias("coefficient"), F.col("n").alias("copies"))
    return good.unionByName(rows.select("cluster", "anchor", F.explode("neg").alias("other"), F.lit(-1.0).alias("coefficient"), F.lit(1).cast("long").alias("copies")))


EXAMPLES = {"triplet": triplets, "softmax": softmax_rows, "threshold": scaled_pairs}


def make_examples(kind: str, lists: DataFrame, **options) -> DataFrame:
    """Examples by the name of their kind."""
    if kind not in EXAMPLES:
        raise ValueError(f"{kind}: one of {sorted(EXAMPLES)}")
    return EXAMPLES[kind](lists, **options)

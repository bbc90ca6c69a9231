"""A training step up to its loss: batches of clusters, negatives, scores, pairs, examples and losses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.lineage import cut
from linkloom.operators.negatives import choose_negatives
from linkloom.operators.numbering import dense_index
from linkloom.operators.pairs import make_examples, make_pairs
from linkloom.operators.scoring import Scorer, batch_edges, edge_affinities


@dataclass
class Step:
    members: DataFrame
    negatives: DataFrame
    scores: DataFrame
    pairs: DataFrame
    examples: DataFrame


def batches(clusters: DataFrame, size: int) -> DataFrame:
    """(cluster, batch): clusters in order, ``size`` a batch."""
    return dense_index(clusters.select("cluster").distinct(), ["cluster"], "place").select("cluster", F.floor(F.col("place") / size).cast("long").alias("batch"))


def collated(members: DataFrame, of: DataFrame, candidates: DataFrame) -> DataFrame:
    """(batch, cluster, midx, eidx): the members of each batch's clusters with their candidates, a row each; null for a mention without any."""
    return members.join(of, "cluster").join(candidates.select(F.col("midx").alias("member"), "eidx"), "member", "left").select("batch", "cluster", F.col("member").alias("midx"), "eidx")


def train_step(mentions: DataFrame, nodes: DataFrame, candidates: DataFrame, scorer: Scorer, entities: int, k: int = 8, quota: int = 8, method: str = "all_pairs", kind: str = "triplet", edges: str = "all", mention_negatives: str = "context_overlap", available: str = "candidates_only", seed: str = "0", **options) -> Step:
    """What one pass over the clusters within documents trains on. ``mentions`` are (midx, doc, gold, start_index, vec), ``nodes`` (idx, is_entity, feature), ``candidates`` (midx, place, eidx)."""
    own = nodes.filter("is_entity").select(F.col("idx").alias("eidx"), F.col("feature").alias("vec"))
    negatives = cut(choose_negatives(mentions, candidates, own, k, mention_negatives, available, edges, seed).withColumn("cluster", F.concat_ws(":", "doc", "eidx")))
    members = negatives.select("cluster", "member").distinct()
    scores = cut(edge_affinities(batch_edges(members, negatives), nodes, scorer))
    pairs = cut(make_pairs(method, members, scores, candidates, entities, quota, edges))
    return Step(members, negatives, scores, pairs, make_examples(kind, pairs, **options))


def triplet_losses(examples: DataFrame, scores: DataFrame, entities: int, margin: float = 0.5) -> DataFrame:
    """(cluster, anchor, at, pos_kind, neg_kind, hinge, bpr) of triplets. Scores serve either direction."""
    both = scores.select("a", "b", "affinity").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "affinity")).distinct()
    of = lambda name, value: both.select(F.col("a").alias("anchor"), F.col("b").alias(name), F.col("affinity").alias(value))
    rows = examples.join(of("pos", "p"), ["anchor", "pos"]).join(of("neg", "n"), ["anchor", "neg"])
    kind = lambda c: F.when(F.col(c) < entities, "e").otherwise("m")
    x = F.col("n") - F.col("p") + margin
    return rows.select("cluster", "anchor", "at", kind("pos").alias("pos_kind"), kind("neg").alias("neg_kind"), F.greatest(x, F.lit(0.0)).alias("hinge"), (1 / (1 + F.exp(-x))).alias("bpr"))


def loss_breakdown(losses: DataFrame, value: str = "hinge") -> DataFrame:
    """(pos_kind, neg_kind, examples, loss) for each kind of pair that occurs, and over all with null kinds."""
    rows = losses.groupingSets([["pos_kind", "neg_kind"], []], "pos_kind", "neg_kind").agg(F.count(F.lit(1)).alias("examples"), F.round(F.avg(value), 6).alias("loss"))
    return rows.select("pos_kind", "neg_kind", "examples", "loss")


def scaled_loss(examples: DataFrame, scores: DataFrame, margin: float = 0.5) -> DataFrame:
    """One row: the mean over copies of abs(c) * relu(margin - sign(c) * s), and of relu(margin - c * s)."""
    both = scores.select("a", "b", "affinity").unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "affinity")).distinct()
    rows = examples.join(both.select(F.col("a").alias("anchor"), F.col("b").alias("other"), "affinity"), ["anchor", "other"])
    c, s = F.col("coefficient"), F.col("affinity")
    weighted = lambda x: F.round(F.sum(F.col("copies") * x) / F.sum("copies"), 6)
    return rows.agg(weighted(F.abs(c) * F.greatest(margin - F.signum(c) * s, F.lit(0.0))).alias("concat_loss"), weighted(F.greatest(margin - c * s, F.lit(0.0))).alias("embed_loss"), F.sum("copies").alias("pairs"))


def mean_metrics(records: DataFrame) -> DataFrame:
    """(metric, value): the mean of each metric over the steps of ``records`` (step, metric, value); a step without a metric counts 0."""
    steps = records.agg(F.count_distinct("step").alias("n"))
    return records.groupBy("metric").agg(F.sum("value").alias("total")).crossJoin(F.broadcast(steps)).select("metric", F.round(F.col("total") / F.col("n"), 6).alias("value"))

"""Affinities of pairs by a scorer that the caller plugs in.

A scorer takes two feature columns and gives a column; ``arrow_scorer`` makes one of a function of two pandas Series, as a model would be. An edge's affinity is the
mean of its scores in both directions, and each pair is scored once however often it is asked for. A scorer may have a ``block``: that mean, to 6 places, of all rows of one matrix
with all of another, so that the pairs of whole documents need not be rows. One that is ``symmetric`` gives the same in both directions, to the last bit, and is asked once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions.vectors import dot
from linkloom.operators.dense import products

Scorer = Callable[[Column, Column], Column]


def arrow_scorer(fn: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return fn(a, b)

    return scored


def inner_product(a: Column, b: Column) -> Column:
    return dot(a, b)


inner_product.block = products
inner_product.symmetric = True


def both_directions(scorer: Scorer, a: Column, b: Column) -> Column:
    """The mean of a pair's scores in both directions."""
    return scorer(a, b) if getattr(scorer, "symmetric", False) else (scorer(a, b) + scorer(b, a)) / 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def edge_affinities(edges: DataFrame, nodes: DataFrame, mention_mention: Scorer, mention_entity: Scorer | None = None, places: int = 6) -> DataFrame:
    """``edges`` (a, b, any others) with a column affinity. ``nodes`` are (idx, is_entity, feature).

    A pair with an entity goes to ``mention_entity`` if there is one, any other to ``mention_mention``. Edges with an end that ``nodes`` lack are left out.
    """
    pairs = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    of = lambda side, name: nodes.select(F.col("idx").alias(name), F.struct("is_entity", "feature").alias(side))
    both = pairs.join(of("x", "u"), "u").join(of("y", "v"), "v")
    mean = lambda f: both_directions(f, F.col("x.feature"), F.col("y.feature"))
    score = mean(mention_mention)
    if mention_entity is not None:
        score = F.when(F.col("x.is_entity") | F.col("y.is_entity"), mean(mention_entity)).otherwise(score)
    scored = both.select("u", "v", F.round(score, places).alias("affinity"))
    return edges.withColumn("u", F.least("a", "b")).withColumn("v", F.greatest("a", "b")).join(scored, ["u", "v"]).drop("u", "v")


def batch_edges(members: DataFrame, negatives: DataFrame) -> DataFrame:
    """The pairs (a, b) that a batch scores: those within a cluster of ``members`` (cluster, member), smaller member first, and (member, neg) of ``negatives`` without the padding."""
    pair = members.alias("x").join(members.alias("y"), F.expr("x.cluster = y.cluster and x.member < y.member"))
    inside = pair.select(F.col("x.member").alias("a"), F.col("y.member").alias("b"))
    return inside.unionByName(negatives.filter("neg is not null").select(F.col("member").alias("a"), F.col("neg").alias("b"))).distinct()


def encoded(examples: DataFrame, encode: Callable[[pd.Series], pd.Series], key: str = "idx", feature: str = "feature") -> DataFrame:
    """(key, vec): ``encode`` of each example's feature in Arrow batches, each key once. Rows that share a key have to share their feature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vec": encode(batch[feature])})

    return examples.select(key, feature).dropDuplicates([key]).mapInPandas(run, f"{key} long, vec array<double>")


def one_way_scores(edges: DataFrame, nodes: DataFrame, scorer: Scorer, places: int = 6) -> DataFrame:
    """(a, b, score): each directed pair once, in its own direction."""
    of = lambda side, name: nodes.select(F.col("idx").alias(name), F.col("feature").alias(side))
    return edges.select("a", "b").distinct().join(of("x", "a"), "a").join(of("y", "b"), "b").select("a", "b", F.round(scorer(F.col("x"), F.col("y")), places).alias("score"))


def symmetrized(scores: DataFrame, places: int = 7) -> DataFrame:
    """(src, dst, score): half the sum of both directions; one that is missing counts 0. Half a sum of 6 places has 7."""
    return scores.filter("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.round(F.sum("score") / 2, places).alias("score"))

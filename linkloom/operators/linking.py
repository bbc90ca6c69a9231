"""Links of mentions to entities: the best one of each, what they reach, and examples to train them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.negatives import hash01


def best_links(mentions: DataFrame, edges: DataFrame, default: int | None = None) -> DataFrame:
    """(midx, eidx, affinity, missing): the best of ``edges`` (midx, eidx, affinity) of each of ``mentions`` (midx), ties to the smallest entity.

    A mention without an edge is missing: it has null and null, or ``default`` and minus infinity.
    """
    top = edges.groupBy("midx").agg(F.max(F.struct("affinity", (-F.col("eidx")).alias("e"))).alias("top"))
    out = mentions.select("midx").join(top, "midx", "left").select("midx", (-F.col("top.e")).alias("eidx"), F.col("top.affinity").alias("affinity"), F.col("top").isNull().alias("missing"))
    if default is None:
        return out
    return out.withColumn("eidx", F.coalesce("eidx", F.lit(default).cast("long"))).withColumn("affinity", F.coalesce("affinity", F.lit(float("-inf"))))


def link_metrics(gold: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """One row: recall (share of ``gold`` (midx, gold) whose entity has an edge), accuracy (share whose link it is), no_candidates, mentions."""
    reached = edges.select("midx", F.col("eidx").alias("gold")).distinct().withColumn("reached", F.lit(1.0))
    both = gold.select("midx", "gold").join(reached, ["midx", "gold"], "left").join(links.select("midx", "eidx", "missing"), "midx", "left")
    return both.agg(
        F.round(F.avg(F.coalesce("reached", F.lit(0.0))), 6).alias("recall"), F.round(F.avg(F.when(F.col("eidx") == F.col("gold"), 1.0).otherwise(0.0)), 6).alias("accuracy"),
        F.count_if(F.coalesce("missing", F.lit(True))).alias("no_candidates"), F.count(F.lit(1)).alias("mentions"),
    )


def sampled_entities(mentions: DataFrame, entities: int, k: int, seed: str) -> DataFrame:
    """(midx, place, eidx): k entities for each mention, drawn with replacement by a hash."""
    drawn = mentions.select("midx", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("place"))
    return drawn.withColumn("eidx", F.floor(hash01(F.lit(seed), "midx", "place") * entities).cast("long"))


def linking_examples(gold: DataFrame, candidates: DataFrame, entities: int, k: int, each: int, true_labels: bool = False, seed: str = "0") -> DataFrame:
    """(midx, chunk, positive, negatives): ceil(k / each) examples of ``each`` entities for each of ``gold`` (midx, eidx).

    The positive is the gold entity if it is a candidate, or in any case with ``true_labels``; else there is none and one more negative. Negatives are the other candidates (midx, place, eidx) in their order,
    again from the first where they run out; a mention without candidates draws k entities. One that has no negative at all gives no example.
    """
    chunks = -(-k // each)
    have = candidates.select("midx").distinct()
    drawn = sampled_entities(gold.join(have, "midx", "left_anti"), entities, k, seed)
    pool = candidates.select("midx", F.col("place").cast("int").alias("place"), "eidx").unionByName(drawn)
    lists = pool.groupBy("midx").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "eidx"))), lambda x: x["eidx"]).alias("all"))
    listed = candidates.select("midx", F.col("eidx")).distinct().withColumn("listed", F.lit(True))
    rows = gold.select("midx", "eidx").join(lists, "midx").join(listed, ["midx", "eidx"], "left")
    positive = F.col("eidx") if true_labels else F.when(F.coalesce("listed", F.lit(False)), F.col("eidx"))
    rows = rows.select("midx", positive.alias("positive"), "all").withColumn("neg", F.filter("all", lambda x: F.coalesce(x != F.col("positive"), F.lit(True)))).filter(F.size("neg") > 0)
    n = F.lit(each) - F.col("positive").isNotNull().cast("int")
    at = rows.withColumn("n", n).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    some = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("neg", (F.col("chunk") * F.col("n") + j) % F.size("neg")))
    return at.select("midx", "chunk", "positive", F.when(F.col("n") > 0, some).otherwise(F.array().cast("array<long>")).alias("negatives"))

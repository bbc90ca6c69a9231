"""Negatives of cluster members, in slots: mentions first, then entities, and nothing where they run out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions.vectors import dot


def hash01(*parts: Column | str) -> Column:
    """A number from 0 to 1 that only the parts decide, the same in any engine with MD5."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def top(df: DataFrame, by: str | list[str], order: list[Column], k: int | Column, name: str = "r") -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn(name, place).filter(F.col(name) <= k)


def choose_negatives(
    mentions: DataFrame, candidates: DataFrame, entities: DataFrame, k: int, mention_negatives: str = "context_overlap", available: str = "candidates_only", edges: str = "all", seed: str = "0",
) -> DataFrame:
    """(doc, eidx, member, slot, neg): ``k`` slots for each member of the clusters within documents, the entity among them. A slot without a negative has null.

    ``mentions`` are (midx, doc, gold, start_index, vec), ``candidates`` (midx, place, eidx), ``entities`` (eidx, vec). Up to k // 2 slots hold mentions of the document outside the
    cluster: those that begin nearest (context_overlap), any (random, by a hash), or the nearest by vector (knn). The rest hold entities other than the
    cluster's: the mention's first candidates (candidates_only), or the nearest of the document's candidates (knn_candidates) or of all (open_domain). Edges m-e
    leave out the mentions, m-m the entities. An entity has mention slots under knn only, and no entity slots. Ties go to the smallest.
    """
    m = mentions.select("midx", "doc", "gold", "start_index", "vec")
    half = 0 if edges == "m-e" else k // 2
    sizes = m.groupBy("doc").agg(F.count(F.lit(1)).alias("all")).join(m.groupBy("doc", "gold").agg(F.count(F.lit(1)).alias("own")), "doc")
    sizes = sizes.select("doc", F.col("gold").alias("eidx"), F.least(F.lit(half).cast("long"), F.col("all") - F.col("own")).alias("n"))
    members = m.select("doc", F.col("gold").alias("eidx"), F.col("midx").alias("member"), "start_index", "vec")
    anchors = members
    if mention_negatives == "knn":
        own = entities.select(F.col("eidx"), F.col("vec"))
        anchors = members.unionByName(sizes.select("doc", "eidx").join(own, "eidx").select("doc", "eidx", F.col("eidx").alias("member"), F.lit(None).cast("int").alias("start_index"), "vec"))
    pairs = anchors.alias("a").join(m.alias("b"), F.expr("a.doc = b.doc and a.eidx <> b.gold")).select("a.doc", "a.eidx", "a.member", F.col("b.midx").alias("neg"), F.col("a.start_index").alias("s"), F.col("b.start_index").alias("t"), F.col("a.vec").alias("x"), F.col("b.vec").alias("y"))
    order = {"context_overlap": F.abs(F.col("s") - F.col("t")), "random": F.md5(F.concat_ws(":", F.lit(seed), "member", "neg")), "knn": -F.round(dot(F.col("x"), F.col("y")), 6)}[mention_negatives]
    near = top(pairs, ["doc", "member"], [order, F.col("neg")], half).select("doc", "eidx", "member", (F.col("r") - 1).cast("long").alias("slot"), "neg")
    if available == "candidates_only":
        pool = members.join(candidates.select(F.col("midx").alias("member"), F.col("eidx").alias("neg"), F.col("place").alias("d")), "member")
    else:
        named = entities.select(F.col("eidx").alias("neg"), F.col("vec").alias("y"))
        if available == "knn_candidates":
            of = m.select("midx", "doc").join(candidates, "midx").select("doc", F.col("eidx").alias("neg")).distinct()
            pool = members.join(of, "doc").join(named, "neg")
        else:
            pool = members.crossJoin(named)
        pool = pool.withColumn("d", -F.round(dot(F.col("vec"), F.col("y")), 6))
    rest = F.lit(0) if edges == "m-m" else F.lit(k) - F.col("n")
    far = top(pool.filter("neg <> eidx").join(sizes, ["doc", "eidx"]), ["doc", "member"], [F.col("d"), F.col("neg")], rest).select("doc", "eidx", "member", (F.col("n") + F.col("r") - 1).alias("slot"), "neg")
    rows = members.select("doc", "eidx", "member").unionByName(sizes.select("doc", "eidx", F.col("eidx").alias("member")))
    slots = rows.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    return slots.join(near.unionByName(far), ["doc", "eidx", "member", "slot"], "left")

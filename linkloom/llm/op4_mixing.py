"""Mixing sources to target weights by the cube method.

A source's target is its weight's share of all words, at most ``most`` times what it has. Every document of the source
is then due rate = target / words of the source: its whole part is taken outright, its fraction is an inclusion probability
that the cube method moves to 0 or 1 while it keeps two sums: the number of documents and the number of words.

The flight runs in blocks of a source's documents, at once and apart. Three undecided documents and two sums leave one direction to
move in; a step ends when one of them reaches 0 or 1, so at most two of a block stay undecided. Those of many blocks fly on
together, until one block of the source is left. There a few documents wait on the ground; they and the last two of the flight
are the landing problem, for which all outcomes are compared: the one whose words, then documents, come nearest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm._docs import table
from linkloom.llm._spark import checkpointed, from_rows, small

WEIGHTS = (5, 2, 1)
MOST = 3.0
BLOCK = 4096
SEED = 20
NEAR = 1e-9
#: Documents of a source that wait for the landing; with the flight's last two it has 2 ** (AHEAD + 2) outcomes.
AHEAD = 12
#: A word: a run without spaces and tabs, line feeds and their kin.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> list[float]:
    """Words to take of each source: shares by weight, at most ``most`` times its size, the excess shared out again by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, rest, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        share = rest / sum(w[i] for i in free)
        over = {i for i in free if w[i] * share > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = w[i] * share
            break
        for i in over:
            out[i] = most * sizes[i]
        free -= over
        rest = sum(sizes) - sum(out[i] for i in range(len(sizes)) if i not in free)
    return out


def fly(prob: list[float], size: list[int], draw: np.random.Generator) -> list[float]:
    """Inclusion probabilities after the flight: 0 or 1 but for two at most."""
    prob = [p if NEAR < p < 1 - NEAR else float(round(p)) for p in prob]
    wait = (k for k, p in enumerate(prob) if 0 < p < 1)
    held: list[int] = []

    def move(u: list[float]) -> None:
        ups = min((1 - prob[k]) / x if x > 0 else prob[k] / -x for k, x in zip(held, u, strict=True) if x)
        downs = min(prob[k] / x if x > 0 else (1 - prob[k]) / -x for k, x in zip(held, u, strict=True) if x)
        step = ups if draw.random() * (ups + downs) < downs else -downs
        for k, x in zip(held, u, strict=True):
            prob[k] += step * x
            if prob[k] < NEAR or prob[k] > 1 - NEAR:
                prob[k] = float(round(prob[k]))
        held[:] = [k for k in held if 0 < prob[k] < 1]

    while True:
        while len(held) < 3 and (k := next(wait, None)) is not None:
            held.append(k)
        if len(held) < 3:
            break
        a, b, c = (size[k] for k in held)
        scale = max(abs(c - b), abs(a - c), abs(b - a))
        move([(c - b) / scale, (a - c) / scale, (b - a) / scale] if scale else [1.0, -1.0, 0.0])
    if len(held) == 2 and size[held[0]] == size[held[1]]:
        move([1.0, -1.0])
    return prob


def land(prob: list[float], size: list[int], draw: np.random.Generator) -> list[float]:
    """All probabilities 0 or 1, with the sums of words and documents as near as the landing allows."""
    open_ = [k for k, p in enumerate(prob) if NEAR < p < 1 - NEAR]
    large = sorted(open_, key=lambda k: -size[k])[: AHEAD * 2 // 3]  # what is too large to be made up for in flight
    ground = large + [k for k in open_ if k not in large][: AHEAD - len(large)]
    parked = {k: prob[k] for k in ground}
    prob = fly([1.0 if k in parked else p for k, p in enumerate(prob)], size, draw)
    for k, p in parked.items():
        prob[k] = p
    last = [k for k in open_ if 0 < prob[k] < 1]
    if last:
        p, s = np.array([prob[k] for k in last]), np.array([size[k] for k in last], float)
        off = ((np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1) - p
        best = int(np.argmin(np.abs(off @ s) / s.mean() + np.abs(off.sum(1)) / 100))
        for i, k in enumerate(last):
            prob[k] = float(best >> i & 1)
    return prob


LEVEL = "doc_id long, size long, source int, block long, prob double"


def flown(df: DataFrame, level: int, last: dict[int, int]) -> DataFrame:
    """One level of the flight; a source lands at its own last level, whatever the others still have to do."""
    names = ["doc_id", "size", "source", "block", "prob"]

    def one(block: pa.Table) -> pa.Table:
        ids = block.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
        size = block.column("size").to_numpy()
        with np.errstate(over="ignore"):
            mixed = (ids.astype(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        prob = block.column("prob").to_numpy()
        order = np.lexsort((prob, size, ids, mixed ^ (mixed >> np.uint64(29))))
        block = block.select(names).take(pa.array(order))
        draw = np.random.Generator(np.random.Philox([SEED + level, (block.column("source")[0].as_py() << 32) + block.column("block")[0].as_py()]))
        done = (land if level == last[block.column("source")[0].as_py()] else fly)(prob[order].tolist(), size[order].tolist(), draw)
        return block.set_column(4, "prob", pa.array(done, pa.float64()))

    return df.groupBy("source", "block").applyInArrow(one, LEVEL)


def levels(count: int) -> Iterator[int]:
    """Blocks of a source at each level, down to one."""
    blocks = max(1, -(-count // BLOCK))
    while blocks > 1:
        yield blocks
        blocks = max(1, -(-2 * blocks // BLOCK))
    yield 1


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source), times (how often it is taken), taken (words).

    Sources by code point, null last, have the weights in turn. A null text has size 0; documents of size 0 are taken as often as
    the whole part of their rate says, which adds no words. Repeated rows are documents of their own. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("own"),
    )
    # Rows without an id, and equal ones, are dealt by text and by number, so that they do not meet in one block.
    counted = rows.groupBy("doc_id", "name", "size", "own").agg(F.count(F.lit(1)).alias("rows"))
    slim = checkpointed(counted.select("doc_id", "name", "size", "own", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("row")))
    # One row a source comes to the driver, never more.
    found = slim.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.when(F.col("size") > 0, 1)).alias("docs")).collect()
    found.sort(key=lambda r: (r["name"] is None, r["name"] or ""))
    aims = targets([r["size"] for r in found], weights, most)
    # The largest documents of a source with several levels wait for its landing too: those larger than its eighth largest, at most 7 rows a source.
    many = [r["name"] for r in found if r["docs"] > BLOCK]
    cuts = {}
    if many:
        of = F.col("name").isin([m for m in many if m is not None]) | (F.col("name").isNull() & F.lit(None in many))
        place = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("size")))
        top = slim.filter(F.coalesce(of, F.lit(False))).select("name", "size", place.alias("place")).filter(F.col("place") <= AHEAD * 2 // 3)
        cuts = {r["name"]: r["cut"] for r in top.groupBy("name").agg(F.min("size").alias("cut")).collect()}
    plan, last = [], {}
    for i, (r, aim) in enumerate(zip(found, aims, strict=True)):
        rate = aim / r["size"] if r["size"] else 0.0
        whole = int(rate + NEAR)
        last[i] = len(list(levels(r["docs"]))) - 1
        plan.append((r["name"], i, r["size"], aim, whole, max(0.0, rate - whole), max(1, -(-r["docs"] // BLOCK)), last[i], cuts.get(r["name"])))
    plan = small(from_rows(spark, plan, "name string, source int, source_size long, target double, whole int, part double, blocks long, last int, cut long").alias("p"), len(plan))
    other = F.when(F.col("d.doc_id").isNull(), F.col("d.own")), F.when(F.col("d.row") > 1, F.col("d.row"))
    due = slim.alias("d").join(plan, F.expr("d.name <=> p.name")).select(
        "d.doc_id", "d.size", "p.source", "p.last", F.when(F.col("d.size") > 0, F.col("part")).otherwise(0.0).alias("prob"),
        F.pmod(F.xxhash64("d.doc_id", F.lit(SEED), *other), F.col("blocks")).alias("block"), F.coalesce(F.col("d.size") > F.col("p.cut"), F.lit(False)).alias("parked"),
    )
    shares = plan.select("source", "source_size", "target", "whole")
    names = ["doc_id", "size", "source", "block", "prob"]
    parked = due.filter("parked").withColumn("block", F.lit(0).cast("long"))
    open_, settled = due.filter("not parked").select(names), []
    end = max(last.values(), default=0)
    for level in range(end + 1):
        if level and many:
            open_ = open_.unionByName(parked.filter(F.col("last") == level).select(names))
        out = checkpointed(flown(open_, level, last))
        undecided = (F.col("prob") > 0) & (F.col("prob") < 1)
        settled.append(out if level == end else out.filter(~undecided))
        open_ = out.filter(undecided).withColumn("block", (F.col("block") / F.lit(BLOCK // 2)).cast("long"))  # 0 where one block of the source is left
    done = settled[0]
    for df in settled[1:]:
        done = done.unionByName(df)
    times = (F.col("whole") + F.col("prob").cast("int")).cast("int")
    return done.join(shares, "source").select("doc_id", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")

"""Longest-processing-time sharding of groups of equal texts.

Groups go, by size downwards, to the least loaded shard. Groups of one size are interchangeable, so the heap needs only how many groups have each size;
k different sizes add up to at least k * k / 2 bytes, so there are fewer than the root of twice the corpus's bytes. They stream through the driver, largest first,
and what the heap decides goes on to the shared folder in parts, so that the driver holds neither. It hands out a size's groups one at a time, or, where many have
one size, by levels with the same outcome. Executors number the groups of each size by their hash and look their shard up.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm._docs import table
from linkloom.llm._spark import checkpointed, from_rows, shared_folder, small

SHARDS = 8
#: Up to so many groups of one size pass through the heap one by one.
ONE_BY_ONE = 64
#: Rows of the plan that the driver holds before it writes them.
HELD = 100_000
PLAN = "total long, shard int, lo long, hi long"


def planned(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, number of groups), by size downwards, to (size, shard, from, to): the groups of a size numbered from..to-1 go to the shard."""
    heap = [(0, s) for s in range(shards)]
    for size, count in histogram:
        given = [0] * shards
        if count <= ONE_BY_ONE:
            for _ in range(count):
                load, s = heap[0]
                given[s] += 1
                heapq.heapreplace(heap, (load + size, s))
        else:
            # The heap takes the count smallest of all load + k * size. Find the level under which fewer than count lie.
            loads = sorted(heap)
            low, high = loads[0][0], loads[-1][0] + size * count
            below = lambda level: sum(max(0, -((load - level) // size)) for load, _ in loads)  # noqa: E731, B023
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if below(level) <= count else (low, level - 1)
            for load, s in loads:
                given[s] = max(0, -((load - low) // size))
            rest = count - sum(given)
            for load, s in sorted((load + given[s] * size, s) for load, s in loads)[:rest]:
                given[s] += 1
            heap = [(load + given[s] * size, s) for load, s in loads]
            heapq.heapify(heap)
        at = 0
        for s, n in enumerate(given):
            if n:
                yield size, s, at, at + n
                at += n


def assign(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    return list(planned(sorted(histogram, reverse=True), shards))


def plan_of(sizes: DataFrame, shards: int) -> DataFrame:
    """The plan for (total, count), marked for broadcast if it is small."""
    spark, folder = sizes.sparkSession, f"{shared_folder(sizes.sparkSession)}/plan-{uuid.uuid4().hex}"
    histogram = sizes.groupBy("total").agg(F.sum("count").alias("n")).orderBy(F.desc("total"))
    held, written = [], 0
    for row in planned(((r["total"], r["n"]) for r in histogram.toLocalIterator()), shards):
        held.append(row)
        if len(held) == HELD:
            from_rows(spark, held, PLAN).coalesce(1).write.mode("append").parquet(folder)
            held, written = [], written + HELD
    if not written:
        return small(from_rows(spark, held, PLAN), len(held))
    from_rows(spark, held, PLAN).coalesce(1).write.mode("append").parquet(folder)
    return small(spark.read.parquet(folder), written + len(held))


def before(part: Column | str, by: str, count: str) -> Column:
    """What stands in the parts before, in the order of their names."""
    return F.sum(count).over(Window.partitionBy(by).orderBy(part)) - F.col(count)


def slot_runs(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for each doc_id and text: same (hash of the text), size, text_crc32, law 'bytes', shard, slot (the first of ``copies`` consecutive ones), grown_shard null."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("same"),
    )
    slim = checkpointed(rows.groupBy("doc_id", "same", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    head = lambda c: F.substring(F.hex(c), 1, 3)  # noqa: E731  4096 parts, whose order is the order of the hashes
    groups = checkpointed(slim.groupBy("same").agg(F.sum(F.col("size") * F.col("copies")).alias("total")).withColumn("part", head("same")))
    sizes = checkpointed(groups.groupBy("total", "part").count())
    plan = plan_of(sizes, shards)
    rank = F.row_number().over(Window.partitionBy("total", "part").orderBy("same")) - 1
    placed = (
        groups.withColumn("rank", rank).join(sizes.select("total", "part", before("part", "total", "count").alias("offset")), ["total", "part"])
        .withColumn("rank", F.col("rank") + F.col("offset")).alias("g")
        .join(plan.alias("p"), F.expr("g.total = p.total and g.rank >= p.lo and g.rank < p.hi"))
        .select("g.same", "p.shard")
    )
    named = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    sharded = checkpointed(slim.join(placed, "same").withColumn("named", named).withColumn("part", head("named")))
    starts = sharded.groupBy("shard", "part").agg(F.sum("copies").alias("count"))
    starts = starts.select("shard", "part", before("part", "shard", "count").alias("offset"))
    within = F.sum("copies").over(Window.partitionBy("shard", "part").orderBy("named", "same")) - F.col("copies")
    return (
        sharded.withColumn("slot", within).join(small(starts, 4096 * shards), ["shard", "part"])
        .select("doc_id", "same", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "copies")
    )


def lpt_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law 'bytes', shard, slot (gapless from 0 in each shard), grown_shard null.

    Size is the text's UTF-8 bytes plus 1. Documents with equal texts stay together; a null text counts as an empty one. Of groups of one size, the one with the smallest
    MD5 goes first. Slots go by the MD5 of the doc_id, then of the text. Null and repeated doc_ids are numbered like any other row. Other columns are not read; an empty table gives no rows.
    """
    runs = slot_runs(docs, shards)
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return runs.withColumn("step", step).select("doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") + F.col("step")).alias("slot"), "grown_shard")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(table(spark, sf_dir, "documents"))


#: The same by a list of loads that takes the groups one by one.
ORACLE = """
WITH RECURSIVE
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS crc),
doc AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS same FROM documents),
grp AS (SELECT same, any_value(hex(encode(text))) AS bytes, count(*) AS copies FROM doc GROUP BY same),
sums AS (
  SELECT same, CAST(len(bytes) // 2 + 1 AS BIGINT) AS size, CAST((len(bytes) // 2 + 1) * copies AS BIGINT) AS total,
    xor(CAST(4294967295 AS BIGINT), list_reduce(list_transform(range(CAST(len(bytes) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(bytes, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
    lambda c, b: xor(c // 256, crc[CAST(xor(c % 256, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM grp, bits),
ordered AS (SELECT total, row_number() OVER (ORDER BY total DESC, same) AS k FROM sums),
packed AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS BIGINT) AS total, CAST(NULL AS BIGINT) AS place
  UNION ALL
  SELECT k, list_transform(loads, lambda x, i: CASE WHEN i = place THEN x + total ELSE x END), total, place
  FROM (SELECT o.k, p.loads, o.total, CAST(list_position(p.loads, list_min(p.loads)) AS BIGINT) AS place FROM packed p JOIN ordered o ON o.k = p.k + 1)),
given AS (SELECT total, place - 1 AS shard, row_number() OVER (PARTITION BY total ORDER BY place, k) AS n FROM packed WHERE k > 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY total ORDER BY same) AS n FROM sums)
SELECT d.doc_id, s.size, s.text_crc32, 'bytes' AS law, CAST(g.shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY g.shard ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.same) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM doc d JOIN numbered s ON s.same = d.same JOIN given g ON g.total = s.total AND g.n = s.n
"""

"""Exact top-k search in binary codes by incremental multi-index hashing.

Codes are dealt into blocks, and a block indexes its codes by each of m segments, about as wide as the block's size has bits. Queries grow their radius from 0:
at radius r they visit, segment by segment, the buckets at distance r from their own. Once that is done for the segments up to the ith (from 0), a code that was not
visited differs more than r bits in each of these and at least r in each other one, so in m * r + i + 1 bits or more. A query stops as soon as
its kth distance, checked on whole codes, is less than that. A code is taken only where it is met first, which its own segments tell.

Queries go in packs to all blocks. A block's index is built once, and the packs stream by. Blocks answer with their own top k, and the best k of those
are the result. Of rows with one code only the first ids can be among any query's k, so no more of them are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm._docs import shuffle_parts, table
from linkloom.llm._spark import bounded_batches, released

K, EVERY = 10, 20
#: Distinct codes of a block, queries of a pack, and buckets or codes that a step looks at together.
BLOCK, PACK, STEP = 1 << 15, 1 << 10, 1 << 19
#: Bits of a segment at most.
BITS = 16


def code(vector: Column, words: int) -> Column:
    """array<long> of ``words``: bit i of word w is set if component 64 * w + i is positive. Missing and null components count as not positive."""
    one = lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    return F.array(*[F.aggregate(F.transform(F.slice(vector, 64 * w + 1, 64), one), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)) for w in range(words)])


@cache
def masks(width: int, radius: int) -> np.ndarray:
    """All keys of ``width`` bits with ``radius`` of them set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def segments(words: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, first bit, width): pieces of equal width, about as many bits as a block of so many codes has."""
    each = -(-64 // min(BITS, max(4, int(codes).bit_length())))
    cuts = [64 * i // each for i in range(each + 1)]
    return [(w, a, b - a) for w in range(words) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class MultiIndex:
    """Rows of (id, code), codes as a row of 64-bit words each."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order]
        first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]).any(1)]) if len(ids) else np.empty(0, np.int64)
        self.ids, self.codes = ids, codes[first]  # distinct codes, and the ids of each in order
        self.begin, self.count = first, np.diff(np.r_[first, len(ids)])
        self.segments = segments(codes.shape[1], len(first))
        self.by, self.at = [], []
        for s in self.segments:
            part = self.part(self.codes, s)
            order = np.argsort(part, kind="stable")
            self.by.append(order)
            self.at.append(np.searchsorted(part[order], np.arange((1 << s[2]) + 1)))

    @staticmethod
    def part(codes: np.ndarray, segment: tuple[int, int, int]) -> np.ndarray:
        word, first, width = segment
        return ((codes[:, word] >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def top(self, own: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(query, distance, id): for each query the k nearest rows whose id is not its own, by distance, then id."""
        best = [np.empty(0, np.int64) for _ in range(3)]
        open_, m = np.arange(len(asked)), len(self.segments)
        for radius in range(max(s[2] for s in self.segments) + 1):
            for i, segment in enumerate(self.segments):
                if radius > segment[2] or not len(open_) or not len(self.codes):
                    continue
                keys = masks(segment[2], radius)
                most = max(1, STEP // len(keys))
                found = [self.visit(open_[lo : lo + most], asked, own, i, radius) for lo in range(0, len(open_), most)]
                best = self.merged(best, [np.concatenate(c) for c in zip(*found, strict=True)], k)
                n = np.bincount(best[0], minlength=len(asked))
                last = np.full(len(asked), -1, np.int64)
                np.maximum.at(last, best[0], best[1])
                open_ = open_[(n[open_] < k) | (last[open_] > m * radius + i)]
        return tuple(best)

    def visit(self, queries: np.ndarray, asked: np.ndarray, own: np.ndarray, i: int, radius: int) -> list[np.ndarray]:
        """What the queries meet first in segment i at this radius."""
        segment = self.segments[i]
        keys = self.part(asked[queries], segment)[:, None] ^ masks(segment[2], radius)
        lo, n = self.at[i][keys], self.at[i][keys + 1] - self.at[i][keys]
        hit = np.flatnonzero(n)
        lo, n, who = lo.ravel()[hit], n.ravel()[hit], queries[hit // keys.shape[1]]
        out = []
        cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(np.cumsum(n) // STEP) > 0]) if len(n) else np.empty(0, np.int64), len(n)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = n[a:b]
            p = self.by[i][np.repeat(lo[a:b] - np.cumsum(some) + some, some) + np.arange(some.sum())]
            q = np.repeat(who[a:b], some)
            differ = self.codes[p] ^ asked[q]
            fresh = np.ones(len(p), bool)
            for j, other in enumerate(self.segments):
                if j != i:
                    fresh &= np.bitwise_count(self.part(differ, other)) + (j > i) > radius
            p, q, d = p[fresh], q[fresh], np.bitwise_count(differ[fresh]).sum(1).astype(np.int64)
            some = self.count[p]
            rows = np.repeat(self.begin[p] - np.cumsum(some) + some, some) + np.arange(some.sum())
            q, d, x = np.repeat(q, some), np.repeat(d, some), self.ids[rows]
            other = x != own[q]
            out.append((q[other], d[other], x[other]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3

    @staticmethod
    def merged(best: list[np.ndarray], found: list[np.ndarray], k: int) -> list[np.ndarray]:
        q, d, x = (np.concatenate(c) for c in zip(best, found, strict=True))
        order = np.lexsort((x, d, q))
        q, d, x = q[order], d[order], x[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        return [c[place < k] for c in (q, d, x)]


def hamming_top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """For each row whose vec_id is divisible by ``every``: query_id, rank (1 to k), vec_id, distance; the k rows nearest by Hamming distance of the sign bits, ties by vec_id.

    A row is not its own neighbour, nor are rows that share its vec_id. Codes have as many bits as the longest embedding has components; missing or null ones are not positive, and an
    empty embedding has the code 0. Rows with a null vec_id or embedding are left out. With fewer than k others there are fewer ranks. Rows that repeat a vec_id are neighbours of
    their own; as queries, those of one code are one. Other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    known = rows.select(F.col("vec_id").cast("long").alias("id"), "embedding").filter("id is not null and embedding is not null")
    longest = known.agg(F.max(F.size("embedding"))).first()[0] or 0
    words = max(1, -(-longest // 64))
    codes = known.select("id", code(F.col("embedding"), words).alias("code")).groupBy("id", "code").agg(F.count(F.lit(1)).alias("copies"))
    # Leaving out one id, k rows are left of the first k + 1 ids of a code; of the rows of one id, k are enough.
    first = codes.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("place") <= k + 1)
    first = first.select("id", "code", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
    n = first.agg(F.approx_count_distinct("code")).first()[0]
    parts = shuffle_parts(spark)
    blocks = max(1, min(2 * parts, -(-n // 1024)), -(-n // BLOCK))
    by_code = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")
    data = first.select(by_code.alias("block"), F.lit(None).cast("long").alias("pack"), "id", "code")
    queries = codes.filter(F.col("id") % every == 0)
    packs = max(1, -(-queries.count() // PACK))
    packed = queries.groupBy(F.pmod(F.xxhash64("id", "code"), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct("id", "code")).alias("rows"))  # about PACK in each
    held = data.groupBy("block").agg(F.collect_list(F.struct("id", "code")).alias("rows")).withColumn("pack", F.lit(None).cast("long"))  # about BLOCK codes, k + 1 ids each at most
    asked = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # A block's rows come before its packs; an explicit number of partitions is not made fewer for small data.
    streams = held.unionByName(asked).repartition(max(parts, min(blocks, 4 * parts)), "block").sortWithinPartitions("block", F.asc_nulls_first("pack")).select("pack", "rows")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            for pack, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = row.values.field("id").to_numpy().astype(np.int64)
                found = row.values.field("code").flatten().to_numpy().astype(np.int64).view(np.uint64).reshape(len(ids), words)
                if pack is None:
                    index = MultiIndex(ids, found)
                elif index is not None:
                    q, d, x = index.top(ids, found, k)
                    yield pa.record_batch([pa.array(ids[q]), pa.FixedSizeListArray.from_arrays(pa.array(found[q].view(np.int64).ravel()), words).cast(pa.list_(pa.int64())), pa.array(x), pa.array(d.astype(np.int32))], names=["query_id", "code", "vec_id", "distance"])

    found = streams.mapInArrow(released(answer), "query_id long, code array<long>, vec_id long, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def op10_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_top_k(table(spark, sf_dir, "embeddings"))


#: The same by comparing each query's signs with every row's.
ORACLE = """
WITH size AS (SELECT max(len(embedding)) AS n FROM embeddings WHERE vec_id IS NOT NULL),
signs AS (
  SELECT vec_id, list_transform(range(1, CAST(n + 1 AS BIGINT)), lambda i: coalesce(embedding[i] > 0, false)) AS s
  FROM embeddings, size WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(len(list_filter(q.s, lambda b, i: b <> x.s[i])) AS INTEGER) AS distance
  FROM signs q JOIN signs x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

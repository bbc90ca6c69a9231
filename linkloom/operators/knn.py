"""Nearest-neighbour joins by inner product: exact in blocks, approximate in cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.functions.vectors import dot


#: Rows of a block of the base, and of a pack of queries.
BLOCK, PACK = 4096, 512


def nearest(ids: np.ndarray, vectors: np.ndarray, asked: np.ndarray, k: int | None, groups: np.ndarray | None = None, asked_groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, neighbour, affinity): of each row of ``asked`` the k of ``ids`` with the largest inner product to 6 places, ties by id; none of its own group, where there are ``groups``."""
    s = np.round(asked @ vectors.T, 6) + 0.0
    if groups is not None:
        s[asked_groups[:, None] == groups] = -np.inf
    if k is not None and k < len(ids):
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
        q, at = np.nonzero(s >= least[:, None])  # k of each row, and those that tie with the last
    else:
        q, at = (x.ravel() for x in np.indices(s.shape))
    if groups is not None:
        met = s[q, at] > -np.inf
        q, at = q[met], at[met]
    order = np.lexsort((ids[at], -s[q, at], q))
    q, at = q[order], at[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    kept = place < (len(ids) if k is None else k)
    return q[kept], ids[at[kept]], s[q[kept], at[kept]]


def knn_join(queries: DataFrame, base: DataFrame, k: int | None = None, include: DataFrame | None = None, exclude: DataFrame | None = None, apart: str | None = None) -> DataFrame:
    """(query, neighbour, affinity, rank): the k of ``base`` (id, vec) with the largest inner product for each of ``queries`` (id, vec), ties by id; all of them without a k.

    ``include`` or ``exclude`` (id) narrow the base, not both. ``apart`` names a column of both; a query meets no row that is equal in it. The base is dealt into blocks of about ``BLOCK`` rows, queries into packs; each block multiplies the packs that stream by
    and keeps their k best, which are then ranked together. Affinities are rounded to 6 places before they are compared, so that the order of a sum does not decide.
    """
    if include is not None and exclude is not None:
        raise ValueError("include or exclude, not both")
    if include is not None:
        base = base.join(include.select("id").distinct(), "id", "left_semi")
    if exclude is not None:
        base = base.join(exclude.select("id").distinct(), "id", "left_anti")
    spark = base.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, packs = (max(1, -(-df.count() // size)) for df, size in ((base, BLOCK), (queries, PACK)))
    rows = lambda df, n, name: df.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)).agg(F.collect_list(F.struct(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), *([F.col(apart).alias("apart")] if apart else []))).alias("rows"))
    # A small base is one block, or a few: each is held as often as its packs need tasks, with a block's worth of queries for each at least.
    turns = max(1, min(packs * PACK // BLOCK, 4 * parts // blocks))
    first, own = F.col("block") * turns, F.col("pack") % turns
    held = rows(base, blocks, "block").select(F.lit(None).cast("int").alias("pack"), "rows", F.explode(F.sequence(first, first + turns - 1)).alias("block"))
    asked = rows(queries, packs, "pack").select("pack", "rows", F.explode(F.sequence(own, own + (blocks - 1) * turns, F.lit(turns))).alias("block"))
    # A block's own rows come before the packs.
    stream = held.unionByName(asked).repartition(max(1, min(blocks * turns, 4 * parts)), "block").sortWithinPartitions("block", F.asc_nulls_first("pack")).select("block", "pack", "rows")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, vectors, groups = None, np.empty(0, np.int64), np.empty((0, 0)), None
        for batch in batches:
            for block, pack, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = row.values.field("id").to_numpy(zero_copy_only=False).astype(np.int64)
                v = row.values.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                g = row.values.field("apart").to_numpy(zero_copy_only=False) if apart else None
                if pack is None:
                    of, ids, vectors, groups = block, x, v, g
                elif of == block:
                    q, n, s = nearest(ids, vectors, v, k, groups, g)
                    place = np.arange(len(q)) - np.searchsorted(q, q) + 1
                    yield pa.record_batch([pa.array(x[q]), pa.array(n), pa.array(s), pa.array(place.astype(np.int32))], names=["query", "neighbour", "affinity", "rank"])

    found = stream.mapInArrow(answer, "query long, neighbour long, affinity double, rank int")
    if blocks == 1:  # each query has met all of the base at once
        return found
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("affinity"), "neighbour")))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def knn_without(queries: DataFrame, base: DataFrame, banned: DataFrame, k: int, shared: DataFrame | None = None, apart: str | None = None) -> DataFrame:
    """Like ``knn_join``, of which each query leaves out itself, its own ``banned`` (query, id) and what is ``shared`` (id); exact, so never fewer than k while there are as many.

    A query asks for as many more as it bans, so nothing has to be asked again. Groups that are banned whole go by ``apart``, as in ``knn_join``, and cost no pairs.
    """
    out = banned.select(F.col("query").cast("long").alias("query"), F.col("id").cast("long").alias("neighbour")).unionByName(queries.select(F.col("id").alias("query"), F.col("id").alias("neighbour")))
    if shared is not None:
        base = base.join(shared.select("id").distinct(), "id", "left_anti")
    most = out.distinct().groupBy("query").count().agg(F.max("count")).first()[0] or 0
    left = knn_join(queries, base, k + most, apart=apart).join(out.distinct(), ["query", "neighbour"], "left_anti")
    again = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return left.withColumn("rank", again).filter(F.col("rank") <= k)


def neighbour_graph(nodes: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance): an edge between each of ``nodes`` (id, vec) and its k nearest others, each pair once."""
    near = knn_without(nodes, nodes, nodes.select(F.col("id").alias("query"), "id").limit(0), k)
    edges = near.select(F.least("query", "neighbour").alias("src"), F.greatest("query", "neighbour").alias("dst"), F.round(1 - F.col("affinity"), 6).alias("distance"))
    return edges.distinct()


def cell_centres(base: DataFrame, cells: int, sample: int = 256) -> DataFrame:
    """One row with ``centres``: the k-means centres of at most ``sample`` vectors a cell, those with the smallest hash of their id."""
    from pyspark.ml.clustering import KMeans  # here, since each worker that multiplies would load all of it
    from pyspark.ml.functions import array_to_vector

    chosen = base.orderBy(F.xxhash64("id"), "id").limit(cells * sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    found = KMeans(k=cells, seed=0, maxIter=10).fit(chosen).clusterCenters()
    rows = [([(i, [float(x) for x in c]) for i, c in enumerate(found)],)]
    return base.sparkSession.createDataFrame(rows, "centres array<struct<cell: int, centre: array<double>>>")


def knn_join_cells(queries: DataFrame, base: DataFrame, k: int, cells: int = 200, probes: int = 75, sample: int = 256) -> DataFrame:
    """(query, neighbour, affinity, rank) like ``knn_join``, of those in the ``probes`` cells whose centres are nearest to the query.

    Each row of ``base`` is in the cell of its nearest centre. With as many probes as cells the result is exact. Only the centres are broadcast:
    their number is a parameter.
    """
    centres = F.broadcast(cell_centres(base, cells, sample))
    order = lambda v: F.transform(F.array_sort(F.transform("centres", lambda c: F.struct((-dot(v, c["centre"])).alias("d"), c["cell"].alias("cell")))), lambda x: x["cell"])
    dealt = base.crossJoin(centres).select(F.col("id").alias("neighbour"), F.col("vec").alias("v"), F.get(order(F.col("vec")), F.lit(0)).alias("cell"))
    sent = queries.crossJoin(centres).select(F.col("id").alias("query"), F.col("vec").alias("q"), F.explode(F.slice(order(F.col("vec")), 1, probes)).alias("cell"))
    best = [F.desc("affinity"), F.asc("neighbour")]
    near = sent.join(dealt, "cell").select("query", "cell", "neighbour", F.round(dot(F.col("q"), F.col("v")), 6).alias("affinity"))
    local = near.withColumn("r", F.row_number().over(Window.partitionBy("query", "cell").orderBy(*best))).filter(F.col("r") <= k).drop("r", "cell")
    return local.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*best))).filter(F.col("rank") <= k)

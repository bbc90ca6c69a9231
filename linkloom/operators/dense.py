"""Documents' complete graphs straight from vectors: pairs, forests and near ones, in tiles of two blocks of a document's mentions.

Only vectors are shuffled, each to as many tiles as its document has blocks; a pair becomes a row only where it is asked for. Nodes are (doc, node, vec) and may have a gold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.graph import kind_of, spanning_forest

#: Nodes of a block, rows of it that are worked on at once, so that they stay in a core's cache, pairs of a batch that leaves a task, and rows of a matrix that is one value.
TILE, SOME, EMIT, HELD = 1024, 64, 1 << 16, 16
#: In an order of affinities, a pair that has none.
NONE = -np.finfo(float).max

#: Rows and columns of two matrices to affinities.
Block = Callable[[np.ndarray, np.ndarray], np.ndarray]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products to 6 places; one near a half of the last place is summed and rounded as ``dot`` and ``round`` do."""
    out = np.empty((len(x), len(y)))
    for k in range(0, len(x), SOME):
        out[k : k + SOME] = rounded(x[k : k + SOME] @ y.T, lambda at: (x[k + at[0]], y[at[1]]))  # noqa: B023
    return out


def rounded(s: np.ndarray, ends: Callable[[tuple], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Inner products ``s``, which it overwrites, to 6 places; ``ends`` gives the two vectors of a place in them."""
    s *= 1e6
    with np.errstate(invalid="ignore"):
        half = np.abs(np.abs(s - np.rint(s)) - 0.5) < 1e-6
    out = np.rint(s)
    out /= 1e6
    for at in zip(*np.nonzero(half), strict=True):
        total = 0.0
        for a, b in zip(*(v.tolist() for v in ends(at)), strict=True):
            total += a * b
        out[at] = float(Decimal(repr(total)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    out += 0.0
    return out


class Rows:
    """Some nodes: ids, golds, vectors filled up with zeros, and their lengths; -1 where a vector or one of its numbers is null."""

    def __init__(self, batches: list[tuple]):
        self.own = np.concatenate([b[0] for b in batches])
        self.ids = np.concatenate([b[1] for b in batches])
        self.gold = np.concatenate([b[2] for b in batches])
        self.size = np.concatenate([b[4] for b in batches])
        wide = max(b[3].shape[1] for b in batches)
        self.vec = np.concatenate([b[3] if b[3].shape[1] == wide else np.pad(b[3], ((0, 0), (0, wide - b[3].shape[1]))) for b in batches])

    def part(self, at) -> Rows:
        out = object.__new__(Rows)
        out.own, out.ids, out.gold, out.size, out.vec = self.own[at], self.ids[at], self.gold[at], self.size[at], self.vec[at]
        return out

    def __len__(self) -> int:
        return len(self.ids)

    def to(self, other: Rows, block: Block) -> np.ndarray:
        """Affinities to ``other``, ``NONE`` where there is none."""
        s = block(self.vec, other.vec)
        if (apart := self.apart(other)) is not None:
            s[apart] = NONE
        s[np.isnan(s)] = NONE
        return s

    def apart(self, other: Rows) -> np.ndarray | None:
        """Which pairs have no affinity for their lengths, if any."""
        if len(self) and len(other) and (self.size.min() < 0 or other.size.min() < 0 or np.any(self.size != self.size[0]) or np.any(other.size != self.size[0])):
            return (self.size[:, None] != other.size) | (self.size[:, None] < 0)
        return None

    def over(self, other: Rows, block: Block, above: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and affinities of more than ``above``. Of products only those that may be are rounded."""
        if block is not products:
            s = self.to(other, block)
            p, q = np.nonzero(s > above)
            return p, q, s[p, q]
        apart, found = self.apart(other), []
        for k in range(0, len(self), SOME):
            s = self.vec[k : k + SOME] @ other.vec.T
            near = s > above - 1e-6
            if apart is not None:
                near &= ~apart[k : k + SOME]
            p, q = np.nonzero(near)
            found.append((p + k, q, s[p, q]))
        p, q, s = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
        w = rounded(s, lambda at: (self.vec[p[at]], other.vec[q[at]]))
        met = w > above
        return p[met], q[met], w[met]


def matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if len(lengths) and lengths.min() == lengths.max() > 0 and flat.null_count == 0:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(lengths), -1), lengths
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))))
    for i, v in enumerate(column.to_pylist()):
        if v is None or None in v:
            lengths[i] = -1
        else:
            out[i, : len(v)] = v
    return out, lengths


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Rows]]:
    """The runs of rows with one (doc, i, j), of a stream in that order."""
    held, of = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("doc", "i", "j")), strict=True))
        if not keys:
            continue
        own, ids, gold = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("own", "node", "gold"))
        vec, size = matrix(batch.column("vec"))
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for a, b in zip(starts, starts[1:], strict=False):
            if held and keys[a] != of:
                yield of, Rows(held)
                held = []
            of = keys[a]
            held.append(tuple(x[a:b].copy() for x in (own, ids, gold, vec, size)))
    if held:
        yield of, Rows(held)


def run(stream: DataFrame, answer: Callable[[tuple, Rows], Iterator[list]], schema: str) -> DataFrame:
    """What ``answer`` gives for each group of ``stream``, whose lists of columns get the group's doc before them."""
    kind = kind_of(stream)
    schema = f"doc {kind}, {schema}"
    names = [c.split()[0] for c in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal doc_type
            for b in batches:
                doc_type = b.schema.field("doc").type
                yield b

        doc_type = None
        for key, rows in grouped(typed()):
            for columns in answer(key, rows):
                arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
                yield pa.record_batch([pa.array([key[0]], doc_type).take(pa.array(np.zeros(len(arrays[0]), np.int32))), *arrays], names=names)

    return stream.mapInArrow(go, schema)


def tasks(nodes: DataFrame) -> int:
    return 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_gold(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc", F.col("node").cast("long").alias("node"), (F.col("gold") if "gold" in nodes.columns else F.lit(-1)).cast("long").alias("gold"), "vec")


def documents(nodes: DataFrame) -> DataFrame:
    """A document a group, nodes in order."""
    rows = with_gold(nodes).select("doc", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own"), "node", "gold", "vec")
    return rows.repartition(tasks(nodes), "doc").sortWithinPartitions("doc", "node")


def tiles(nodes: DataFrame) -> DataFrame:
    """Each node to the tiles (i, j), i <= j, of its block and every block of its document; blocks go by the order of nodes."""
    by, size = Window.partitionBy("doc"), TILE
    place = F.row_number().over(by.orderBy("node")) - 1
    last = F.count(F.lit(1)).over(by) - 1
    block = lambda x: F.floor(x / size).cast("int")
    dealt = with_gold(nodes).select("doc", "node", "gold", "vec", block(place).alias("own"), block(last).alias("last"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    dealt = dealt.select("doc", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "gold", "vec")
    return dealt.repartition(tasks(nodes), "doc", "i", "j").sortWithinPartitions("doc", "i", "j", "own", "node")


def sides(key: tuple, rows: Rows) -> tuple[Rows, Rows]:
    """A tile's two blocks, one and the same on the diagonal."""
    return (rows, rows) if key[1] == key[2] else (rows.part(rows.own == key[1]), rows.part(rows.own == key[2]))


def floats(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == NONE)


def document_pairs(nodes: DataFrame, block: Block = products, above: float | None = None) -> DataFrame:
    """(doc, src, dst, affinity, same): all pairs src < dst of each document, or those of more than ``above``; same where golds are equal."""

    def answer(key: tuple, rows: Rows) -> Iterator[list]:
        x, y = sides(key, rows)
        if above is not None:
            for p, q, w in pairs_over(x, y, block, above):
                yield [x.ids[p], y.ids[q], w, x.gold[p] == y.gold[q]]
            return
        step = max(1, EMIT // max(1, len(y)))
        for at in range(0, len(x), step):
            some = x.part(slice(at, at + step))
            rest = y.part(slice(at, None)) if key[1] == key[2] else y
            s = some.to(rest, block)
            p, q = np.nonzero(some.ids[:, None] < rest.ids)
            if len(p):
                yield [some.ids[p], rest.ids[q], floats(s[p, q]), some.gold[p] == rest.gold[q]]

    return run(tiles(nodes), answer, "src long, dst long, affinity double, same boolean")


def document_blocks(nodes: DataFrame, block: Block = products) -> DataFrame:
    """``document_pairs`` as matrices: lists of src and dst, and the affinities of each src to all dst, src after src, as bytes of little-endian doubles, NaN for none. A place with src >= dst is no pair."""

    def answer(key: tuple, rows: Rows) -> Iterator[list]:
        x, y = sides(key, rows)
        for at in range(0, len(x), SOME):
            some = x.part(slice(at, at + SOME))
            rest = y.part(slice(at, None)) if key[1] == key[2] else y
            s = some.to(rest, block).astype("<f8")
            s[s == NONE] = np.nan
            pieces = -(-len(some) // HELD)
            cuts = np.minimum(np.arange(pieces + 1) * HELD, len(some)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), pieces, [None, pa.py_buffer(cuts * np.int32(8 * len(rest))), pa.py_buffer(s)])
            yield [lists(some.ids, cuts), lists(np.tile(rest.ids, pieces), np.arange(pieces + 1, dtype=np.int32) * len(rest)), held]

    return run(tiles(nodes), answer, "src array<long>, dst array<long>, affinity binary")


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def pairs_of_blocks(blocks: DataFrame) -> DataFrame:
    """(doc, src, dst, affinity): the pairs of ``document_blocks``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            for k, (src, dst, held) in enumerate(zip(*(batch.column(c) for c in ("src", "dst", "affinity")), strict=True)):
                src, dst = (np.asarray(v.values, np.int64) for v in (src, dst))
                s = np.frombuffer(held.as_buffer(), "<f8").reshape(len(src), len(dst))
                p, q = np.nonzero(src[:, None] < dst)
                w = s[p, q]
                yield pa.record_batch([doc.take(pa.array(np.full(len(p), k))), pa.array(src[p]), pa.array(dst[q]), pa.array(w, mask=np.isnan(w))], names=["doc", "src", "dst", "affinity"])

    return blocks.select("doc", "src", "dst", "affinity").mapInArrow(go, f"doc {kind_of(blocks)}, src long, dst long, affinity double")


def pairs_over(x: Rows, y: Rows, block: Block, above: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A tile's pairs of more than ``above``, smaller node first, a batch at a time: their places in x and y, and affinities."""
    p, q, w = x.over(y, block, above)
    asked = x.ids[p] < y.ids[q]
    p, q, w = p[asked], q[asked], w[asked]
    for at in range(0, len(p), EMIT):
        yield tuple(v[at : at + EMIT] for v in (p, q, w))


def document_ends(nodes: DataFrame, above: float, block: Block = products) -> DataFrame:
    """(doc, a, b, affinity): the pairs of more than ``above`` of each document, from either end."""

    def answer(key: tuple, rows: Rows) -> Iterator[list]:
        x, y = sides(key, rows)
        for p, q, w in pairs_over(x, y, block, above):
            yield from ([x.ids[p], y.ids[q], w], [y.ids[q], x.ids[p], w])

    return run(tiles(nodes), answer, "a long, b long, affinity double")


def best_tree(s: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """The maximum spanning tree's edges (u, v), u < v, of a complete graph with affinities ``s`` if ``whole``, else of the one between rows and columns, which are numbered after the rows.

    Of equal affinities the one with the smaller ends, smaller end first: of a node's equal edges that to the smallest. In each round every part takes its best edge to another one;
    a node looks for its own best again only once that leads into its part.
    """
    rows = len(s)
    n = rows if whole else rows + s.shape[1]
    halves = [(0, s, 0)] if whole else [(0, s, rows), (rows, np.ascontiguousarray(s.T), 0)]
    nodes, part = np.arange(n), np.arange(n)
    best, via, stale = np.full(n, -np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    taken = [np.empty(0, np.int64)]
    while n > 1:
        for start, m, to in halves:
            asked = np.flatnonzero(stale[start : start + len(m)])
            for k in (asked[i : i + SOME] for i in range(0, len(asked), SOME)):
                some = m[k]
                some[part[start + k][:, None] == part[to : to + m.shape[1]]] = -np.inf
                at = some.argmax(1)
                best[start + k], via[start + k] = some[np.arange(len(k)), at], to + at
        u, v = np.minimum(nodes, via), np.maximum(nodes, via)
        order = np.lexsort((v, u, -best, part))
        first = order[np.r_[True, np.diff(part[order]) != 0]]
        first = first[best[first] > -np.inf]
        if not len(first):
            break
        taken.append(np.unique(u[first] * n + v[first]))
        up = nodes.copy()
        up[part[first]] = part[via[first]]
        up = np.where((up[up] == nodes) & (nodes < up), nodes, up)  # of two that took one edge
        while np.any(up[up] != up):
            up = up[up]
        part = up[part]
        stale = part == part[via]
    found = np.concatenate(taken)
    return found // n, found % n


def document_forest(nodes: DataFrame, block: Block = products) -> DataFrame:
    """``spanning_forest`` of ``document_pairs``: an edge that the forest of its own tile lacks is in no forest, so tiles send theirs only."""
    return spanning_forest(tile_forests(nodes, block))


def tile_forests(nodes: DataFrame, block: Block = products) -> DataFrame:
    """(doc, src, dst, affinity): each tile's maximum spanning forest; together they have all edges of the documents' forests."""

    def answer(key: tuple, rows: Rows) -> Iterator[list]:
        x, y = sides(key, rows)
        s = x.to(y, block)
        whole = x is y
        if len(np.unique(rows.ids)) < len(rows):
            s[x.ids[:, None] == y.ids] = np.inf  # rows of one node are one
        a, b = best_tree(s, whole)
        ids = x.ids if whole else np.concatenate([x.ids, y.ids])
        w = s[a, b if whole else b - len(x)]
        kept = ids[a] < ids[b]
        if kept.any():
            yield [ids[a[kept]], ids[b[kept]], floats(w[kept])]

    return run(tiles(nodes), answer, "src long, dst long, affinity double")


def first_of(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest, ties to the first column; minus infinity is none."""
    if k < s.shape[1]:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        p, q = np.nonzero((s >= least[:, None]) & (s > -np.inf))
    else:
        p, q = np.nonzero(s > -np.inf)
    order = np.lexsort((q, -s[p, q], p))
    p, q = p[order], q[order]
    start = np.searchsorted(p, np.arange(len(s)))
    kept = np.arange(len(p)) - start[p] < k
    return p[kept], q[kept]


def both_ways(nodes: DataFrame, pick: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], block: Block) -> DataFrame:
    """(doc, a, b, affinity) that ``pick`` takes out of each node's row of a tile; a row has minus infinity at the node itself."""

    def answer(key: tuple, rows: Rows) -> Iterator[list]:
        x, y = sides(key, rows)
        s = x.to(y, block)
        s[x.ids[:, None] == y.ids] = -np.inf
        for own, other, t in ((x, y, s), (y, x, s.T)) if x is not y else ((x, y, s),):
            p, q = pick(t)
            if len(p):
                yield [own.ids[p], other.ids[q], floats(t[p, q])]

    return run(tiles(nodes), answer, "a long, b long, affinity double")


def document_near(nodes: DataFrame, k: int, block: Block = products) -> DataFrame:
    """(doc, a, b, affinity, r): the k others of a's document with the largest affinity, ties to the smallest."""
    near = both_ways(nodes, lambda s: first_of(s, k), block)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("affinity"), "b"))
    return near.withColumn("r", place).filter(F.col("r") <= k)


def document_first(nodes: DataFrame, k: int, above: float, block: Block = products) -> DataFrame:
    """(doc, a, b, affinity): of the others of a's document with more than ``above``, at least the k smallest, or all if there are fewer."""

    def pick(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = s > above
        return np.nonzero(near & (np.cumsum(near, axis=1, dtype=np.int32) <= k))

    return both_ways(nodes, pick, block)

"""Suffix-array dedup: bytes covered by a long string that also starts in an earlier document.

1. Documents are dealt into groups by id. In each window of ``width`` bytes the smallest ``gram``-byte hash is its
   anchor; equal windows have equal anchors. Each group sends its distinct anchor hashes to buckets by hash.
2. A bucket tells each group which of its anchors other groups have too.
3. For shared anchors a group sends its distinct contexts (an anchor's windows end to end), each with the smallest
   doc_id that it holds there, to the anchor's bucket. All windows that are equal meet in one bucket.
4. A bucket's distinct contexts are suffix-sorted by linear grouping (``lyndon``). Equal windows stand together
   in that order; the smallest doc_id of each run says which windows have an earlier holder.
5. The groups get byte intervals back and cut their documents.

Texts cross the network once (steps 1, 3 and 5 read the same exchange). A bucket holds one entry a group and
distinct context however many copies there are, and contexts are compared as bytes, never by hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._docs import LAST_ID, dealt, id_array, in_order, joined, pack, shuffle_parts, table, unpack, words8
from linkloom.llm._spark import bounded_batches, released
from linkloom.llm.lyndon import lyndon_sort

WIDTH, GRAM = 50, 20
#: Bits of a position inside a segment; the rest of a 64-bit key orders the anchors.
POSITION = 25
#: Each bucket is sorted in this many parts, by hash, so that the arrays of the sort stay in a processor's cache.
PARTS = 16
#: Bytes of text for which there is a bucket.
BUCKET_BYTES = 4 << 20
SEPARATOR = 0xFF  # no byte of UTF-8

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def window_anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, end of the windows, and the anchor's hash. No window crosses documents."""
    starts, stops, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    valid = np.ones(len(data), bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    late = (ends[:, None] - 1 - np.arange(width - 1)).ravel()
    valid[late[late >= 0]] = False
    step, mask, span = (1 << POSITION) - width, np.uint64((1 << POSITION) - 1), width - gram + 1
    for lo in range(0, max(0, len(data) - width + 1), step):
        hi = min(lo + step, len(data) - width + 1)
        w = words8(data[lo : hi + width - 1])
        n = hi - lo + width - gram
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
        for at in sorted({*range(8, gram - 7, 8), gram - 8}):
            h += w[at : at + n] * np.uint64((0xD6E8FEB86659FD93 * (2 * at + 1)) & 0xFFFFFFFFFFFFFFFF)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        key = (h & ~mask) | np.arange(n, dtype=np.uint64)
        had = 1
        while 2 * had <= span:
            key = np.minimum(key[:-had], key[had:])
            had *= 2
        if had < span:
            key = np.minimum(key[: had - span], key[span - had :])
        window = np.flatnonzero(valid[lo:hi])
        if not len(window):
            continue
        anchor = (key[window] & mask).astype(np.int64)
        first = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(window) != 1)])
        starts.append(window[first] + lo)
        stops.append(window[np.r_[first[1:] - 1, len(window) - 1]] + lo + 1)
        hashes.append(h[anchor[first]])
    return np.concatenate(starts), np.concatenate(stops), np.concatenate(hashes)


def bucket_keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 bits of the hash in the lower."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Of sorted keys: each bucket with the range of its keys."""
    b = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, np.int64)
    for lo, hi in zip(first, np.r_[first[1:], len(b)], strict=True):
        yield int(b[lo]), int(lo), int(hi)


def rows(schema: pa.Schema, values: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*values, strict=True) if values else [[]] * len(schema), schema.types, strict=True)], schema=schema)


BLOB = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("body", pa.binary())])
BLOB_DDL = "bucket int, grp int, body binary"


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. Rows that share a doc_id are one holder, so neither takes from the other. A null doc_id
    counts as the largest. Documents shorter than ``width`` stay whole. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts, held, partitions = dealt(docs)
    buckets = max(2 * shuffle_parts(spark), -(-held // BUCKET_BYTES))

    def anchors(group: pa.Table) -> pa.Table:
        data, offsets = joined(group.column("text"))
        grp = group.column("grp")[0].as_py()
        keys = np.unique(bucket_keys(window_anchors(data, offsets, width, gram)[2], buckets))
        low = keys.astype(np.uint32)
        return rows(BLOB, [(b, grp, low[lo:hi].tobytes()) for b, lo, hi in by_bucket(keys)])

    def met(bucket: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(x, np.uint32) for x in bucket.column("body").to_pylist()]
        low, of = np.concatenate(bodies), np.repeat(np.arange(len(bodies)), [len(x) for x in bodies])
        order = np.argsort(low, kind="stable")
        same = low[order][1:] == low[order][:-1]
        shared = np.zeros(len(low), bool)
        shared[order[np.r_[False, same] | np.r_[same, False]]] = True
        low, of = low[shared], of[shared]
        cuts, b = np.searchsorted(of, np.arange(len(bodies) + 1)), bucket.column("bucket")[0].as_py()
        return rows(BLOB, [(b, g, low[cuts[i] : cuts[i + 1]].tobytes()) for i, g in enumerate(bucket.column("grp").to_pylist()) if cuts[i + 1] > cuts[i]])

    def contexts(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return rows(BLOB, [])
        group = in_order(group)
        data, offsets = joined(group.column("text"))
        ids, grp = id_array(group.column("doc_id")), group.column("grp")[0].as_py()
        start, stop, h = window_anchors(data, offsets, width, gram)
        keys = bucket_keys(h, buckets)
        order = np.argsort(keys, kind="stable")
        start, stop, keys = start[order], stop[order], keys[order]
        holder = ids[np.searchsorted(offsets, start, side="right") - 1]
        wanted = [np.uint64(b) << np.uint64(32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(told.column("bucket").to_pylist(), told.column("body").to_pylist(), strict=True)]
        keep = np.isin(keys, np.concatenate(wanted)) if wanted else np.zeros(len(keys), bool)
        if len(keys):  # or two documents of this group have it
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            lowest, highest = np.minimum.reduceat(holder, first), np.maximum.reduceat(holder, first)
            keep |= np.repeat(lowest != highest, np.diff(np.r_[first, len(keys)]))
        start, end, keys, holder = start[keep], stop[keep] + width - 1, keys[keep], holder[keep]
        raw, out = data.tobytes(), []
        for b, lo, hi in by_bucket(keys):
            seen: dict[bytes, int] = {}
            of = np.empty(hi - lo, np.uint32)
            part, least = [], []
            where = ((keys[lo:hi] >> np.uint64(28)) & np.uint64(PARTS - 1)).astype(np.uint8).tolist()
            for k, (s, e, p, d) in enumerate(zip(start[lo:hi].tolist(), end[lo:hi].tolist(), where, holder[lo:hi].tolist(), strict=True)):
                c = of[k] = seen.setdefault(raw[s:e], len(seen))
                if c == len(part):
                    part.append(p)
                    least.append(d)
                elif d < least[c]:
                    least[c] = d
            least = np.array(least, np.int64)
            out.append((b, grp, pack(
                np.fromiter(map(len, seen), np.uint32, len(seen)), np.frombuffer(b"".join(seen), np.uint8), np.array(part, np.uint8), least,
                of, start[lo:hi], (holder[lo:hi] > least[of]).astype(np.uint8),
            )))
        return rows(BLOB, out)

    load = pa.schema([("bucket", pa.int32()), ("text", pa.binary()), ("body", pa.binary())])

    def gathered(bucket: pa.Table) -> pa.Table:
        """For each part of a bucket: the distinct contexts end to end, and who holds them."""
        ids: list[dict[bytes, int]] = [{} for _ in range(PARTS)]
        least: list[list[int]] = [[] for _ in range(PARTS)]
        entry: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(PARTS)]
        for grp, body in zip(bucket.column("grp").to_pylist(), bucket.column("body").to_pylist(), strict=True):
            size, raw, part, low, of, start, whole = unpack(body, np.uint32, np.uint8, np.uint8, np.int64, np.uint32, np.int64, np.uint8)
            raw, mine, at = raw.tobytes(), np.empty(len(size), np.uint32), 0
            for k, (n, p, d) in enumerate(zip(size.tolist(), part.tolist(), low.tolist(), strict=True)):
                seen, mins = ids[p], least[p]
                c = mine[k] = seen.setdefault(raw[at : at + n], len(seen))
                at += n
                if c == len(mins):
                    mins.append(d)
                elif d < mins[c]:
                    mins[c] = d
            where = part[of]
            for p in range(PARTS):
                if len(x := np.flatnonzero(where == p)):
                    entry[p].append((np.full(len(x), grp, np.int32), mine[of[x]], low[of[x]], start[x], whole[x]))
        out = []
        for p in range(PARTS):
            if ids[p]:
                e = [np.concatenate(c) for c in zip(*entry[p], strict=True)]
                text = bytes([SEPARATOR]).join([*ids[p], b""])
                out.append((bucket.column("bucket")[0].as_py(), text, pack(np.fromiter(map(len, ids[p]), np.uint32, len(ids[p])), np.array(least[p], np.int64), *e)))
        return rows(load, out)

    back = pa.schema([("grp", pa.int32()), ("body", pa.binary())])

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                g, a, z = (np.concatenate(c) for c in zip(*held, strict=True))
                order = np.argsort(g, kind="stable")
                g, a, z = g[order], a[order], z[order]
                first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
                yield from rows(back, [(int(g[lo]), pack(a[lo:hi], z[lo:hi])) for lo, hi in zip(first, np.r_[first[1:], len(g)], strict=True)]).to_batches()
                held.clear()

        for batch in batches:
            for bucket, text, order, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now:
                    yield from told()
                    now = bucket
                held.append(removals(np.frombuffer(text, np.uint8), np.frombuffer(order, np.int32), unpack(body, np.uint32, np.int64, np.int32, np.uint32, np.int64, np.int64, np.uint8), width))
        yield from told()

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(group: pa.Table, told: pa.Table) -> pa.Table:
        if not group.num_rows:
            return rows(result, [])
        group = in_order(group)
        data, offsets = joined(group.column("text"))
        delta = np.zeros(len(data) + 1, np.int32)
        for body in told.column("body").to_pylist():
            a, z = unpack(body, np.int64, np.int64)
            np.add.at(delta, a, 1)
            np.add.at(delta, z, -1)
        gone = np.cumsum(delta[:-1]) > 0
        total, out = np.r_[0, np.cumsum(gone)], []
        for d, a, z in zip(group.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            n, kept, spans = int(total[z] - total[a]), data[a:z], 0
            if n:
                mine = gone[a:z]
                spans, kept = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()), kept[~mine]
            out.append((d, z - a, n, spans, hashlib.sha256(kept).hexdigest()))
        return rows(result, out)

    met_by_group = parts.groupBy("grp").applyInArrow(anchors, BLOB_DDL).repartition(partitions, "bucket").groupBy("bucket").applyInArrow(met, BLOB_DDL)
    sent = parts.groupBy("grp").cogroup(met_by_group.groupBy("grp")).applyInArrow(contexts, BLOB_DDL)
    loads = sent.repartition(partitions, "bucket").groupBy("bucket").applyInArrow(gathered, "bucket int, text binary, body binary")
    ordered = loads.select("bucket", "text", lyndon_sort(spark, F.col("text")).alias("suffixes"), "body")
    removed = ordered.mapInArrow(released(decided), "grp int, body binary")
    return parts.groupBy("grp").cogroup(removed.groupBy("grp")).applyInArrow(cut, RESULT)


def removals(text: np.ndarray, order: np.ndarray, body: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, start and end of the byte intervals that one part of a bucket removes."""
    size, least, e_grp, e_ctx, e_low, e_start, e_whole = body
    size = size.astype(np.int64)
    begin = np.cumsum(np.r_[0, size[:-1] + 1])
    of = np.repeat(np.arange(len(size)), size + 1)
    window = np.arange(len(text)) - begin[of] <= (size - width)[of]
    sa = order[window[order]].astype(np.int64)  # the starts of windows, in the order of their suffixes
    w = words8(np.r_[text, np.zeros(8, np.uint8)])
    new = np.zeros(max(0, len(sa) - 1), bool)
    for at in sorted({*range(0, width - 7, 8), width - 8}):
        x = w[sa + at]
        new |= x[1:] != x[:-1]
    first = np.flatnonzero(np.r_[True, new])
    holder = np.full(len(text), LAST_ID, np.int64)
    holder[sa] = np.repeat(np.minimum.reduceat(least[of[sa]], first), np.diff(np.r_[first, len(sa)]))
    whole = e_whole.astype(bool)  # an earlier document of the same group has the context itself
    grp, a, z = [e_grp[whole]], [e_start[whole]], [e_start[whole] + size[e_ctx[whole]]]
    e_grp, e_ctx, e_low, e_start = e_grp[~whole], e_ctx[~whole], e_low[~whole], e_start[~whole]
    n = size[e_ctx] - width + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(np.r_[0, n[:-1]]) if len(n) else n, n)
    gone = np.flatnonzero(holder[begin[e_ctx[of]] + step] < e_low[of])
    if len(gone):
        lead = np.r_[True, (np.diff(gone) != 1) | (of[gone][1:] != of[gone][:-1])]
        lo, hi = gone[lead], gone[np.r_[np.flatnonzero(lead)[1:] - 1, len(gone) - 1]]
        grp.append(e_grp[of[lo]])
        a.append(e_start[of[lo]] + step[lo])
        z.append(e_start[of[hi]] + step[hi] + width)
    return np.concatenate(grp), np.concatenate(a), np.concatenate(z)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))

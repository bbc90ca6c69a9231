"""Line dedup by a sharded minimal perfect hash over distinct line hashes.

1. Documents are dealt into groups by id. A group sends each distinct line hash once, with the number of its documents that
   hold it and the largest of them, to the hash's shard.
2. A shard builds a minimal perfect hash over its distinct hashes; it indexes arrays of fingerprints, document counts and last holders.
   The groups' hashes probe these arrays; those that are frequent go back to the group with the last holder.
3. The groups read their texts again (the same exchange) and drop lines.

A shard gets one entry a group and line, so a line of all documents weighs as much as any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from linkloom.llm._docs import LAST_ID, LOWER_BYTES, dealt, id_array, pack, shuffle_parts, table, unpack
from linkloom.llm._spark import bounded_batches

MIN_CHARS, MIN_DOCS = 40, 5
#: Bytes of text whose lines' hashes make a shard.
SHARD_BYTES = 16 << 20
BLANKS = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level a key alone at its place is settled, the others go on."""

    def __init__(self, keys: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (is the place taken, rank of the place)
        settled = 0
        while len(keys):
            size = max(64, int(room * len(keys)))
            place = self.place(keys, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            self.levels.append((alone, np.cumsum(alone) + (settled - 1)))
            settled += int(alone.sum())
            keys = keys[~alone[place]]

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        x = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(30))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, 0 to n - 1; of a key that was not built in, any index or -1."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(open_):
                break
            place = self.place(keys[open_], level, len(alone))
            hit = alone[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return out


class LineIndex:
    """A shard: arrays of fingerprint, documents and last holder, in the order of a minimal perfect hash."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, docs: np.ndarray, last: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys, prints, docs, last = keys[order], prints[order], docs[order], last[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.hash = PerfectHash(keys[first])
        at = self.hash(keys[first])
        self.prints, self.docs, self.last = np.empty(len(first), np.uint32), np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        if len(first):
            self.prints[at], self.docs[at], self.last[at] = prints[first], np.add.reduceat(docs, first), np.maximum.reduceat(last, first)

    def probe(self, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents that hold each line (0 if it is unknown), and the largest of them."""
        at = self.hash(keys)
        known = at >= 0
        known[known] = self.prints[at[known]] == prints[known]
        docs, last = np.zeros(len(keys), np.int64), np.full(len(keys), LAST_ID, np.int64)
        docs[known], last[known] = self.docs[at[known]], self.last[at[known]]
        return docs, last


def line_digests(text: bytes, min_chars: int) -> list[bytes | None]:
    """For each line, 16 bytes that stand for its key, or None if the key is too short to count."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(BLANKS)
        if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
            out.append(None)
        else:
            out.append(hashlib.blake2b(key.translate(LOWER_BYTES), digest_size=16).digest())
    return out


DIGEST = np.dtype([("key", "<u8"), ("shard", "<u4"), ("print", "<u4")])
SENT = pa.schema([("shard", pa.int32()), ("grp", pa.int32()), ("body", pa.binary())])
SENT_DDL = "shard int, grp int, body binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def as_table(schema: pa.Schema, values: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*values, strict=True) if values else [[]] * len(schema), schema.types, strict=True)], schema=schema)


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, texts: bool = True) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, kept_sha256, and kept (the text that is left, as bytes) if ``texts``.

    A null text is empty and has one empty line. A line stays in the largest doc_id that holds it, in all rows of that id; a null id
    counts as the largest. Rows that share a doc_id count as documents of their own. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    parts, held, partitions = dealt(docs)
    shards = max(2 * shuffle_parts(docs.sparkSession), -(-held // SHARD_BYTES))

    def sent(group: pa.Table) -> pa.Table:
        ids, texts = id_array(group.column("doc_id")).tolist(), group.column("text").to_pylist()
        found: dict[bytes, list[int]] = {}
        for d, text in zip(ids, texts, strict=True):
            for x in {*line_digests(text or b"", min_chars)} - {None}:
                if x in found:
                    found[x][0] += 1
                    found[x][1] = max(found[x][1], d)
                else:
                    found[x] = [1, d]
        x = np.frombuffer(b"".join(found), DIGEST)
        n, last = (np.array([v[k] for v in found.values()], np.int64) for k in (0, 1))
        shard = (x["shard"] % np.uint32(shards)).astype(np.int64)
        order, grp = np.argsort(shard, kind="stable"), group.column("grp")[0].as_py()
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        return as_table(SENT, [(s, grp, pack(x["key"][o], x["print"][o], n[o], last[o], x["shard"][o])) for s in range(shards) if len(o := order[cuts[s] : cuts[s + 1]])])

    def probed(shard: pa.Table) -> pa.Table:
        bodies = [unpack(b, np.uint64, np.uint32, np.int64, np.int64, np.uint32) for b in shard.column("body").to_pylist()]
        index = LineIndex(*(np.concatenate([b[k] for b in bodies]) for k in range(4)))
        out = []
        for grp, (key, prints, _, _, rest) in zip(shard.column("grp").to_pylist(), bodies, strict=True):
            n, last = index.probe(key, prints)
            if len(hot := np.flatnonzero(n >= min_docs)):
                x = np.empty(len(hot), DIGEST)
                x["key"], x["print"], x["shard"] = key[hot], prints[hot], rest[hot]
                out.append((0, grp, pack(x.view(np.uint8), last[hot])))
        return as_table(SENT, out)

    def cut(group: pa.Table, told: pa.Table) -> pa.Table:
        last: dict[bytes, int] = {}
        for body in told.column("body").to_pylist():
            x, holder = unpack(body, np.uint8, np.int64)
            raw = x.tobytes()
            last.update((raw[16 * i : 16 * i + 16], d) for i, d in enumerate(holder.tolist()))
        out = []
        for d, text in zip(group.column("doc_id").to_pylist(), group.column("text").to_pylist(), strict=True):
            text, mine = text or b"", LAST_ID if d is None else d
            digests = line_digests(text, min_chars) if last else []
            kept = [line for line, x in zip(text.split(b"\n"), digests, strict=True) if last.get(x, mine) == mine] if last else text.split(b"\n")
            n, left = text.count(b"\n") + 1, b"\n".join(kept)
            out.append((d, n, n - len(kept), hashlib.sha256(left).hexdigest(), left if texts else None))
        return as_table(RESULT, out)

    told = parts.groupBy("grp").applyInArrow(sent, SENT_DDL).repartition(partitions, "shard").groupBy("shard").applyInArrow(probed, SENT_DDL)
    out = parts.groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary")
    return out if texts else out.drop("kept")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), texts=False)

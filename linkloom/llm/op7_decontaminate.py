"""Benchmark decontamination with suffix arrays over the training documents.

Each batch of documents is a shard: its words become numbers of a vocabulary of the benchmark (0: any other word), and a suffix array
lists, in order, the suffixes that could match, that is, whose first words are all benchmark words. Every benchmark suffix is looked up by
binary search; the range it finds holds all places of its window. Places that go on along one diagonal are one longest match.

No words of documents move: the benchmark goes to the documents, in blocks of bounded size, each a broadcast of its own, and in rounds of a few blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._docs import table, words_of
from linkloom.llm._spark import bounded_batches, checkpointed, released

WINDOW = 10
#: Bytes of benchmark text in a block.
BLOCK_BYTES = 4 << 20
#: Blocks that a worker holds at once.
ROUND = 4
#: Bytes of document text in a shard; a longer document is a shard of its own.
SHARD_BYTES = 4 << 20


@dataclass
class Suffixes:
    """The distinct windows of a block of the benchmark, packed into comparable integers, and which items have them where."""

    vocabulary: dict[bytes, int]
    bits: int
    low: np.ndarray  # (column, window): packed words, with zeros behind a short window
    high: np.ndarray  # the same with ones behind it
    width: np.ndarray
    owners: np.ndarray  # of each window, where its places begin in the next two
    item: np.ndarray
    at: np.ndarray  # first word, in the item
    items: list

    @classmethod
    def of(cls, rows: list[tuple], window: int) -> Suffixes:
        vocabulary: dict[bytes, int] = {}
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        items = []
        for item, text in rows:
            if w := words_of((text or "").encode()):
                x = [vocabulary.setdefault(y, len(vocabulary) + 1) for y in w]
                k = min(window, len(x))
                for i in range(len(x) - k + 1):
                    places.setdefault(tuple(x[i : i + k]), []).append((len(items), i))
                items.append(item)
        bits = max(1, len(vocabulary).bit_length())
        ones, shape = (1 << bits) - 1, (len(places), window)
        pack = lambda fill: packed(np.array([[*x, *[fill] * (window - len(x))] for x in places], np.uint64).reshape(shape).T, bits)
        flat = np.array([p for own in places.values() for p in own], np.int64).reshape(-1, 2)
        return cls(vocabulary, bits, pack(0), pack(ones), np.array([len(x) for x in places], np.int64), np.cumsum([0, *map(len, places.values())]), flat[:, 0], flat[:, 1], items)


def packed(columns: np.ndarray, bits: int) -> np.ndarray:
    """Rows of words (a row for each place in the window) as as few 64-bit integers as hold them."""
    each = 64 // bits
    out = []
    for lo in range(0, len(columns), each):
        x = np.zeros(columns.shape[1], np.uint64)
        for col in columns[lo : lo + each]:
            x = (x << np.uint64(bits)) | col
        out.append(x)
    return np.array(out, np.uint64).reshape(len(out), columns.shape[1])


def search(array: np.ndarray, asked: np.ndarray, after: bool) -> np.ndarray:
    """By binary search in sorted packed suffixes: how many are smaller (or, if ``after``, not larger) than each one asked for."""
    low, high = np.zeros(asked.shape[1], np.int64), np.full(asked.shape[1], array.shape[1], np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for have, want in zip(array, asked, strict=True):
            h, w = have[mid], want[open_]
            less |= same & (h < w)
            same &= h == w
        less |= same & after
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def hits(tokens: list[np.ndarray], tests: Suffixes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, window) for each place of a window in one shard."""
    gap = np.zeros(window, np.int64)  # no window crosses documents
    starts = np.cumsum([0, *(len(t) + window for t in tokens)])
    ids = np.concatenate([x for t in tokens for x in (t, gap)] or [gap]).astype(np.uint64)
    least = int(tests.width.min(initial=window))
    place = np.flatnonzero(ids[: len(ids) - window + 1])
    for k in range(1, least):
        place = place[ids[place + k] > 0]
    keys = packed(np.array([ids[place + k] for k in range(window)], np.uint64).reshape(window, len(place)), tests.bits)
    order = np.lexsort(keys[::-1])
    place, keys = place[order], keys[:, order]  # the suffix array, and what it compares
    lo, hi = search(keys, tests.low, False), search(keys, tests.high, True)
    n = hi - lo
    of = np.repeat(np.arange(len(n)), n)
    hit = place[np.repeat(lo, n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
    doc = np.searchsorted(starts, hit, side="right") - 1
    return doc, hit - starts[doc], of


def spread(keys: np.ndarray, tests: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For windows: which of ``keys`` each place in an item belongs to, and the place."""
    n = tests.owners[keys + 1] - tests.owners[keys]
    return np.repeat(np.arange(len(keys)), n), np.repeat(tests.owners[keys] - np.cumsum(n) + n, n) + np.arange(n.sum())


def matches(found: tuple[np.ndarray, np.ndarray, np.ndarray], tests: Suffixes) -> tuple[np.ndarray, ...]:
    """(document, item, document start, item start, words) of the longest matches, in that order: places that go on along one diagonal are one."""
    doc, hit, of = found
    which, place = spread(of, tests)
    doc, hit, width, item, at = doc[which], hit[which], tests.width[of[which]], tests.item[place], tests.at[place]
    order = np.lexsort((hit, hit - at, item, doc))
    doc, item, hit, at, width = doc[order], item[order], hit[order], at[order], width[order]
    if not len(hit):
        return (hit,) * 5
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(hit - at) != 0) | (np.diff(hit) != 1)])
    last = np.r_[first[1:], len(hit)] - 1
    return doc[first], item[first], hit[first], at[first], hit[last] - hit[first] + width[last]


def owners(found: tuple[np.ndarray, np.ndarray, np.ndarray], tests: Suffixes, docs: int) -> list[list[int]]:
    """The items of each document, without their places: a window counts once, however often it stands there."""
    pairs = np.unique(found[0] * len(tests.width) + found[2]) if len(found[0]) else np.empty(0, np.int64)
    which, place = spread(pairs % max(1, len(tests.width)), tests)
    both = np.unique((pairs // max(1, len(tests.width)))[which] * max(1, len(tests.items)) + tests.item[place])
    out: list[list[int]] = [[] for _ in range(docs)]
    for x in both.tolist():
        out[x // len(tests.items)].append(x % len(tests.items))
    return out


PLACES = "matches array<struct<item_id: string, doc_start: long, item_start: long, n_words: long>>"
RESULT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_words", pa.int64())]))
SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
#: What a round carries on of each document: intervals of hit words, items, and matches if they are asked for.
CARRIED = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("hit", SPANS), ("items", pa.list_(pa.string())), ("matches", MATCHES)])
CARRIED_DDL = f"doc_id long, text binary, hit array<struct<lo: long, hi: long>>, items array<string>, {PLACES}"


def benchmark_rounds(benchmark: DataFrame, window: int) -> Iterator[tuple[list, bool]]:
    """Broadcasts of the benchmark's suffixes, ``ROUND`` blocks at a time, each of a bounded part of the items; and whether they are the last."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    bytes_ = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-bytes_ // BLOCK_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    one = lambda i: b.sparkSession.sparkContext.broadcast(Suffixes.of([tuple(r) for r in b.filter(part == i).distinct().orderBy("item_id", "text").collect()], window))
    for lo in range(0, n, ROUND):
        yield [one(i) for i in range(lo, min(n, lo + ROUND))], lo + ROUND >= n


def by_shards(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of up to ``SHARD_BYTES`` of text; a longer document is one of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        lo = 0
        for i, n in enumerate(lengths):
            if size and size + n > SHARD_BYTES:
                held.append(batch.slice(lo, i - lo))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, lo = [], 0, i
            size += n + 64
        held.append(batch.slice(lo))
    whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
    yield from whole[:1]


def read_words(texts: pa.Array) -> list[list[bytes]]:
    raw = (t.as_py() or b"" for t in texts)
    return [words_of(t if isinstance(t, bytes) else t.encode("utf-8", "replace")) for t in raw]


def numbers(words: list[list[bytes]], tests: Suffixes) -> list[np.ndarray]:
    get = tests.vocabulary.get
    return [np.array([get(w, 0) for w in x], np.int64) for x in words]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, places: bool = True) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and if ``places`` matches (item, places and length of each).

    A null or empty text has no words and no hits; an item without words has no windows. Items that share an id count as one. A null item_id
    is named by the empty string. Repeated rows are documents of their own. Other columns are not read; an empty table gives no rows.
    A benchmark of more than ``ROUND`` blocks goes over the documents in several rounds, so that a worker never holds more of it.
    """
    bounded_batches(docs.sparkSession)

    def gathered(batch: pa.RecordBatch, blocks: list) -> tuple[list, ...]:
        words = read_words(batch.column(1))
        hit, items, listed = (c.to_pylist() for c in batch.columns[2:])
        for block in blocks:
            tests = block.value
            found = hits(numbers(words, tests), tests, window)
            width = tests.width[found[2]]
            order = np.lexsort((found[1], found[0]))
            for d, lo, hi in zip(*merged(found[0][order], found[1][order], (found[1] + width)[order]), strict=True):
                hit[d].append({"lo": lo, "hi": hi})
            for d, own in enumerate(owners(found, tests, len(words))):
                items[d] = sorted({*items[d], *(tests.items[i] or "" for i in own)})
            if places:
                for d, i, a, b, n in zip(*(x.tolist() for x in matches(found, tests)), strict=True):
                    listed[d].append({"item_id": tests.items[i] or "", "doc_start": a, "item_start": b, "n_words": n})
        return words, hit, items, listed

    def carry(blocks: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_shards(batches, 1):
                _, *columns = gathered(batch, blocks)
                yield pa.record_batch([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, CARRIED.types[2:], strict=True))], schema=CARRIED)

        return released(run)

    def finish(blocks: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_shards(batches, 1):
                words, hit, items, listed = gathered(batch, blocks)
                n_hit = [covered(x) for x in hit]
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64())]
                columns += [pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())]
                names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                yield pa.record_batch([batch.column(0), *columns, *([pa.array(listed, MATCHES)] if places else [])], names=names + ["matches"] * places)

        return released(run)

    none = [F.array().cast(t.partition(" ")[2]).alias(t.partition(" ")[0]) for t in ("hit array<struct<lo: long, hi: long>>", "items array<string>", PLACES)]
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *none)
    for blocks, last in benchmark_rounds(benchmark, window):
        if last:
            return held.mapInArrow(finish(blocks), RESULT_DDL + (f", {PLACES}" if places else ""))
        held = checkpointed(held.mapInArrow(carry(blocks), CARRIED_DDL))
        for block in blocks:
            block.destroy()


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Intervals by document and start, joined where they touch."""
    if not len(doc):
        return [], [], []
    step = int(hi.max()) + 1  # documents apart, so that one running maximum serves all
    a, z = doc * step + lo, np.maximum.accumulate(doc * step + hi)
    first = np.flatnonzero(np.r_[True, a[1:] > z[:-1]])
    last = np.r_[first[1:], len(a)] - 1
    return doc[first].tolist(), lo[first].tolist(), (z[last] - doc[first] * step).tolist()


def covered(spans: list[dict]) -> int:
    total = at = 0
    for s in sorted(spans, key=lambda s: s["lo"]):
        total += max(0, s["hi"] - max(s["lo"], at))
        at = max(at, s["hi"])
    return total


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that no window of the benchmark occurs in, with all their columns. Rows with a null or empty text stay."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(blocks: list) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in by_shards(batches, at):
                words, keep = read_words(batch.column(at)), np.ones(batch.num_rows, bool)
                for block in blocks:
                    keep[hits(numbers(words, block.value), block.value, window)[0]] = False
                yield batch.filter(pa.array(keep))

        return released(run)

    for blocks, last in benchmark_rounds(benchmark, window):
        left = docs.mapInArrow(clean(blocks), docs.schema)
        if last:
            return left
        docs = checkpointed(left)
        for block in blocks:
            block.destroy()


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), places=False)

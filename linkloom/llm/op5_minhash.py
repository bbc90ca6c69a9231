"""MinHash near-dedup: universal hash minima, banding, signature verification, exact checks, alternating stars.

Documents with one shingle set are one node. Nodes that agree in a band meet in a bucket. A bucket isn't expanded into pairs: its
most central node (the one with most bucket mates over all bands) leads it, and each member is checked against the leader on full sets.
Members that this leaves outside their leader's component (strays) are then held against those members of the bucket that lie in other components.
Most of these pairs fall to an exact bound on what they can have in common: of the leader's shingles, those that neither lacks; of each
one's further shingles, those whose bit the other's mask has too. What is left is compared by signature, and what agrees is
checked on full sets too. So any two nodes that share a bucket end up in one component, or can't be linked, or have been compared. Components come from alternating large-star and small-star.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._docs import LAST_ID, LOWER_BYTES, table
from linkloom.llm._spark import bounded_batches, checkpointed, released, small

SHINGLE, PERCENT = 4, 80
#: 32 bands of 4 minima: a pair at a similarity of 0.8 shares none with a probability of 5e-8.
BANDS, ROWS = 32, 4
#: Of 128 one-bit minima, so many must agree before full sets are compared; at a similarity of 0.8, 115 do on average, and fewer than this with a probability of 7e-9.
AGREE = 93
#: Bytes of text whose words are hashed at once.
PIECE = 1 << 20
#: Members of a bucket that are held against one copy of their leader's set.
PACK = 256
#: Bits of the masks of a leader's shingles that a member lacks, and of its further ones. A bit stands for one shingle at least, so the bound holds at any length.
MASK = 256

_draw = np.random.default_rng(5)
_A = (_draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _draw.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


_T = _draw.integers(0, 2**64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 2**64))
_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ``_P`` and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, x in (("up", _P), ("down", _INVERSE)):
            _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16) - 1, x, np.uint64)])
    return _powers["up"][:n], _powers["down"][:n]


def piece_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each word of a piece: a polynomial in random values of its bytes, as a difference of running sums."""
    word = _WORD[data]
    edges = np.flatnonzero(np.diff(np.r_[False, word, False]))
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_T[data] * up[: len(data)])]
    x = (total[end] - total[start]) * down[start]
    x ^= x >> np.uint64(32)
    return start, x * np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word. Long data goes in pieces that end between words; a word longer than a piece has a hash of its own kind, at any place the same."""
    starts, found, lo = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    whole = np.frombuffer(data, np.uint8)
    while lo < len(data):
        hi = min(lo + PIECE, len(data))
        if hi < len(data):
            gaps = np.flatnonzero(~_WORD[whole[lo:hi]])
            if not len(gaps):  # the word may have begun here, or be cut off by the end of the data
                gap = np.flatnonzero(~_WORD[whole[hi:]])
                hi = hi + int(gap[0]) if len(gap) else len(data)
                starts.append(np.array([lo]))
                found.append(np.array([int.from_bytes(hashlib.blake2b(data[lo:hi], digest_size=8).digest(), "little")], np.uint64))
                lo = hi
                continue
            hi = lo + int(gaps[-1]) + 1
        at, x = piece_hashes(whole[lo:hi])
        starts.append(at + lo)
        found.append(x)
        lo = hi
    return np.concatenate(starts), np.concatenate(found)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text the distinct hashes, in order, of all runs of ``size`` words; of the whole text if it has fewer words, none if it has none."""
    start, w = word_hashes(b" ".join([*texts, b""]).translate(LOWER_BYTES))  # a gap after each word
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, np.int64)
    cuts = np.r_[0, np.searchsorted(start, ends)]
    h = run_hashes(w, size)
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        else:
            out.append(run_hashes(w[lo:hi], hi - lo) if hi > lo else np.empty(0, np.uint64))
    return out


def run_hashes(w: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(w) - k + 1)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def minima(sets: np.ndarray) -> np.ndarray:
    x, out = (sets >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(x), 2048):
        np.minimum(out, (_A[:, None] * x[lo : lo + 2048] + _B[:, None]).min(1), out=out)
    return out


def mixed(m: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, different in different bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for col in m.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = (key ^ col) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("b0", pa.int64()), ("b1", pa.int64()), ("bands", pa.list_(pa.int64()))])


def signed(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in SIGNED]
            for d, s in zip(batch.column(0).to_pylist(), shingle_sets([x.as_py() or b"" for x in batch.column(1)], size), strict=True):
                if len(s):
                    m = minima(s)
                    bits = np.packbits((m >> np.uint32(7) & np.uint32(1)).astype(np.uint8)).view(np.int64)
                    row = (d, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), int(bits[0]), int(bits[1]), mixed(m))
                else:
                    row = (d, 0, None, 0, 0, None)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, SIGNED.types, strict=True)], schema=SIGNED)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(released(run), "doc_id long, n long, same binary, b0 long, b1 long, bands array<long>")


JUDGED = "a long, b long, link boolean, held long, more long, m0 long, m1 long, m2 long, m3 long, p0 long, p1 long, p2 long, p3 long"


def judged(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) by their full sets: whether they link, n of a, how many of b's shingles a lacks, masks of a's that b lacks (m0 to m3) and of b's that a lacks (p0 to p3).

    The pairs of one a go in packs of about ``PACK``; a pack is a's set once, then those of its bs, so that no a is a hot key and none is sent with each pair.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets([x.as_py() or b"" for x in batch.column(1)], size)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["id", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.empty(0, np.uint64)
        for batch in batches:
            out, masks = [], np.zeros((2, batch.num_rows, MASK), np.uint8)
            for a, b, of in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                of = np.frombuffer(of.as_buffer(), np.uint64)
                if b is None:
                    x = of.copy()  # the batch may end before the pack does
                    continue
                lacks, further = x[~np.isin(x, of, assume_unique=True)], of[~np.isin(of, x, assume_unique=True)]
                masks[0, len(out), lacks % np.uint64(MASK)] = 1
                masks[1, len(out), further % np.uint64(MASK)] = 1
                common = len(x) - len(lacks)
                out.append((a, b, 100 * common >= percent * (len(x) + len(of) - common), len(x), len(further)))
            words = np.packbits(masks[:, : len(out)], axis=2).view(np.int64)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)]
            columns += [pa.array(words[k, :, i].copy()) for k in range(2) for i in range(4)]
            yield pa.record_batch(columns, names=["a", "b", "link", "held", "more", "m0", "m1", "m2", "m3", "p0", "p1", "p2", "p3"])

    bounded_batches(docs.sparkSession)
    wanted = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    have = docs.withColumnRenamed("doc_id", "id").join(small(wanted, wanted.count()), "id", "left_semi").select("id", "text").mapInArrow(released(sets), "id long, shingles binary")
    packs = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs")))
    many = packs.filter("packs > 1")  # fewer than the pairs by a factor of PACK at least
    packed = pairs.join(small(many, many.count()), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("packs", F.lit(1))).alias("pack"))
    members = packed.join(have.withColumnRenamed("id", "b"), "b").select("a", "b", "pack", "shingles")
    heads = packs.join(have.withColumnRenamed("id", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1)).alias("pack"), "shingles")
    both = members.unionByName(heads).repartition("a", "pack").sortWithinPartitions("a", "pack", F.asc_nulls_first("b"))
    return both.select("a", "b", "shingles").mapInArrow(released(compare), JUDGED)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge (a, b); the component is its smallest node."""
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    before = None
    while True:
        # Large star: each node tells its larger neighbours of its smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node tells its smaller neighbours, and itself, of the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = checkpointed(edges)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with a column ``key``, and how many ids are null or repeated. The key is the id; where that is null or repeated, a negative hash of id and text, so that
    rows with different texts have different keys (63 bits: among 10 million such rows, two share one with a probability of 5e-6)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__id"))
    clash = checkpointed(ids.groupBy("__id").agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1 or __id is null"))
    many = clash.count()
    id_ = F.col("doc_id").cast("long")
    if not many:
        return docs.withColumn("key", id_), 0
    own = F.bitwise_not(F.shiftrightunsigned(F.xxhash64(id_, F.col("text").cast("binary")), 1))
    marked = docs.join(small(clash, many), id_ == F.col("__id"), "left")
    return marked.withColumn("key", F.when(id_.isNull() | F.col("__rows").isNotNull(), own).otherwise(id_)).drop("__id", "__rows"), many


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept (whether the row is that one).

    Null and empty texts, and texts without words, have no shingles and link with nothing; fewer words than a shingle are one. Rows with a null or
    a repeated doc_id are documents of their own, each by its text. A null doc_id counts as the largest and is returned as null. Of a component's rows with the smallest
    doc_id, those of one text are kept. Other columns are not read; an empty table gives no rows.
    """
    return grouped(*keyed(docs.select("doc_id", "text")), shingle, percent).drop("key")


def grouped(docs: DataFrame, clashes: int, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``near_duplicates`` for what ``keyed`` gives, with their keys. The keys are the nodes; a doc_id serves for what is reported and for the order."""
    rows = docs.select("key", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    names = checkpointed(rows.filter("doc_id is null or key <> doc_id").select("key", "doc_id").distinct()) if clashes else None
    docs = rows.select(F.col("key").alias("doc_id"), "text")
    slim = checkpointed(signed(docs, shingle))
    if clashes:  # a key's text once, where full sets are compared
        alone = rows.filter("key = doc_id").select("key", "text")
        docs = alone.unionByName(rows.filter("doc_id is null or key <> doc_id").select("key", "text").dropDuplicates(["key"])).withColumnRenamed("key", "doc_id")
    nodes = slim.filter("n > 0").groupBy("same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.first("bands").alias("bands"))
    nodes = checkpointed(nodes)
    spread = nodes.select("id", F.explode("bands").alias("band"))
    sizes = spread.groupBy("band").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    hits = checkpointed(spread.join(sizes, "band").select("id", "band", "mates"))
    central = hits.groupBy("id").agg(F.sum("mates").alias("mates"))
    leaders = checkpointed(
        hits.select("id", "band").join(central, "id").groupBy("band").agg(F.max(F.struct("mates", (-F.col("id")).alias("id"))).alias("top")).select("band", (-F.col("top.id")).alias("leader"))
    )
    stars = checkpointed(hits.join(leaders, "band").filter("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    rays = checkpointed(judged(docs, stars, shingle, percent))
    first = components(rays.filter("link").select("a", "b"))
    member = hits.select("id", "band").join(nodes.select("id", "n", "b0", "b1"), "id").join(first.withColumnRenamed("node", "id"), "id", "left")
    member = member.withColumn("component", F.coalesce("component", "id"))
    leading = leaders.join(first.withColumnRenamed("node", "leader"), "leader", "left").select("band", F.coalesce("component", "leader").alias("led"), "leader")
    member = checkpointed(member.join(leading, "band").withColumn("stray", F.col("component") != F.col("led")))
    seen = rays.withColumnsRenamed({"a": "leader", "b": "id"}).drop("link")  # not the leader itself: all have been held against it
    member = checkpointed(member.join(member.filter("stray").select("band").distinct(), "band", "left_semi").join(seen, ["leader", "id"]))
    bits = lambda of: sum((F.bit_count(of(i)) for i in range(4)), F.lit(0))
    lacked = bits(lambda i: F.col(f"s.m{i}").bitwiseOR(F.col(f"m.m{i}")))
    shared = lambda x, y: F.col(f"{x}.more") - bits(lambda i: F.col(f"{x}.p{i}").bitwiseAND(F.bitwise_not(f"{y}.p{i}")))
    most = F.col("s.held") - lacked + F.least(shared("s", "m"), shared("m", "s"))
    possible = 100 * most >= percent * (F.col("s.n") + F.col("m.n") - most)
    agree = 128 - F.bit_count(F.col("s.b0").bitwiseXOR(F.col("m.b0"))) - F.bit_count(F.col("s.b1").bitwiseXOR(F.col("m.b1")))
    rest = (
        member.filter("stray").alias("s").join(member.alias("m"), (F.col("s.band") == F.col("m.band")) & (F.col("s.component") != F.col("m.component")) & (~F.col("m.stray") | (F.col("s.id") < F.col("m.id"))) & possible & (agree >= AGREE))
        .select(F.col("s.id").alias("a"), F.col("m.id").alias("b")).distinct()
    )
    more = checkpointed(judged(docs, checkpointed(rest), shingle, percent).filter("link").select("a", "b"))
    found = first if more.isEmpty() else components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    placed = nodes.select("same", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("same", F.coalesce("component", "id").alias("component"))
    out = slim.select(F.col("doc_id").alias("key"), "n", "same").join(placed, "same", "left").withColumn("component", F.coalesce("component", "key"))
    if names is None:
        return out.select("key", F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("component") == F.col("key")).alias("kept"))
    many = names.count()
    out = out.join(small(names.select("key", F.coalesce("doc_id", F.lit(LAST_ID)).alias("real")), many), "key", "left").withColumn("real", F.coalesce("real", "key"))
    out = checkpointed(out.select("key", "n", "component", "real"))
    first = out.groupBy("component").agg(F.min(F.struct("real", "key")).alias("top"))
    out = out.join(first, "component")
    real = lambda c: F.nullif(F.col(c), F.lit(LAST_ID))
    return out.select("key", real("real").alias("doc_id"), F.col("n").alias("n_shingles"), real("top.real").alias("component_id"), (F.col("top.key") == F.col("key")).alias("kept"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)

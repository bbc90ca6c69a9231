"""What the operators of this subpackage share: reading documents, dealing them into groups, packing arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands in for a null doc_id wherever ids are compared: a null id is never the smaller one.
LAST_ID = 2**63 - 1

#: Bytes of a group of documents, of a partition of groups, and what a row counts besides its text.
GROUP_BYTES, PARTITION_BYTES, ROW_BYTES = 1 << 20, 16 << 20, 64

#: Byte table: A-Z to lower case, ASCII letters, digits and all bytes over 0x7F stay, the rest becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Byte table that only lower-cases A-Z.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text after lower-casing A-Z: maximal runs of a-z, 0-9 and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where its rows lie in fewer partitions than there are cores: a row group is one task, however long its texts take.

    Counting the partitions reads no column of a file. What fills the cores, as any large input does, stays as it lies.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    filled = docs.select(F.spark_partition_id()).distinct().count()
    return docs.repartition(cores) if filled < cores else docs


def dealt(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, int, int]:
    """(grp, doc_id, text as bytes), dealt into groups of about ``group_bytes``; the bytes of all texts; and the partitions that hold the groups.

    A group is the unit that a Python worker holds at once. The deal depends on id and text, so that rows without an id, or with the same one, do not
    meet in one group. It is one exchange by ``grp``, of as many partitions as the texts need, which serves every later step that reads the texts again.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows, held = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    held += ROW_BYTES * rows
    least = shuffle_parts(docs.sparkSession)
    partitions = max(least, -(-held // PARTITION_BYTES))
    groups = max(2 * least, -(-held // group_bytes))
    grp = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp")
    return slim.select(grp, "doc_id", "text").repartition(partitions, "grp"), held, partitions


def in_order(group: pa.Table) -> pa.Table:
    """A group's rows by doc_id, ties by text, so that every step sees them alike."""
    ids = id_array(group.column("doc_id"))
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        texts = group.column("text").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b"")))
    return group.take(pa.array(order))


def id_array(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LAST_ID).to_numpy().astype(np.int64)


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column end to end, and the n + 1 offsets of its values. Null counts as empty."""
    arr = column.cast(pa.large_binary()).fill_null(b"")
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.large_binary())
    if not len(arr):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string; ``unpack`` needs their dtypes."""
    body = np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes, *dtypes: type) -> list[np.ndarray]:
    body = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(body, np.int64, len(dtypes)), 8 * len(dtypes), []
    for n, kind in zip(sizes, dtypes, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as little-endian integers (len - 7 of them)."""
    if len(data) < 8:
        return np.empty(0, np.uint64)
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,)).copy()

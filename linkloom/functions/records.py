"""Ids, maps and names of records."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a packed id, and what fills them up.
ID_BYTES, FILL = 16, "n"


def pack_id(uid: Column) -> Column:
    """An id of up to 16 one-byte characters as four unsigned 32-bit integers, low byte first. Null if it is longer."""
    whole = F.rpad(uid, ID_BYTES, FILL)
    four = lambda i: F.conv(F.hex(F.reverse(F.substring(whole, 4 * i + 1, 4))), 16, 10).cast("long")
    return F.when(F.octet_length(uid) <= ID_BYTES, F.array(*map(four, range(4))))


def unpack_id(numbers: Column) -> Column:
    """The id of ``pack_id`` without what fills it up; an id's own last ``n`` can't be told from that."""
    text = lambda x: F.reverse(F.decode(F.unhex(F.lpad(F.hex(x), 8, "0")), "UTF-8"))
    return F.regexp_replace(F.array_join(F.transform(numbers, text), ""), f"{FILL}+$", "")


def merge_maps(a: Column, b: Column, merge: Callable[[Column, Column], Column] = lambda x, y: x + y) -> Column:
    """All keys of both maps; where both have one, their values merged."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge(x, y)))


def field_of(features: Column, field: str) -> Column:
    """One field of each feature."""
    return F.transform(features, lambda f: f[field])


def all_same(column: str) -> Column:
    """Whether a group has one value; true for none."""
    return F.coalesce(F.min(column) == F.max(column), F.lit(True))


def prefixed(metrics: list[str], *prefixes: str) -> list[Column]:
    """Metrics under their names with the prefixes before them, the last one first."""
    return [F.col(m).alias("".join(f"{p}_" for p in reversed(prefixes)) + m) for m in metrics]

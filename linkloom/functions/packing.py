"""Token id columns as encoders take them: ids, mask and segments of one length."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity_window(toks: Column, size: int, open_mark: str = "[START_ENT]", close_mark: str = "[END_ENT]") -> Column:
    """The first tokens of an entity's text between its marks, ``size`` in all at most."""
    return F.concat(F.array(F.lit(open_mark)), F.slice(toks, 1, size - 2), F.array(F.lit(close_mark)))


def padded(values: Column, size: int, pad: int = 0) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.lit(size) - F.size(values)))


def packed(ids: Column, segments: Column, size: int) -> Column:
    mask = F.array_repeat(F.lit(1), F.size(ids))
    return F.when(F.size(ids) <= size, F.struct(padded(ids, size).alias("ids"), padded(mask, size).alias("mask"), padded(segments, size).alias("segments")))


def bi_encoder_pack(ids: Column, is_entity: Column, size: int, cls: int = 101, sep: int = 102) -> Column:
    """[CLS] ids [SEP], padded to ``size``; the segment tells entities. Null if it does not fit."""
    whole = F.concat(F.array(F.lit(cls)), ids, F.array(F.lit(sep)))
    return packed(whole, F.array_repeat(is_entity.cast("int"), F.size(whole)), size)


def cross_encoder_pack(a: Column, b: Column, a_entity: Column, b_entity: Column, size: int, cls: int = 101, sep: int = 102) -> Column:
    """[CLS] a [SEP] b [SEP], padded to ``size``; each side's segment tells whether it is an entity. Null if it does not fit."""
    left, right = F.concat(F.array(F.lit(cls)), a, F.array(F.lit(sep))), F.concat(b, F.array(F.lit(sep)))
    segments = F.concat(F.array_repeat(a_entity.cast("int"), F.size(left)), F.array_repeat(b_entity.cast("int"), F.size(right)))
    return packed(F.concat(left, right), segments, size)


def concat_packed(a: Column, b: Column, size: int) -> Column:
    """Two packed sequences as one of length ``size``: their real tokens, without the second's [CLS]. Null if they do not fit."""
    real = lambda p, f: F.slice(p[f], 1, F.aggregate(p["mask"], F.lit(0), lambda s, x: s + x))
    rest = lambda f: F.slice(real(b, f), 2, F.greatest(F.size(real(b, f)) - 1, F.lit(0)))
    return packed(F.concat(real(a, "ids"), rest("ids")), F.concat(real(a, "segments"), rest("segments")), size)


def between_marks(toks: Column, open_mark: Column, close_mark: Column) -> Column:
    """The tokens strictly between the first open mark and the first close mark; none if either is missing or they are in the wrong order."""
    at, to = F.array_position(toks, open_mark).cast("int"), F.array_position(toks, close_mark).cast("int")
    return F.when((at > 0) & (to > at), F.slice(toks, at + 1, F.greatest(to - at - 1, F.lit(0)))).otherwise(F.slice(toks, 1, 0))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; null if there are none."""
    kept = F.filter(vectors, lambda v, i: F.get(mask, i) == 1)
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))

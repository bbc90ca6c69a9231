"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (1 to 3 letters, words padded by a space) in order. A text's distance to a language is the sum,
over its own profile, of how far out of place each n-gram stands in the language's profile; one that is missing there counts as the profile's whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.window import Window

from linkloom.llm._docs import spread, table
from linkloom.llm._spark import bounded_batches, checkpointed, released

#: N-grams in a profile.
PROFILE = 400
#: About so many labelled documents of each language are learned from: the bound of the sample.
SAMPLE = 1500
UNKNOWN = "und"
#: Letters whose n-grams are counted at once.
PIECE = 1 << 18
_BITS = np.uint64(21)


_known = np.zeros(0x110000, np.uint32)


def letters(text: str) -> np.ndarray:
    """Code points in lower case, a single 0 for each run of what is no letter, at both ends too."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if not _known[97]:
        _known[:] = [c if chr(c).isalpha() else 0 for c in range(0x110000)]
    x = _known[x]
    return x[(x > 0) | np.r_[True, x[:-1] > 0]]


def profile(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a text as integers, and how often each occurs; long texts are counted in pieces."""
    found = [counted(x[lo : lo + PIECE + 2], PIECE) for lo in range(0, max(1, len(x)), PIECE)]
    return found[0] if len(found) == 1 else added(found)


def counted(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that start in the first ``size`` letters, and their counts."""
    x = x.astype(np.uint64)
    pairs = (x[:-1] << _BITS) | x[1:]
    triples = (pairs[:-1] << _BITS) | x[2:]
    triples = triples[:size][x[1:-1][:size] > 0]  # none spans two words
    single = x[:size]
    grams = np.concatenate((single[single > 0], pairs[:size] | np.uint64(1) << np.uint64(63), triples))
    if not len(grams):
        return grams, np.empty(0, np.int64)
    grams.sort()
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.diff(np.r_[first, len(grams)])


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by their code."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles by language, from whole texts of about ``sample`` documents of each, chosen by a hash of the id.

    Rows with a null lang or a text without letters teach nothing. Without any labelled row the result is empty.
    """
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, sample / n))])
    chosen = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(6), F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 20)) < share[F.col("lang")] * F.lit(1 << 20)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, []).append(profile(letters(text)))
                if len(found[lang]) >= 64:
                    found[lang] = [added(found[lang])]
        for lang, parts in found.items():
            grams, n = added(parts)
            yield pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    bounded_batches(docs.sparkSession)
    total = checkpointed(chosen.mapInArrow(released(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[int]] = {}
    for r in total.withColumn("place", place).filter(F.col("place") <= size).orderBy("lang", "place").collect():  # size rows a language
        top.setdefault(r["lang"], []).append(r["gram"])
    return top


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    if not len(grams):
        return grams, n
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.add.reduceat(n, first)


def identify(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: how much nearer the best language is than a text with nothing in common).

    ``und`` with score 0 for a null or empty text, one without a letter (other numerals than digits are none either), and for all texts if there are no profiles. Ties go to the first language by code point.
    Only the text decides. All columns stay; of the same names, these two replace what was there.
    """
    langs = sorted(profiles)
    grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64).view(np.uint64))
    places = np.full((len(langs), len(grams) + 1), size, np.int64)
    for i, lang in enumerate(langs):
        places[i, np.searchsorted(grams, np.array(profiles[lang], np.int64).view(np.uint64))] = np.arange(len(profiles[lang]))

    def judge(text: str | None) -> tuple[str, float]:
        mine = ranked(*profile(letters(text)), size) if langs and text else ()
        if not len(mine):
            return UNKNOWN, 0.0
        at = np.searchsorted(grams, mine)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != mine)] = len(grams)
        there = places[:, at]
        off = np.where(there == size, size, np.abs(there - np.arange(len(mine)))).sum(1)
        best = int(np.argmin(off))
        return langs[best], float(1 - off[best] / (size * len(mine)))

    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    once = dict(docs.dtypes)["text"] == "string" and "text" in names  # the text need not go to Python twice
    kept = docs.select(*[F.col(f"`{c}`") for c in names], *([] if once else [F.col("text").cast("string").alias("__text")]))
    place = names.index("text") if once else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(place)]
            yield pa.record_batch([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([docs.schema[c] for c in names]).add("lang_pred", StringType()).add("score", DoubleType())
    bounded_batches(docs.sparkSession)
    return kept.mapInArrow(released(run), schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    profiles = learn(docs.filter(~held_out()))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return identify(slim, profiles).select("doc_id", "held_out", "lang_pred", "score")

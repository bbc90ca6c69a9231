"""Licence scan with a generalised suffix automaton.

All phrases and notices, as words, go into one automaton, each after the other from its root. A text's words stream through it: after each word,
state and length tell the longest run of words, up to here, that occurs in any template (matching statistics). Where a run of at least ``LONG`` words
can't be extended it is a long match. Long matches of one template that follow each other, there and in the text, are chained to a span; what share of the
template the chain covers decides on the label. Phrases are found on the way: a phrase ends wherever the current run has it as a suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._docs import table, words_of
from linkloom.llm._spark import bounded_batches, released
from linkloom.llm.licences import NOTICES, PHRASES

#: Words of a long match; words of text that a chain may skip; share of a notice that earns its label.
LONG, SKIP, SHARE = 4, 12, 0.6


class Automaton:
    """Generalised suffix automaton over word numbers. ``ends`` lists where a state's words end: (template, end)."""

    def __init__(self, phrases: list[list[bytes]], notices: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.templates = phrases + notices
        whole: list[int] = []
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(self.templates):
            state = 0
            for i, w in enumerate(words):
                state = self.extend(state, self.numbers.setdefault(w, len(self.numbers) + 1))
                ends += [[] for _ in range(len(self.size) - len(ends))]
                ends[state].append((t, i + 1))
            whole.append(state)
        self.phrase: list[tuple[int, ...]] = [()] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=lambda v: -self.size[v]):  # a state's words end wherever those of a longer one do
            if self.link[v] > 0:
                ends[self.link[v]] += ends[v]
        for v in sorted(range(1, len(self.size)), key=lambda v: self.size[v]):
            self.phrase[v] = tuple(p for p in range(len(phrases)) if whole[p] == v) + self.phrase[self.link[v]]
        self.ends = [sorted(set(x)) for x in ends]

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.size[q] == self.size[last] + 1 else self.clone(last, c, q)
        v = self.add(self.size[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = v
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[v] = q if self.size[q] == self.size[p] + 1 else self.clone(p, c, q)
        return v

    def clone(self, p: int, c: int, q: int) -> int:
        v = self.add(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = v
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = v
            p = self.link[p]
        return v

    def add(self, size: int, then: dict[int, int], link: int) -> int:
        self.size.append(size)
        self.next.append(then)
        self.link.append(link)
        return len(self.size) - 1


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, share: float = SHARE):
        self.share = share
        split = lambda text: words_of(text.encode())
        self.labels = [*phrases.values(), *notices]
        self.phrases = len(phrases)
        self.automaton = Automaton([split(p) for p in phrases], [split(n) for n in notices.values()])
        self.sizes = [len(t) for t in self.automaton.templates]
        self.least = min([LONG, *self.sizes[: self.phrases]])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]]]:
        """Places of phrases (phrase, first word), and spans (label, first word, last word, share of the notice)."""
        a = self.automaton
        get = a.numbers.get
        ids = np.array([get(w, 0) for w in words], np.int32)
        known = np.flatnonzero(np.diff(np.r_[0, ids != 0, 0]))
        places, long = [], []
        for lo, hi in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):  # any other word takes the automaton to its root
            if hi - lo < self.least:
                continue
            state = size = 0
            for at, c in enumerate(ids[lo:hi].tolist(), lo):
                before = state, size
                while state and c not in a.next[state]:
                    state = a.link[state]
                    size = a.size[state]
                state = a.next[state].get(c, 0)
                size = size + 1 if state else 0
                if size <= before[1] >= LONG:
                    long.append((at, *before))
                for p in a.phrase[state]:
                    if self.sizes[p] <= size:
                        places.append((p, at + 1 - self.sizes[p]))
            if size >= LONG:
                long.append((hi, state, size))
        return places, self.chains(long)

    def chains(self, long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for end, state, size in long:
            for t, there in self.automaton.ends[state]:
                if t >= self.phrases:
                    pieces.setdefault(t, []).append((end - size, there - size, size))
        out = []
        for t, own in pieces.items():
            open_: list[list[int]] = []  # chains: first word, end in the text, end in the notice, words covered
            done = []
            for start, there, size in sorted(own):
                still = []
                for c in open_:
                    (still if start - c[1] <= SKIP else done).append(c)
                open_ = still
                fit = [c for c in open_ if there + size > c[2] and start + size > c[1]]
                if fit:
                    c = max(fit, key=lambda c: c[3])
                    c[3] += min(size, there + size - c[2], start + size - c[1])
                    c[1], c[2] = start + size, there + size
                else:
                    open_.append([start, start + size, there + size, size])
            taken: list[list[int]] = []
            for c in sorted(done + open_, key=lambda c: (-c[3], c[0])):  # the best chain, and the others that are whole enough, unless they overlap a better one
                if (not taken or c[3] >= self.share * self.sizes[t]) and all(c[1] <= x[0] or x[1] <= c[0] for x in taken):
                    taken.append(c)
            out += [(self.labels[t], c[0], c[1] - 1, c[3] / self.sizes[t]) for c in taken]
        return sorted(out)


SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", SPANS)])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, first_word: long, last_word: long, share: double>>"


def scan_licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, share: float = SHARE) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts the places of phrases; first_word and last_word are their smallest and largest start. spans are the best chain of each notice and
    all others with at least ``share`` of it, as often as it stands in the text; one with that share adds its label. score is 1 with a phrase, else the best share (0 to 1).
    A null text is empty and has no words. Repeated rows are scanned each. Other columns are not read; an empty table gives no rows.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, share)
        for batch in batches:
            out = []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                places, spans = scanner.scan(words)
                base = {scanner.labels[p] for p, _ in places}
                more = {label for label, _, _, s in spans if s >= share}
                starts = [at for _, at in places]
                out.append((
                    d, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)),
                    1.0 if base else min(1.0, max((s for *_, s in spans), default=0.0)), [dict(zip(("label", "first_word", "last_word", "share"), s, strict=True)) for s in spans],
                ))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(RESULT), RESULT.types, strict=True)], schema=RESULT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(released(run), DDL)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))

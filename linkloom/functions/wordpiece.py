"""Subword ids by a vocabulary that is given."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pieces_of(word: str, vocabulary: dict[str, int], unknown: int, longest: int = 100) -> list[int]:
    """The longest piece of the vocabulary at each place, those inside a word with ## before them; the unknown id if there is none somewhere, or the word is too long."""
    if len(word) > longest:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            if (found := vocabulary.get(("##" if at else "") + word[at:end])) is not None:
                out.append(found)
                at = end
                break
        else:
            return [unknown]
    return out


def read_vocabulary(path: str) -> dict[str, int]:
    """A file with a piece a line."""
    with open(path, encoding="utf-8") as lines:
        return {line.rstrip("\n"): i for i, line in enumerate(lines)}


def wordpiece_ids(toks: Column, vocabulary: dict[str, int], unknown: str = "[UNK]") -> Column:
    """Ids of all pieces of an array of words, in Arrow batches. Null stays null."""
    other = vocabulary[unknown]

    @F.pandas_udf("array<int>")
    def split(words: pd.Series) -> pd.Series:
        return words.map(lambda row: None if row is None else [x for w in row for x in pieces_of(w, vocabulary, other)])

    return split(toks)

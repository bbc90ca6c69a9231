"""Token columns: whitespace tokens, spans, and windows around a mention."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def span(toks: Column, start: Column, end: Column) -> Column:
    """Tokens start..end (both included, from 0) joined by spaces."""
    return F.concat_ws(" ", F.slice(toks, start + 1, end - start + 1))


def context_window(toks: Column, start: Column, end: Column, size: int, open_mark: str = "[START]", close_mark: str = "[END]") -> Column:
    """At most ``size`` tokens around a marked mention; what one side does not use of its half goes to the other."""
    before, after = start, F.size(toks) - end - 1
    rest = F.greatest(F.lit(size) - (end - start + 1) - 2, F.lit(0))
    half = F.ceil(rest / 2).cast("int")
    left = F.least(before, F.greatest(half, rest - after))
    right = F.least(after, rest - left)
    whole = F.concat(
        F.slice(toks, start - left + 1, left), F.array(F.lit(open_mark)), F.slice(toks, start + 1, end - start + 1), F.array(F.lit(close_mark)), F.slice(toks, end + 2, right)
    )
    return F.slice(whole, 1, size)

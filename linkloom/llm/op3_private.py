"""Information-theoretic sanitisation, in DataFrame functions alone.

Emails, IP addresses, card and phone numbers are the protected entities: patterns find them, and their checks drop what fails. So are secrets, that is,
values assigned to a token, key or password; they are spans that the method adds. Then the corpus tells which
words beside an entity give it away. With N distinct texts, of which c_e hold the entity, c_t the term and c both, anywhere in them, the term reveals
PMI = log(c * N / (c_e * c_t)) of the entity's information IC = log(N / c_e). A term that stands with it in at least ``support`` distinct texts and
reveals at least ``share`` of it is disclosing: it becomes a span of kind ``term`` wherever it stands, in any text. Equal texts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm._docs import spread, table
from linkloom.llm._spark import checkpointed, forget, small

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that a failed attempt is not repeated from within the same run of characters and no group recurses.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",  # shorter ones fail the check on digits anyway
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A document without this has no match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: The value that is assigned to the name of a secret; it has to be long and to have a digit.
SECRET = "secret"
NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?"
PATTERNS[SECRET] = rf"(?i){NAMES}[\"']?\s{{0,4}}[:=]\s{{0,4}}[\"']?([A-Za-z0-9+/_=-]{{16,}}+)"
NEEDS[SECRET] = None
#: Few texts without a secret have this, and it is found at once.
ASSIGNED = r"[:=]\s{0,4}[\"']?[A-Za-z0-9+/_=-]{16}"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: A term: a run of letters, marks and digits, of any length.
TERM = r"[\p{L}\p{M}\p{N}]++"
SUPPORT, SHARE = 3, 0.9


def running(values: Column, op) -> Column:
    """For each of an array of integers, ``op`` over those before it, from 0. Blocks are folded first, so no step goes over all that lies before.

    Blocks of the cube root of twice the length make the steps fewest: half a block for each value, and half the blocks for each block.
    """
    fold = lambda xs: F.aggregate(xs, F.lit(0), op)
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is made once, not for each use
    block = lambda xs: F.greatest(F.lit(8), F.ceil(F.cbrt(2 * F.size(xs))).cast("int"))
    starts = lambda xs, n: F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / n).cast("int") - 1, F.lit(0)))
    blocks = once(values, lambda xs: once(block(xs), lambda n: F.transform(starts(xs, n), lambda b: F.slice(xs, b * n + 1, n))))
    within = lambda xs, base: F.transform(xs, lambda _, j: op(base, fold(F.slice(xs, F.lit(1), j))))
    both = once(blocks, lambda bs: F.struct(bs.alias("bs"), F.transform(bs, fold).alias("all")))
    return F.flatten(once(both, lambda w: F.transform(w["bs"], lambda xs, i: once(fold(F.slice(w["all"], F.lit(1), i)), lambda base: within(xs, base)))))


def added(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def pieces(text: Column, size: int = 1024) -> Column:
    """The text in pieces of ``size`` code points, from which ``cut`` takes parts without going through the text from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column, size: int = 1024) -> Column:
    first = F.floor(start / size).cast("int")
    inside = start - first * size
    return F.when(length <= 0, F.lit("")).otherwise(F.substr(F.array_join(F.slice(parts, first + 1, F.ceil((inside + length) / size).cast("int")), ""), inside + 1, length))


def steps(text: Column, pattern: str) -> Column:
    """array<struct<gap, size, value>> of a pattern's matches, leftmost and non-overlapping, with the code points between each and the one before."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("value")))


def located(*each: Column) -> Column:
    """An array<struct<start, end, value>> for each of some ``steps``, in code points. Places are a running sum of what lies before; its plan is made once for all."""

    def placed(all_: Column) -> Column:
        before = running(F.transform(all_, lambda x: x["gap"] + x["size"]), added)
        spot = lambda x, b: F.struct((b + x["gap"]).alias("start"), (b + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"))
        return F.zip_with(all_, F.slice(before, 1, F.size(all_)), spot)

    # The steps stand in an array, so that they are made once and not for each match.
    return F.transform(F.array(*each), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == SECRET:
        return value.rlike("[0-9]")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def entities(text: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """array<struct<kind, start, end, value>>: the spans of the kinds in a text, by kind as listed, then start."""
    def of(kind: str) -> Column:
        first = text.rlike(ASSIGNED if kind == SECRET else PATTERNS[kind].replace(r"\G|", ""))
        if NEEDS[kind]:
            first = text.contains(NEEDS[kind]) & first
        return F.when(first, steps(text, PATTERNS[kind])).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string>>"))

    def checked(kind: str, spans: Column) -> Column:
        if kind == SECRET:  # the value alone, at the end of what matched
            value = lambda s: F.regexp_extract(s["value"], PATTERNS[SECRET], 1)
            spans = F.transform(spans, lambda s: F.struct((s["end"] - F.length(value(s))).alias("start"), s["end"].alias("end"), value(s).alias("value")))
        spans = F.filter(spans, lambda s: valid(kind, s["value"]))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    every = lambda w: F.concat(*(checked(kind, F.get(w, F.lit(i))) for i, kind in enumerate(kinds)))
    return F.flatten(F.transform(F.array(located(*map(of, kinds))), every))


def rewritten(text: Column, spans: Column, instead) -> Column:
    """The text with ``instead(span, at)`` for each span by its start; at is where the spans before it end. What any span covers is gone."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def built(w: Column) -> Column:
        def step(s: Column, at: Column) -> Column:
            return F.concat(cut(w["parts"], at, s["start"] - at), instead(s, at))

        at = running(F.transform(w["order"], lambda s: s["end"]), larger)
        last = F.array_max(F.transform(w["order"], lambda s: s["end"]))
        return F.concat(F.array_join(F.zip_with(w["order"], F.slice(at, 1, F.size(w["order"])), step), ""), cut(w["parts"], last, F.greatest(F.length(text) - last, F.lit(0))))

    whole = F.get(F.transform(F.array(F.struct(order.alias("order"), pieces(text).alias("parts"))), built), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def cleared(text: Column, spans: Column) -> Column:
    """The text with a space for each code point of a span, so that places stay. Spans of different kinds may overlap."""
    return rewritten(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], at), F.lit(0))))


def words(text: Column) -> Column:
    """The distinct terms of a text in lower case, with spaces between them."""
    low = F.lower(F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), " "))
    return F.array_join(F.array_distinct(F.split(low, " ")), " ")


def occurrences(text: Column, terms: Column) -> Column:
    """array<struct<kind, start, end>> of all places of the terms in a text, in one pass over its words."""
    here = lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.transform(F.filter(F.get(located(steps(text, TERM)), F.lit(0)), lambda s: F.array_contains(terms, F.lower(s["value"]))), here)


def disclosing(texts: DataFrame, support: int, share: float) -> DataFrame | None:
    """(term) of the terms that reveal too much of an entity, or None if no entity has the support. ``texts`` has a row a distinct text: same, entities, words."""
    holds = texts.filter(F.size("entities") > 0).select("same", F.explode("entities").alias("entity"))
    n = texts.count()
    kept = checkpointed(holds.groupBy("entity").agg(F.count(F.lit(1)).alias("c_e")).filter((F.col("c_e") >= support) & (F.col("c_e") < n)))
    total, most = kept.agg(F.count(F.lit(1)), F.max("c_e")).first()
    if not total:
        return None
    # c is at most c_e, so a term with a larger c_t than this can't disclose. No pair that counts is lost by it.
    bound = lambda c_e: n * F.pow(c_e / n, F.lit(share)) * (1 + 1e-9)
    each = texts.filter("words <> ''").select(F.explode(F.split("words", " ")).alias("term"))
    # Both are counted on the map side before anything is shuffled, and no text is.
    seen = each.groupBy("term").agg(F.count(F.lit(1)).alias("c_t")).filter((F.col("c_t") >= support) & (F.col("c_t") <= bound(F.lit(most))))
    there = texts.filter((F.size("entities") > 0) & (F.col("words") != "")).select("words", F.explode("entities").alias("entity")).join(small(kept, total), "entity")
    pairs = there.select("entity", "c_e", F.explode(F.split("words", " ")).alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c"), F.first("c_e").alias("c_e")).filter(F.col("c") >= support)
    found = pairs.join(seen, "term").filter(F.col("c_t") <= bound(F.col("c_e")))
    return found.filter(F.log(F.col("c") * n / (F.col("c_e") * F.col("c_t"))) >= share * F.log(F.lit(n) / F.col("c_e"))).select("term").distinct()


def private_spans(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """One row a document: doc_id, same (hash of the text), base: array<struct<kind, start, end>>, spans by kind then start, and spans: those, then secrets and all places of disclosing terms, each by start.

    A null or empty text has no spans. Repeated rows get the same spans each. Spans of different kinds may overlap, but no term lies in a base span. Other columns are not read; an empty table gives no rows.
    """
    docs = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), "text", entities(F.col("text"), (*KINDS, SECRET)).alias("found"))
    named = F.array_distinct(F.transform("found", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    texts = checkpointed(docs.select("same", named.alias("entities"), words(cleared(F.col("text"), F.col("found"))).alias("words")).dropDuplicates(["same"]))
    forget(docs.sparkSession)
    told = disclosing(texts, support, share)
    all_ = F.transform("found", lambda s: s.dropFields("value"))
    base = F.filter(all_, lambda s: s["kind"] != SECRET)
    if told is None:
        return docs.select("doc_id", "same", base.alias("base"), all_.alias("spans"))
    told = checkpointed(told)
    where = checkpointed(texts.filter("words <> ''").select("same", F.explode(F.split("words", " ")).alias("term")).join(small(told, told.count()), "term"))
    marks = where.groupBy("same").agg(F.collect_list("term").alias("terms"))
    out = docs.join(small(marks, where.count()), "same", "left")
    more = F.when(F.col("terms").isNotNull(), occurrences(cleared(F.col("text"), F.col("found")), F.col("terms")))
    return out.select("doc_id", "same", base.alias("base"), F.concat(all_, F.coalesce(more, F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets: the value is removed, its kind is what is left of it. Of spans that overlap, the first one's kind stays, and what any covers goes."""
    return rewritten(text, spans, lambda s, at: F.when(s["start"] >= at, F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(""))


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))

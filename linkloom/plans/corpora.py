"""Queries over a whole corpus, as its files would have it: ``documents`` gives the texts, a tenth of them entities, and each other one a mention.

Some mentions name a wrong text, an unknown entity, or have no candidates, as real ones do.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.packing import between_marks, bi_encoder_pack, concat_packed, cross_encoder_pack, masked_mean
from linkloom.functions.text import span, tokens
from linkloom.functions.wordpiece import wordpiece_ids
from linkloom.operators.lineage import cut, shared_folder
from linkloom.sources.corpus import Corpus, Indexed, candidate_features, entity_texts, gold_clusters, index_corpus, mention_contexts
from linkloom.sources.store import look_up, write_examples

SIZE = 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def corpus(spark: SparkSession, d: str) -> Corpus:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")
    documents = docs.select(F.col("doc_id").cast("string").alias("document_id"), "text")
    toks = docs.select("doc_id", "source", tokens(F.col("text")).alias("toks")).filter("doc_id % 10 <> 0 and size(toks) >= 8")
    start = (F.col("doc_id") * 7 % (F.size("toks") - 2)).cast("int")
    end = start + (F.col("doc_id") % 3).cast("int")
    found = span(F.col("toks"), start, end)
    mentions = toks.select(
        F.concat(F.lit("m"), "doc_id").alias("mention_id"), F.col("doc_id").cast("string").alias("context_document_id"),
        F.when(F.col("doc_id") % 13 == 0, "none").otherwise((F.col("doc_id") % 15 * 10).cast("string")).alias("label_document_id"), start.alias("start_index"), end.alias("end_index"),
        F.when(F.col("doc_id") % 17 == 5, F.concat(F.lit("x"), found)).otherwise(found).alias("text"), F.concat(F.lit("c"), F.col("doc_id") % 4).alias("category"), F.col("source").alias("corpus"),
    )
    some = F.transform(F.array(*[F.lit(7 * j) for j in range(4)]), lambda j: ((F.col("doc_id") * 3 + j) % 15 * 10).cast("string"))
    candidates = toks.filter("doc_id % 11 <> 3").select(F.concat(F.lit("m"), "doc_id").alias("mention_id"), F.concat(F.slice(some, 1, 1), F.array(F.lit("unknown")), F.slice(some, 2, 3)).alias("tfidf_candidates"))
    return Corpus(mentions, documents, documents.filter("cast(document_id as long) % 10 = 0"), candidates)


_indexed: dict[tuple[str, str], Indexed] = {}


def indexed(spark: SparkSession, d: str) -> Indexed:
    """The corpus by its index, once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _indexed:
        found = index_corpus(corpus(spark, d), SIZE)
        _indexed[key] = Indexed(*(cut(getattr(found, name)) for name in ("nodes", "examples", "gold", "candidates", "broken")))
    return _indexed[key]


#: The same corpus in SQL.
CTES = r"""
tok AS MATERIALIZED (SELECT doc_id, source, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS toks FROM documents),
ment AS MATERIALIZED (
  SELECT *, 'm' || doc_id AS uid, CASE WHEN doc_id % 17 = 5 THEN 'x' || found ELSE found END AS named, CASE WHEN doc_id % 13 = 0 THEN 'none' ELSE CAST(doc_id % 15 * 10 AS VARCHAR) END AS label
  FROM (SELECT *, array_to_string(toks[s + 1:e + 1], ' ') AS found FROM (SELECT *, CAST(doc_id * 7 % (len(toks) - 2) AS INTEGER) AS s, CAST(doc_id * 7 % (len(toks) - 2) + doc_id % 3 AS INTEGER) AS e FROM tok WHERE doc_id % 10 <> 0 AND len(toks) >= 8) x) y),
sized AS (SELECT *, len(toks) AS n, greatest(16 - (e - s + 1) - 2, 0) AS rest FROM ment),
lefts AS (SELECT *, least(s, greatest(CAST(ceil(rest / 2.0) AS INTEGER), rest - (n - e - 1))) AS l FROM sized),
ctx AS MATERIALIZED (SELECT *, (list_concat(list_concat(list_concat(toks[s - l + 1:s], ['[START]']), list_concat(toks[s + 1:e + 1], ['[END]'])), toks[e + 2:e + 1 + least(n - e - 1, rest - l)]))[1:16] AS context FROM lefts),
enty AS MATERIALIZED (SELECT CAST(doc_id AS VARCHAR) AS uid, list_concat(list_concat(['[START_ENT]'], toks[1:14]), ['[END_ENT]']) AS context FROM tok WHERE doc_id % 10 = 0),
idx AS MATERIALIZED (
  SELECT uid, kind, row_number() OVER (PARTITION BY kind ORDER BY uid) - 1 + CASE WHEN kind = 'mention' THEN (SELECT count(*) FROM enty) ELSE 0 END AS idx
  FROM (SELECT uid, 'entity' AS kind FROM enty UNION ALL SELECT uid, 'mention' FROM ment) x),
linked AS (SELECT m.idx AS midx, e.idx AS eidx, CAST(x.doc_id AS VARCHAR) AS doc FROM ment x JOIN idx m ON m.uid = x.uid LEFT JOIN idx e ON e.uid = x.label AND e.kind = 'entity'),
listed AS (
  SELECT m.idx AS midx, CAST(row_number() OVER (PARTITION BY m.idx ORDER BY j) - 1 AS INTEGER) AS place, e.idx AS eidx
  FROM (SELECT uid, doc_id, unnest(range(4)) AS j FROM ment WHERE doc_id % 11 <> 3) x JOIN idx m ON m.uid = x.uid JOIN idx e ON e.uid = CAST((doc_id * 3 + 7 * j) % 15 * 10 AS VARCHAR) AND e.kind = 'entity'),
example AS (SELECT i.idx, i.kind, c.context FROM ctx c JOIN idx i ON i.uid = c.uid WHERE c.named = c.found UNION ALL SELECT i.idx, i.kind, y.context FROM enty y JOIN idx i ON i.uid = y.uid AND i.kind = 'entity')
"""


def query(body: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = f"WITH {CTES} {body}"
        return f

    return add


def words(c: str) -> Column:
    return F.concat_ws(" ", c)


@query("SELECT uid AS mention_id, CAST(doc_id AS VARCHAR) AS context_document_id, CAST(n AS INTEGER) AS n_tokens, found, named = found AS intact, CASE WHEN named = found THEN array_to_string(context, ' ') END AS context FROM ctx")
def j1_mention_contexts(spark, d):
    c = corpus(spark, d)
    rows = mention_contexts(c.mentions, c.documents, SIZE)
    return rows.select("mention_id", "context_document_id", "n_tokens", "found", "intact", F.when(F.col("intact"), words("context")).alias("context"))


@query("SELECT uid AS document_id, array_to_string(context, ' ') AS context FROM enty")
def j2_entity_texts(spark, d):
    c = corpus(spark, d)
    return entity_texts(c.entities, c.documents, SIZE).select("document_id", words("context").alias("context"))


@query("SELECT uid AS mention_id FROM ment WHERE named <> found")
def f3_broken_spans(spark, d):
    return indexed(spark, d).broken


@query("SELECT idx, uid, kind FROM idx")
def p1_corpus_index(spark, d):
    return indexed(spark, d).nodes


@query("SELECT midx, eidx, doc FROM linked")
def j3_corpus_gold(spark, d):
    return indexed(spark, d).gold


@query("SELECT midx, place, eidx FROM listed")
def j4_corpus_candidates(spark, d):
    return indexed(spark, d).candidates


@query("SELECT DISTINCT 'within_doc' AS domain, doc || ':' || eidx AS cluster, eidx, member FROM (SELECT doc, eidx, midx AS member FROM linked UNION ALL SELECT doc, eidx, eidx FROM linked) x WHERE eidx IS NOT NULL "
       "UNION ALL SELECT DISTINCT 'cross_doc', CAST(eidx AS VARCHAR), eidx, member FROM (SELECT eidx, midx AS member FROM linked UNION ALL SELECT eidx, eidx FROM linked) x WHERE eidx IS NOT NULL")  # fmt: skip
def b7_gold_clusters(spark, d):
    gold = indexed(spark, d).gold
    both = [gold_clusters(gold, x).select(F.lit(x).alias("domain"), "cluster", "eidx", "member") for x in ("within_doc", "cross_doc")]
    return both[0].unionByName(both[1])


@query("SELECT idx, kind, CAST(len(context) AS INTEGER) AS n, array_to_string(context, ' ') AS context FROM example")
def b15_all_examples(spark, d):
    """What candidate generation embeds: every mention and every entity."""
    return indexed(spark, d).examples.select("idx", "kind", F.size("context").alias("n"), words("context").alias("context"))


@query("SELECT idx AS eidx FROM idx WHERE kind = 'entity' AND idx NOT IN (SELECT eidx FROM linked WHERE eidx IS NOT NULL)")
def b14_entities_of_no_mention(spark, d):
    found = indexed(spark, d)
    return candidate_features(found.examples, found.gold)[1]


@query("SELECT midx, eidx FROM linked WHERE eidx IS NOT NULL")
def b14_positive_pairs(spark, d):
    found = indexed(spark, d)
    return candidate_features(found.examples, found.gold)[0]


@query("SELECT l.eidx AS cluster, l.midx, c.eidx FROM linked l JOIN (SELECT midx, eidx FROM listed UNION SELECT midx, eidx FROM linked WHERE eidx IS NOT NULL) c ON c.midx = l.midx WHERE l.eidx IS NOT NULL")
def b10_corpus_cluster_examples(spark, d):
    found = indexed(spark, d)
    gold = found.gold.filter("eidx is not null")
    both = found.candidates.select("midx", "eidx").unionByName(gold.select("midx", "eidx")).distinct()
    return gold.select(F.col("eidx").alias("cluster"), "midx").join(both, "midx").select("cluster", "midx", "eidx")


@query("SELECT idx, kind, array_to_string(context, ' ') AS context FROM example WHERE idx % 3 = 0")
def s6_feature_store(spark, d):
    """Examples written by index, of which some are looked up."""
    found, path = indexed(spark, d), f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    write_examples(found.examples, path)
    return look_up(spark, path, found.nodes.filter("idx % 3 = 0")).select("idx", "kind", words("context").alias("context"))


# Encoder inputs: a word's length stands for its id.


def ids(c: Column) -> Column:
    return F.transform(c, lambda w: F.length(w))


IDS = "list_transform({}, lambda w: CAST(len(w) AS INTEGER))"
JOINED = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), ',')"


def flat(p: Column, part: str) -> Column:
    return F.array_join(F.transform(p[part], lambda x: x.cast("string")), ",")


def padded(values: str, size: int, real: str) -> str:
    return f"list_concat({values}, list_transform(range({size} - len({real})), lambda x: CAST(0 AS INTEGER)))"


def packed_sql(rows: str, size: int, keep: str = "idx") -> str:
    """(ids, mask, segments) of rows with ids and segments, padded; those that do not fit have nulls."""
    one = lambda values: f"CASE WHEN len(ids) <= {size} THEN {JOINED.format(padded(values, size, 'ids'))} END"
    mask = one("list_transform(ids, lambda x: 1)")
    return f"SELECT {keep}, {one('ids')} AS ids, {mask} AS mask, {one('segments')} AS segments FROM ({rows}) p"


BI = f"SELECT idx, list_concat(list_concat([101], {IDS.format('context')}), [102]) AS ids, list_transform(list_concat(list_concat([101], {IDS.format('context')}), [102]), lambda x: CASE WHEN kind = 'entity' THEN 1 ELSE 0 END) AS segments FROM example"


@query(packed_sql(BI, 18))
def f7_bi_encoder_inputs(spark, d):
    p = bi_encoder_pack(ids(F.col("context")), F.col("kind") == "entity", 18)
    return indexed(spark, d).examples.select("idx", p.alias("p")).select("idx", *[flat(F.col("p"), x).alias(x) for x in ("ids", "mask", "segments")])


PAIR = "SELECT l.midx AS idx, a.context AS a, b.context AS b FROM listed l JOIN example a ON a.idx = l.midx JOIN example b ON b.idx = l.eidx WHERE l.place = 0"
CROSS = f"SELECT idx, list_concat(list_concat(list_concat([101], {IDS.format('a')}), [102]), list_concat({IDS.format('b')}, [102])) AS ids, list_concat(list_transform(range(len(a) + 2), lambda x: 0), list_transform(range(len(b) + 1), lambda x: 1)) AS segments FROM ({PAIR}) q"


def first_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = indexed(spark, d)
    of = lambda name, key: found.examples.select(F.col("idx").alias(key), F.col("context").alias(name))
    return found.candidates.filter("place = 0").join(of("a", "midx"), "midx").join(of("b", "eidx"), "eidx").select(F.col("midx").alias("idx"), "a", "b")


@query(packed_sql(CROSS, 34))
def f8_cross_encoder_inputs(spark, d):
    p = cross_encoder_pack(ids(F.col("a")), ids(F.col("b")), F.lit(False), F.lit(True), 34)
    return first_pairs(spark, d).select("idx", p.alias("p")).select("idx", *[flat(F.col("p"), x).alias(x) for x in ("ids", "mask", "segments")])


@query(packed_sql(CROSS, 40))
def f9_concatenated_inputs(spark, d):
    """Packed sequences of both sides put together."""
    one = lambda c, entity: bi_encoder_pack(ids(F.col(c)), F.lit(entity), 18)
    rows = first_pairs(spark, d).select("idx", one("a", False).alias("x"), one("b", True).alias("y"))
    return rows.select("idx", concat_packed(F.col("x"), F.col("y"), 40).alias("p")).select("idx", *[flat(F.col("p"), x).alias(x) for x in ("ids", "mask", "segments")])


@query("SELECT idx, array_to_string(context[list_position(context, '[START]') + 1:list_position(context, '[END]') - 1], ' ') AS marked FROM example WHERE kind = 'mention'")
def f16_highlighted_tokens(spark, d):
    return indexed(spark, d).examples.filter("kind = 'mention'").select("idx", F.concat_ws(" ", between_marks(F.col("context"), F.lit("[START]"), F.lit("[END]"))).alias("marked"))


@query("SELECT idx, round(list_avg(list_transform(list_filter(context, lambda w: len(w) > 2), lambda w: CAST(len(w) AS DOUBLE))), 6) AS mean FROM example")
def f15_masked_means(spark, d):
    """The mean of the tokens' vectors, here of one component, under a mask."""
    e = indexed(spark, d).examples
    vectors, mask = F.transform("context", lambda w: F.array(F.length(w).cast("double"))), F.transform("context", lambda w: (F.length(w) > 2).cast("int"))
    return e.select("idx", F.round(F.get(masked_mean(vectors, mask), F.lit(0)), 6).alias("mean"))


@functools.cache
def pieces() -> dict[str, int]:
    """A small vocabulary by rule: each letter, alone and inside a word, and pairs of them."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["[UNK]", *letters, *(f"##{x}" for x in letters), *(x + y for x in letters for y in "aeiou"), *(f"##{x}{y}" for x in "aeiou" for y in letters)]
    return {w: i for i, w in enumerate(words)}


@query()
def f6_wordpiece_ids(spark, d):
    e = indexed(spark, d).examples
    return e.select("idx", F.array_join(F.transform(wordpiece_ids(F.transform("context", lambda w: F.lower(w)), pieces()), lambda x: x.cast("string")), ",").alias("ids"))

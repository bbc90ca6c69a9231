"""A corpus from its files to indexed examples: documents with their mentions, spans that are checked, entities, candidates and clusters, all by one global index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.packing import entity_window
from linkloom.functions.text import context_window, span, tokens
from linkloom.operators.numbering import dense_index
from linkloom.sources.jsonl import read_candidates, read_documents, read_mentions


@dataclass
class Corpus:
    mentions: DataFrame
    documents: DataFrame
    entities: DataFrame
    candidates: DataFrame


def read_corpus(spark: SparkSession, root: str, split: str, domains: list[str]) -> Corpus:
    """The split's mentions and candidate lists, and the documents of ``domains``; those of every domain but the split's own are entities."""
    return Corpus(read_mentions(spark, root, split), read_documents(spark, root, domains), read_documents(spark, root, [d for d in domains if d != split]), read_candidates(spark, root, split))


def mention_contexts(mentions: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Each mention with its document: n_tokens, found (the tokens of its span), intact (whether they are the mention's text), and the marked context of ``size`` tokens.

    A mention without a document is left out. A span that is not intact has no context; both kinds can be told apart from the input by an anti join.
    """
    docs = documents.select(F.col("document_id").alias("context_document_id"), tokens(F.col("text")).alias("toks"))
    both = mentions.join(docs, "context_document_id").withColumn("found", span(F.col("toks"), F.col("start_index"), F.col("end_index")))
    both = both.withColumn("intact", F.coalesce(F.col("found") == F.col("text"), F.lit(False)))
    context = F.when(F.col("intact"), context_window(F.col("toks"), F.col("start_index"), F.col("end_index"), size))
    return both.withColumn("context", context).withColumn("n_tokens", F.size("toks")).drop("toks")


def entity_texts(entities: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """(document_id, context): the first tokens of each entity's document between its marks."""
    return entities.select("document_id").distinct().join(documents.select("document_id", "text"), "document_id").select("document_id", entity_window(tokens(F.col("text")), size).alias("context"))


def node_index(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(idx, uid, kind): entities from 0 in the order of their ids, then mentions in the order of theirs."""
    e = dense_index(entities.select(F.col("document_id").alias("uid")).distinct(), ["uid"], "idx")
    m = dense_index(mentions.select(F.col("mention_id").alias("uid")).distinct(), ["uid"], "idx", start=e.count())
    return e.select("idx", "uid", F.lit("entity").alias("kind")).unionByName(m.select("idx", "uid", F.lit("mention").alias("kind")))


def listed_candidates(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(midx, place, eidx): candidate lists (mention_id, tfidf_candidates) by index, in their order. Names that are no node are left out, and the others move up."""
    uid = lambda name, of: nodes.select(F.col("idx").alias(name), F.col("uid").alias(of))
    rows = candidates.select("mention_id", F.posexplode("tfidf_candidates").alias("at", "entity_id")).join(uid("eidx", "entity_id"), "entity_id").join(uid("midx", "mention_id"), "mention_id")
    kept = rows.groupBy("midx").agg(F.sort_array(F.collect_list(F.struct("at", "eidx"))).alias("l"))
    return kept.select("midx", F.posexplode(F.transform("l", lambda x: x["eidx"])).alias("place", "eidx"))


def gold_links(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(midx, eidx, doc): each mention's entity, null if no node has its name."""
    m = mentions.select(F.col("mention_id").alias("uid"), F.col("label_document_id").alias("label"), F.col("context_document_id").alias("doc")).join(nodes.select(F.col("idx").alias("midx"), "uid"), "uid")
    return m.join(nodes.filter("kind = 'entity'").select(F.col("idx").alias("eidx"), F.col("uid").alias("label")), "label", "left").select("midx", "eidx", "doc")


def gold_clusters(gold: DataFrame, domain: str = "within_doc") -> DataFrame:
    """(cluster, eidx, member): mentions and their entity, in clusters by document and entity (within_doc) or by entity (cross_doc). Mentions without an entity are in none."""
    if domain not in ("within_doc", "cross_doc"):
        raise ValueError(domain)
    known = gold.filter("eidx is not null")
    key = F.concat_ws(":", "doc", "eidx") if domain == "within_doc" else F.col("eidx").cast("string")
    return known.select(key.alias("cluster"), "eidx", F.col("midx").alias("member")).unionByName(known.select(key.alias("cluster"), "eidx", F.col("eidx").alias("member"))).distinct()


@dataclass
class Indexed:
    """What a corpus comes to: nodes (idx, uid, kind), examples (idx, kind, context), gold (midx, eidx, doc), candidates (midx, place, eidx), and mentions whose span failed its check."""

    nodes: DataFrame
    examples: DataFrame
    gold: DataFrame
    candidates: DataFrame
    broken: DataFrame


def index_corpus(corpus: Corpus, size: int) -> Indexed:
    """All of it by the global index. Duplicate ids have been settled by the readers; mentions without a document or with a broken span have no example, and are in ``broken``."""
    nodes = node_index(corpus.entities, corpus.mentions)
    spans = mention_contexts(corpus.mentions, corpus.documents, size)
    good = spans.filter("intact")
    texts = entity_texts(corpus.entities, corpus.documents, size)
    both = good.select(F.col("mention_id").alias("uid"), "context", F.lit("mention").alias("kind")).unionByName(texts.select(F.col("document_id").alias("uid"), "context", F.lit("entity").alias("kind")))
    examples = both.join(nodes.select("idx", "uid", "kind"), ["uid", "kind"]).select("idx", "kind", "context")
    broken = corpus.mentions.select("mention_id").distinct().join(good.select("mention_id"), "mention_id", "left_anti")
    return Indexed(nodes, examples, gold_links(corpus.mentions, nodes), listed_candidates(corpus.candidates, nodes), broken)


def candidate_features(examples: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For candidate generation: (midx, eidx) positive pairs, and (eidx) negatives, the entities that are no mention's gold."""
    pairs = gold.filter("eidx is not null").select("midx", "eidx")
    return pairs, examples.filter("kind = 'entity'").select(F.col("idx").alias("eidx")).join(pairs, "eidx", "left_anti")

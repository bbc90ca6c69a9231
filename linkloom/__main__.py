"""``python -m linkloom evaluate|examples``: a corpus of JSON lines and a table of vectors (uid, vec) to metrics, or to training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.lineage import cut
from linkloom.operators.scoring import inner_product
from linkloom.options import Options, parsed
from linkloom.plans.evaluation import Evaluation
from linkloom.plans.training import train_step
from linkloom.sources.corpus import index_corpus, read_corpus
from linkloom.sources.store import write_results


def run(spark: SparkSession, command: str, o: Options) -> DataFrame:
    """The metrics of an evaluation, whose results go to ``results`` if that is set, or the training examples."""
    corpus = read_corpus(spark, o.root, o.split, o.domains)
    found = index_corpus(corpus, o.context)
    uids = cut(found.nodes)
    nodes = uids.join(spark.read.parquet(o.embeddings).select("uid", "vec"), "uid").select("idx", (F.col("kind") == "entity").alias("is_entity"), F.col("vec").alias("feature"))
    spans = corpus.mentions.select(F.col("mention_id").alias("uid"), "start_index").join(uids, "uid").select(F.col("idx").alias("midx"), "start_index")
    mentions = cut(found.gold.filter("eidx is not null").join(spans, "midx").select("midx", "doc", F.col("eidx").alias("gold"), "start_index"))
    if command == "evaluate":
        out = Evaluation(mentions.select("midx", "doc", "gold"), nodes, found.candidates.select("midx", "eidx"), inner_product, available=o.available_entities, threshold=o.threshold, most=o.thresholds, prefix=o.split)
        if o.results:
            write_results(out.saved(), o.results)
        return out.metrics
    entities = nodes.filter("is_entity").agg(F.max("idx")).first()[0] + 1
    vectors = mentions.join(nodes.select(F.col("idx").alias("midx"), F.col("feature").alias("vec")), "midx")
    more = {"negatives": o.row_negatives} if o.example_kind == "softmax" else {}
    return train_step(vectors, nodes, found.candidates, inner_product, entities, o.k, o.quota, o.pair_method, o.example_kind, o.training_edges, o.mention_negatives, o.available_entities, o.seed, **more).examples


if __name__ == "__main__":
    run(SparkSession.builder.appName("linkloom").getOrCreate(), *parsed()).show(100, False)

"""Steps of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator's decisions to all of docs.

All but the last return the columns of ``documents``, and pass their rows' other fields on as they are (``language`` fills ``lang`` where it is null); columns of other
names are left out. An empty table gives an empty one. Each copes with null and empty texts as its operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm._docs import table
from linkloom.llm._spark import checkpointed, small
from linkloom.llm.op4_mixing import mix
from linkloom.llm.op5_minhash import grouped, keyed
from linkloom.llm.op6_language import UNKNOWN, identify, learn
from linkloom.llm.op7_decontaminate import remove_contaminated
from linkloom.llm.op8_sharding import slot_runs

#: Score of a text in a language. In sf0.1 and check_h no document has less than 0.39; 200 words of random letters have 0.23 at most, a text in other letters 0.
LEAST = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: texts without a letter, and those with a score under ``LEAST``, are rejected. Profiles come from the labelled documents of the input.

    A null ``lang`` becomes the predicted one; one that is given stays. Repeated rows are judged alike. Without any labelled document there are no profiles to reject by, and each text with a letter stays. A language that no labelled document has is rejected like other unknown text.
    """
    docs = columns(docs)
    profiles = learn(docs)
    if not profiles:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    kept = identify(docs, profiles).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST))
    return columns(kept.withColumn("lang", F.coalesce(F.col("lang").cast("string"), "lang_pred")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as op5's query links them: the one with the smallest doc_id. A row goes if its own text links to one that stays.

    Rows with a null doc_id are documents of their own. Of rows that share a doc_id and would stay, one does, so that no doc_id stands twice: the one with the smallest
    hash of id and text. Null and empty texts link with nothing and stay.
    """
    docs, clashes = keyed(columns(docs))
    seen = checkpointed(grouped(docs, clashes).filter("not kept").select("key").distinct())
    out = docs.join(small(seen, seen.count()), "key", "left_anti")
    if not clashes:
        return columns(out)
    copies = F.col("doc_id").isNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    repeated = F.col("doc_id").isNotNull() & (F.col("key") != F.col("doc_id"))
    rest = out.filter(~F.coalesce(copies | repeated, F.lit(False)))
    once = lambda df, by: df.groupBy(by).agg(F.min(F.struct("key", *COLUMNS)).alias("row")).select("row.*")
    return columns(rest.unionByName(once(out.filter(copies), "key")).unionByName(once(out.filter(repeated), "doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Null and empty texts stay, and repeated rows are judged alike; an empty benchmark rejects nothing."""
    return remove_contaminated(columns(docs), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it does not take goes. Needs distinct doc_ids, and distinct texts where they are null, as the stages before leave them."""
    docs = columns(docs)
    own = F.bitwise_not(F.shiftrightunsigned(F.xxhash64("text"), 1))  # stands for a null id
    docs = docs.withColumn("key", F.coalesce(F.col("doc_id").cast("long"), own))
    taken = mix(docs.select(F.col("key").alias("doc_id"), "text", "source")).filter("times > 0").select(F.col("doc_id").alias("key"), "times")
    return columns(docs.join(taken, "key").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("times")))))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with all their columns, and size, text_crc32, law, shard, slot and grown_shard of each; the copies of a document stay together.

    Rows of one doc_id and text have the slots from their first one on, in the order of their other columns.
    """
    docs = columns(docs)
    same = lambda df: df.select("*", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("__same"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    rows = same(docs).select("*", named)
    runs = slot_runs(docs).select(named, F.col("same").alias("__same"), "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    place = F.row_number().over(Window.partitionBy("__id", "__same").orderBy(F.col("text").isNull(), "lang", "source", "n_chars")) - 1
    out = rows.join(runs, ["__id", "__same"]).withColumn("slot", F.col("slot") + place)
    return out.select(*COLUMNS, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

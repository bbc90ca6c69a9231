"""JSON-lines corpora: mentions, documents and candidate lists, with explicit schemas; and the parquet feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MENTION = "mention_id string, context_document_id string, label_document_id string, start_index int, end_index int, text string, category string, corpus string"
DOCUMENT = "document_id string, text string"
CANDIDATES = "mention_id string, tfidf_candidates array<string>"


def last_wins(df: DataFrame, key: str) -> DataFrame:
    """One row a key: the last of the files in order, which are read in the order of their names."""
    place = F.struct(F.input_file_name(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    w = Window.partitionBy(key).orderBy(F.col("__place").desc())
    return df.withColumn("__place", place).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__place")


def read_mentions(spark: SparkSession, root: str, split: str) -> DataFrame:
    return spark.read.schema(MENTION).json(f"{root}/mentions/{split}.json")


def read_documents(spark: SparkSession, root: str, domains: list[str]) -> DataFrame:
    return last_wins(spark.read.schema(DOCUMENT).json([f"{root}/documents/{d}.json" for d in domains]), "document_id")


def read_candidates(spark: SparkSession, root: str, split: str) -> DataFrame:
    return last_wins(spark.read.schema(CANDIDATES).json(f"{root}/tfidf_candidates/{split}.json"), "mention_id")


def load_or_create(spark: SparkSession, path: str, make, overwrite: bool = False) -> DataFrame:
    """The parquet table at ``path``, written from ``make()`` first if it is missing or to be overwritten."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if overwrite or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

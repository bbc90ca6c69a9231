"""The corpus pipeline: language, near duplicates, benchmark passages, source mix, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import stages
from linkloom.llm._spark import shared_folder

STAGES = [
    ("language_id", stages.language),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontamination),
    ("mixing", stages.mixing),
    ("sharding", stages.sharding),
]

#: No SQL expresses minima, profiles and flights; tests/llm holds the stages against brute force, the mix against its targets, and the shards against op8's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: its columns with each row's size, text_crc32, law, shard, slot and grown_shard.

    Each stage's result is written to the shared folder and read again by the next, after which the one before it is removed; the last stays, as what the result reads.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, done = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{done}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done = name
    return docs

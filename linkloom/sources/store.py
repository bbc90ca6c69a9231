"""Parquet stores: examples by index, results of an evaluation, score maps and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.operators.dense import pairs_of_blocks

#: Buckets of an example store; a lookup reads those that its ids fall into.
BUCKETS = 64


def write_examples(examples: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """``examples`` with an idx, in a folder a bucket."""
    examples.withColumn("bucket", F.pmod("idx", F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def look_up(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The examples of ``ids`` (idx), each once; ids without an example are left out."""
    asked = ids.select("idx").distinct().withColumn("bucket", F.pmod("idx", F.lit(buckets)).cast("int"))
    return spark.read.parquet(path).join(asked, ["bucket", "idx"], "left_semi").drop("bucket")


def write_results(results: dict[str, DataFrame], root: str) -> None:
    """Each result of an evaluation as a table of its own."""
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_results(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Results by name, as rows; a graph that was saved in matrices is read as its pairs."""
    found = {name: spark.read.parquet(f"{root}/{name}") for name in names}
    return {name: pairs_of_blocks(df) if dict(df.dtypes).get("src") == "array<bigint>" else df for name, df in found.items()}


def write_scores(scores: DataFrame, path: str) -> None:
    """(mention_id, entity_id, score), a row a score."""
    scores.select("mention_id", "entity_id", F.col("score").cast("double").alias("score")).write.mode("overwrite").parquet(path)


def read_scores(spark: SparkSession, path: str, as_maps: bool = False) -> DataFrame:
    """The rows, or a map a mention."""
    rows = spark.read.schema("mention_id string, entity_id string, score double").parquet(path)
    return rows.groupBy("mention_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "score"))).alias("scores")) if as_maps else rows

"""The tables of a scale, and the index items that stand for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as index items: the title is the first line, cut to 80 characters."""
    title = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 80)
    return table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), F.col("text").alias("content"), "lang", "source")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries: their whole texts with single spaces."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.split(F.trim("text"), r"\s+"), " ").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


ITEMS_SQL = "items AS (SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, lang, source FROM documents)"
QUESTIONS_SQL = "questions AS (SELECT item_id AS query_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS text FROM benchmark)"

"""From documents to token files: the stages in order, each written as Parquet and read back for the next one.

1. toxicity: documents whose score is 0.5 or more go. The model is fit on a bounded sample of the labelled rows.
2. near_duplicates: of each component of the n-gram Jaccard join the document of the least id stays.
3. decontamination: documents that hold a benchmark item within its edit budget go.
4. mixing: the documents are put in the order of the Pfair mixture; each stays, and the files hold them in that order.
5. token_files: whole texts are encoded and written in the order of the mixture; the digest of the files comes back.

Null texts count as empty ones and stay to the end, as do rows with null ids or sources.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, jaccard_join, mixing, storage, token_files, toxicity

REJECT = 0.5
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, storage.load(spark, sf_dir, "labels"), F.lit(True))
    score = storage.free_name(docs, "score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < REJECT).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, storage.load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_mixed_order(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_files.write_tokens(docs, path, order=token_files.stored_order(docs))
    return token_files.token_digest(spark, path)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]
#: The stages hold a trained model, a similarity join, an edit distance and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = storage.new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

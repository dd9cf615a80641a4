"""One query for each operator, applied with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, brown, conversation_repair, decontaminate, jaccard_join, line_spread, merkle, mixing, repeats, storage, token_counts, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the number as text, modulo divisor; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.brown_scores(storage.load(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2)


def op2_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(storage.load(spark, sf_dir, "documents")))


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(storage.load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "mix.*")


def op5_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(storage.load(spark, sf_dir, "documents"), storage.load(spark, sf_dir, "benchmark"))


def op6_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.spread_lines(storage.load(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.load(spark, sf_dir, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, storage.load(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.with_scores(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.with_component_ids(jaccard_join.near_duplicate_components(storage.load(spark, sf_dir, "documents")))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_files.write_tokens(storage.load(spark, sf_dir, "documents"), path)
    return token_files.token_digest(spark, path)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.without_repeats(storage.load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = storage.load(spark, sf_dir, "conversations")
    return conversation_repair.audited(conversations, conversation_repair.damaged(conversations))


def op12_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.load(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, back=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.load(spark, sf_dir, "documents")
    n_chars = F.col("n_chars").cast("decimal(38,0)") + 1
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf([n_chars if c == "n_chars" else F.col(c) for c in merkle.FIELDS]))
    rows = merkle.with_proofs(merkle.manifest(docs, tampered))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_QUERIES: list[Query] = [op1_brown_scores, op2_length_histogram, op3_multiprobe_neighbours, op4_pfair_mix, op5_benchmark_matches, op6_spread_lines, op7_toxicity, op8_jaccard_components, op9_token_files, op10_repeated_strings, op11_repaired_conversations, op12_forced_boundary_bpe, op13_merkle_manifest]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}

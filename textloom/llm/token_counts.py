"""The exact histogram of documents' encoded lengths, and what suffix sums over it answer.

Null texts count as empty: length 0, or 1 with the end id. Every row counts, repeated ones too. An empty table gives
an empty histogram.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .encode import encoder, text_groups, tokenizer_path

BLOCK = 1024  # lengths whose sums one window holds


def _lengths(path: str, extra: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in text_groups(texts):
                n, times = np.unique(encoder(path).lengths(texts[first:last]) + extra, return_counts=True)
                for a, b in zip(n.tolist(), times.tolist(), strict=True):
                    found[a] = found.get(a, 0) + b
        if found:
            yield pa.record_batch({"n_tokens": pa.array(list(found), pa.int64()), "docs": pa.array(list(found.values()), pa.int64())})

    return run


def length_histogram(documents: DataFrame, tokenizer: str | None = None, end_id: bool = True) -> DataFrame:
    """n_tokens and docs: how many whole texts have that many ids."""
    docs = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    each = docs.mapInArrow(_lengths(tokenizer or tokenizer_path(), int(end_id)), "n_tokens bigint, docs bigint")
    # a row for each length, which several sums read
    return storage.materialize(each.groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of length L or more, all tokens if every document is cut to L, and the
    share of documents of at most L tokens. Sums run within blocks of lengths, and over the blocks' totals."""
    h = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    later = blocks.select("block", F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"), F.sum("docs").over(all_rows).alias("all_docs"), F.sum("tokens").over(all_rows).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    at_least = h.join(later, "block").select("n_tokens", "docs", "tokens", (F.sum("docs").over(inside) + F.col("docs_after")).alias("docs_at_least"), (F.sum("tokens").over(inside) + F.col("tokens_after")).alias("tokens_at_least"), "all_docs", "all_tokens")
    return at_least.select(
        "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least",
        (F.col("all_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_if_cut"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("docs")) / F.col("all_docs")).alias("share_at_most"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of all documents do not exceed; null for an empty table."""
    return sums.where(F.col("share_at_most") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: tokens of all documents cut to it, and the documents that it cuts."""
    each = sums.select("n_tokens", "docs", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])).alias("max_tokens"))
    longer = F.col("n_tokens") > F.col("max_tokens")
    return each.groupBy("max_tokens").agg(
        F.sum(F.least("n_tokens", "max_tokens") * F.col("docs")).alias("tokens"), F.sum(F.when(longer, F.col("docs")).otherwise(0)).alias("cut_docs"))

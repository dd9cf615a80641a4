"""Token ids in ORC files.

A file holds documents in ascending order of doc_id, and so do the files by their number. Columns: doc_id, start (ids
before the document in its own file), n_tokens, ids. ORC keeps integers run-length encoded, cuts files into stripes that
tasks read apart, and holds row indexes and a Bloom filter of doc_id with which a read by id skips stripes and row groups.

A null text counts as empty and gives the end id alone. Null doc_ids come first. Repeated doc_ids are ordered by the
hash of their texts; each row keeps its own ids. An empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .encode import END_ID, encoder, text_groups, tokenizer_path

DOCS_PER_FILE = 5000
STRIPE_BYTES = 16 << 20
FILE_BLOCK = 1024  # files whose sums one window holds
ROW_GROUP = 1000  # rows of an entry of the row index
_FILE = "doc_id bigint, start bigint, n_tokens bigint, ids array<int>"


def _encode(path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, last in text_groups(texts):
                ids, sizes = encoder(path).encode(texts[first:last], end_id)
                ends = np.cumsum(sizes)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(first, last - first), "start": start + ends - sizes, "n_tokens": sizes,
                    "ids": pa.ListArray.from_arrays(np.r_[0, ends].astype(np.int32), pa.array(ids.view(np.int32))),
                })
                start += int(ends[-1])

    return run


def write_tokens(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, order: list[Column] | None = None) -> None:
    """Encode every whole text, with end_id after it, and write the files. `order` replaces the order by doc_id."""
    spark = documents.sparkSession
    order = order or [F.col("doc_id"), F.xxhash64("text")]
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c.alias(f"_order{i}") for i, c in enumerate(order)])
    keys = [f"_order{i}" for i in range(len(order))]
    files = storage.tasks(spark, documents.count(), DOCS_PER_FILE)
    ordered = docs.repartitionByRange(files, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    encoded = ordered.mapInArrow(_encode(tokenizer or tokenizer_path(), end_id), _FILE)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": str(ROW_GROUP), "orc.stripe.size": str(STRIPE_BYTES)}
    encoded.write.options(**options).orc(path, compression="snappy")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with their file's number. A filter on doc_id reads only the stripes and row groups that may match."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return spark.read.schema(_FILE).orc(path).select("doc_id", "start", "n_tokens", "ids", number.alias("file"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.record_batch({**{c: batch.column(c) for c in ("doc_id", "start", "file")}, "n_tokens": np.diff(at).astype(np.int64), "ids_crc32": pa.array(crc, pa.int64())})


def stored_order(documents: DataFrame) -> list[Column] | None:
    """The order in which files hold the rows; none if the frame isn't read straight from files."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        documents.select(*order).schema  # noqa: B018
    except AnalysisException:
        return None
    return order


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it in all files), n_tokens and the CRC of the ids, from the files."""
    rows = read_tokens(spark, path).mapInArrow(_digest, "doc_id bigint, start bigint, file int, n_tokens bigint, ids_crc32 bigint")
    rows = storage.materialize(rows, "token-digest")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("ids")).withColumn("block", F.floor(F.col("file") / FILE_BLOCK))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for FILE_BLOCK files
    blocks = totals.groupBy("block").agg(F.sum("ids").alias("ids")).select("block", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("block_before"))
    inside = Window.partitionBy("block").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("file_before", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(blocks, "block").select("file", (F.col("block_before") + F.col("file_before")).alias("before"))
    return rows.join(offsets, "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

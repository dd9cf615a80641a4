"""Tables in the folder that the cluster shares, used to cut lineage."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dir()


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textloom-")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from now on in this session: a Python worker holds several copies of one."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def collect_garbage(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay until the driver, Python first and then the JVM, has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lost executors need not recompute it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized frame that no later step reads."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(root.split(":")[-1].lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for so many rows: grows with the data, never below the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, null texts as empty ones; other columns are left behind."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it while a column of df has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


KEY_BITS = 26


def key_bits(keys: DataFrame, key: str):
    """A bit for each key (a hash), broadcast: 2 ** KEY_BITS of them, whatever the number of keys."""
    bit = F.pmod(F.col(key), F.lit(1 << KEY_BITS))
    marks = keys.select(F.floor(bit / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("bits"))
    found = marks.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(1 << KEY_BITS - 6, np.int64)
    words[found.word] = found.bits
    return keys.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def maybe_among(df: DataFrame, bits, key: str, among: bool = True) -> DataFrame:
    """The rows of df whose key may be among the keys of `bits`, or with among=False the rest, surely not among them.

    Spares a join from moving rows that it would drop, while the keys are many fewer than 2 ** KEY_BITS; with very many
    keys all rows may be among them, and the join alone decides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(key).to_numpy().view(np.uint64) & np.uint64((1 << KEY_BITS) - 1)
            hit = bits.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool) == among))

    return df.mapInArrow(run, df.schema)

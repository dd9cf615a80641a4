"""Tables written between the steps of an operator, in the folder that a cluster shares."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), under a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or _own_folder()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textloom-")


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches of `most` bytes at most from now on in this session: a Python worker holds several copies of one."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(setting, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most:
        spark.conf.set(setting, f"{most}b")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: lost executors need not compute it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

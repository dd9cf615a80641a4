"""Tables in versions: a reader sees one version whole, whatever is written meanwhile.

Rows lie in folders that are never changed. A version is a small manifest, numbered in order, that names its folders, the
schema and the last batch of each stream. A manifest is written aside and renamed to its number; if another writer took
the number first, the write is tried again on top of that version. So appends, overwrites, deletes of all rows and
batches of a stream that are run again are each done wholly, once, or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTEMPTS = 50


@dataclass
class Version:
    number: int = 0
    folders: list[str] = field(default_factory=list)
    schema: str | None = None
    batches: dict[str, int] = field(default_factory=dict)  # of each stream the last one


class Table:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._paths(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def version(self, number: int | None = None) -> Version:
        """The latest version, or one of before."""
        known = self._manifests()
        if not known:
            return Version()
        stream = self._fs.open(self._paths(f"{self.path}/manifests/{number or known[-1]:012d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _commit(self, change: Callable[[Version], Version | None]) -> Version:
        for _ in range(ATTEMPTS):
            now = self.version()
            new = change(now)
            if new is None:
                return now
            new.number = now.number + 1
            aside = self._paths(f"{self.path}/manifests/_{uuid.uuid4().hex}")
            out = self._fs.create(aside, False)
            out.write(bytearray(json.dumps(asdict(new)).encode()))
            out.close()
            taken = self._paths(f"{self.path}/manifests/{new.number:012d}")
            if not self._fs.exists(taken) and self._fs.rename(aside, taken):
                return new
            self._fs.delete(aside, False)
        raise RuntimeError(f"{self.path}: other writers were faster {ATTEMPTS} times")

    def _written(self, df: DataFrame, cluster_by: list[str] | None) -> str:
        """A new folder with the rows; those of equal keys stand together, sorted, so that a scan by key skips row groups."""
        name = f"data-{uuid.uuid4().hex}"
        rows = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def overwrite(self, df: DataFrame, cluster_by: list[str] | None = None) -> Version:
        name, schema = self._written(df, cluster_by), df.schema.json()
        return self._commit(lambda now: Version(0, [name], schema, now.batches))

    def append(self, df: DataFrame, cluster_by: list[str] | None = None) -> Version:
        name, schema = self._written(df, cluster_by), df.schema.json()
        return self._commit(lambda now: Version(0, [*now.folders, name], now.schema or schema, now.batches))

    def append_once(self, df: DataFrame, stream: str, batch: int) -> Version:
        """For foreachBatch: the rows of a stream's batch. A batch that was added already adds nothing."""
        if batch <= self.version().batches.get(stream, -1):
            return self.version()
        name, schema = self._written(df, None), df.schema.json()

        def change(now: Version) -> Version | None:
            if batch <= now.batches.get(stream, -1):
                return None
            return Version(0, [*now.folders, name], now.schema or schema, now.batches | {stream: batch})

        return self._commit(change)

    def truncate(self) -> Version:
        """No rows from the next version on; those of before stay for readers that have begun."""
        return self._commit(lambda now: Version(0, [], now.schema, now.batches))

    def upsert(self, new: DataFrame, keys: list[str], cluster_by: list[str] | None = None) -> Version:
        """Replace the rows whose keys the new ones have, which may be null, and add the new ones. It fails if another
        writer came between, for its rows would be lost."""
        from .files import upserted

        base = self.version()
        rows = upserted(self.read(base.number), new, keys) if base.schema else new
        name, schema = self._written(rows, cluster_by), rows.schema.json()

        def change(now: Version) -> Version:
            if now.number != base.number:
                raise RuntimeError(f"{self.path}: version {now.number} came while version {base.number} was rewritten")
            return Version(0, [name], schema, now.batches)

        return self._commit(change)

    def compact(self, cluster_by: list[str] | None = None) -> Version:
        """The same rows in one folder; folders that came meanwhile stay beside it."""
        base = self.version()
        name = self._written(self.read(base.number), cluster_by)
        return self._commit(lambda now: Version(0, [name, *[f for f in now.folders if f not in base.folders]], now.schema, now.batches))

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the latest version, or of one of before. A table without any version has no columns."""
        version = self.version(number)
        if not version.folders:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(version.schema)) if version.schema else StructType())
        return self.spark.read.schema(StructType.fromJson(json.loads(version.schema))).parquet(*[f"{self.path}/{f}" for f in version.folders])

    def vacuum(self, keep: int) -> int:
        """Delete folders that none of the last `keep` versions names and no writer can still be about to name: they are in
        an older version. Older manifests go too. Gives the number of folders deleted."""
        known = self._manifests()
        old, kept = known[:-keep], {f for n in known[-keep:] for f in self.version(n).folders}
        gone = {f for n in old for f in self.version(n).folders} - kept
        for name in gone:
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)
        for n in old:
            self._fs.delete(self._paths(f"{self.path}/manifests/{n:012d}"), False)
        return len(gone)


def event_rows(events: DataFrame) -> DataFrame:
    """Events as the log keeps them: an empty set of properties is null."""
    props = F.col("props")
    return events.withColumn("props", F.when(~F.trim(props).isin("", "{}", "null"), props))


def log_stream(events: DataFrame, log: Table, name: str, checkpoint: str):
    """Start a stream of events into the log until all that is there has been read. Each event is in the log once, also when
    the stream dies at any place and is started again with the same checkpoint."""
    write = lambda batch, number: log.append_once(event_rows(batch), name, number)
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

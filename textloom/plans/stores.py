"""Streams and stores over the tables: an event log, active users, conversations that lapse, and embeddings.

Each query runs its streams to their end over tables of its own in the shared folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stored
from ..operators import embedding
from ..sources.versions import Table, log_stream
from ..streaming import stores
from .tables import items, table

AS_OF = "2024-01-30 23:00:00"
DIMENSIONS = 16
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started within keep their state in RocksDB; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, stores.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _run(changes: DataFrame, name: str, mode: str) -> DataFrame:
    """The rows that a stream gives until its end."""
    spark = changes.sparkSession
    path = stored.shared_path(spark, name)
    log = Table(spark, path)
    write = lambda batch, number: log.append_once(batch, name, number)
    with rocksdb(spark):
        query = changes.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
        query.awaitTermination()
    return log.read()


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream into a log, then the same batches once more, which add nothing."""
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    path = stored.shared_path(spark, "events")
    for state in ("state", "again"):
        log_stream(events, Table(spark, path), "events", f"{path}-{state}").awaitTermination()
    return Table(spark, path).read()


def _closed(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream, and an event long after all others that moves the watermark past them."""
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = stored.written(events.agg(F.lit(-1).cast("bigint").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")), "last-event")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return stream.unionByName(spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rsplit("/", 1)[0]))


def active_user_changes(spark: SparkSession, d: str) -> DataFrame:
    """When users become active and when they lapse, by a stream; the closing event's user is left out."""
    changes = _run(stores.active_users(_closed(spark, d), 7200), "active-users", "append").where("user_id >= 0")
    return changes.select("user_id", "change", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), F.col("ts").cast("timestamp_ntz").alias("ts"))


def active_users_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The users whom the stream has for active at one moment."""
    return stores.active_at(active_user_changes(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns dealt over the minutes before noon, later turns of a conversation later, written as a table to stream from."""
    minutes = (F.col("conv_id") * 7) % 120 - F.least(F.col("turn"), F.lit(20)) / 4
    at = F.lit("2024-01-31 12:00:00").cast("timestamp") - F.make_dt_interval(secs=(F.greatest(minutes, F.lit(0)) * 60).cast("decimal(18,6)"))
    return stored.written(table(spark, d, "conversations").select("conv_id", "turn", "role", "text", at.alias("at")), "messages")


def conversation_store(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that a stream still has at noon, with how many messages it keeps of each and the last one."""
    rows = _messages(spark, d)
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    closing = stored.written(spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"), F.lit("2024-01-31 12:00:00").cast("timestamp").alias("at")), "closing")
    stream = spark.readStream.schema(rows.schema).parquet(folder).unionByName(spark.readStream.schema(rows.schema).parquet(closing.inputFiles()[0].rsplit("/", 1)[0]))
    kept = stores.stored(_run(stores.conversation_store(stream, most=4), "conversations", "update"))
    return kept.where("conv_id >= 0").select("conv_id", F.date_format("last_active", "HH:mm:ss").alias("last_active"), F.size("messages").alias("messages"), F.element_at("messages", -1)["text"].alias("text"))


def embedded_items(spark: SparkSession, d: str) -> DataFrame:
    """Every document's vector from the stand-in for a model."""
    texts = embedding.text_to_embed(items(spark, d)).select("doc_id", "text")
    rows = embedding.embed(texts, lambda: embedding.HashingEmbedder(DIMENSIONS))
    return rows.select("doc_id", *[F.round(F.get("embedding", F.lit(i)).cast("double"), 5).alias(f"v{i}") for i in range(DIMENSIONS)])


def embedded_incrementally(spark: SparkSession, d: str) -> DataFrame:
    """French items are embedded first, then what the index lacks: doc_id, and in which version it came."""
    index = Table(spark, stored.shared_path(spark, "vectors"))
    texts = embedding.text_to_embed(items(spark, d)).select("doc_id", "text", "lang")
    model = lambda: embedding.HashingEmbedder(DIMENSIONS)
    for number, part in enumerate((texts.where("lang = 'fr'"), texts)):
        known = index.read() if number else spark.createDataFrame([], "doc_id bigint, text_sha256 string")
        new = embedding.missing(part.select("doc_id", "text"), known)
        index.append(embedding.embed(new, model).select("doc_id", "text_sha256", "embedding", F.lit(number).alias("version")))
    return index.read().select("doc_id", "version")


_PAUSES = """p AS (SELECT user_id, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
changes AS (SELECT user_id, 'arrived' AS change, ts AS last_ts, ts FROM p WHERE before IS NULL OR ts > before + INTERVAL 7200 SECOND
UNION ALL SELECT user_id, 'lapsed', ts, ts + INTERVAL 7200 SECOND FROM p WHERE after IS NULL OR after > ts + INTERVAL 7200 SECOND)"""
_TEXT = "SELECT doc_id, title || chr(10) || title || chr(10) || content AS text FROM items WHERE trim(content) <> ''"
_COUNT = "len(list_filter(words, lambda w: (ascii(w[1]) + 31 * length(w)) % {n} = {i}))"

QUERIES = {f.__name__: f for f in (event_log, active_user_changes, active_users_streamed, conversation_store, embedded_items, embedded_incrementally)}
SQL = {
    "event_log": "SELECT event_id, ts, user_id, event_type, value, CASE WHEN trim(props) NOT IN ('', '{}', 'null') THEN props END AS props FROM events",
    "active_user_changes": f"WITH {_PAUSES} SELECT * FROM changes",
    "active_users_streamed": f"SELECT user_id FROM events WHERE ts <= TIMESTAMP '{AS_OF}' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 7200 SECOND",
    "conversation_store": """WITH m AS (SELECT *, TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 1 SECOND * CAST(greatest((conv_id * 7) % 120 - least(turn, 20) / 4, 0) * 60 AS INTEGER) AS at_ts FROM conversations),
c AS (SELECT conv_id, max(at_ts) AS last_at, least(count(*), 4) AS messages, last(text ORDER BY at_ts, turn) AS text FROM m GROUP BY conv_id)
SELECT conv_id, strftime(last_at, '%H:%M:%S') AS last_active, CAST(messages AS INTEGER) AS messages, text FROM c WHERE last_at >= TIMESTAMP '2024-01-31 11:00:00'""",
    "embedded_items": "WITH items AS (SELECT doc_id, substring(split_part(text, chr(10), 1), 1, 80) AS title, text AS content FROM documents), t AS (" + _TEXT + "), w AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS words FROM t), c AS (SELECT doc_id, [" + ", ".join(_COUNT.format(n=DIMENSIONS, i=i) for i in range(DIMENSIONS)) + "] AS c FROM w), "
    "n AS (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS l FROM c) SELECT doc_id, " + ", ".join(f"round(CAST(CAST(c[{i + 1}] / CASE WHEN l > 0 THEN l ELSE 1 END AS FLOAT) AS DOUBLE), 5) AS v{i}" for i in range(DIMENSIONS)) + " FROM n",
    "embedded_incrementally": "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE 1 END AS version FROM documents WHERE trim(text) <> ''",
}

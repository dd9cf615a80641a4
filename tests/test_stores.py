"""Versioned tables, the event log, streaming stores and embeddings."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from textloom.operators import conversation, embedding, usage
from textloom.plans.stores import rocksdb
from textloom.sources.versions import Table, log_stream
from textloom.streaming import stores

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
START = dt.datetime(2024, 1, 1)


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_versions(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t")
    assert table.read().columns == [] and table.version().number == 0
    table.append(spark.range(3), cluster_by=["id"])
    reader = table.read()  # begins with version 1
    table.append(spark.range(3, 5))
    assert ids(reader) == [0, 1, 2] and ids(table.read()) == [0, 1, 2, 3, 4]
    table.truncate()
    assert table.read().columns == ["id"] and table.read().count() == 0 and ids(reader) == [0, 1, 2] and ids(table.read(2)) == [0, 1, 2, 3, 4]
    table.overwrite(spark.range(2))
    table.overwrite(table.read().where("id = 1"))  # of the table itself
    assert ids(table.read()) == [1]
    table.append(spark.range(7, 9))
    table.compact()
    assert ids(table.read()) == [1, 7, 8] and len(table.version().folders) == 1
    gone = table.vacuum(2)
    assert gone >= 3 and ids(table.read()) == [1, 7, 8]


def test_upserts_and_writers_at_once(spark, tmp_path):
    table = Table(spark, f"{tmp_path}/t")
    row = "id bigint, v string"
    table.upsert(spark.createDataFrame([(1, "a"), (None, "n")], row), ["id"])
    table.upsert(spark.createDataFrame([(None, "m"), (2, "b")], row), ["id"])
    assert sorted((r.id or 0, r.v) for r in table.read().collect()) == [(0, "m"), (1, "a"), (2, "b")]
    writers = [threading.Thread(target=lambda i=i: Table(spark, f"{tmp_path}/t").append(spark.createDataFrame([(i, "w")], row))) for i in range(10, 14)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert {10, 11, 12, 13} <= {r.id for r in table.read().collect()} and table.version().number == 6
    late = Table(spark, f"{tmp_path}/t")
    own = late._written
    late._written = lambda *a: (table.append(spark.createDataFrame([(99, "between")], row)), own(*a))[1]
    with pytest.raises(RuntimeError):
        late.upsert(spark.createDataFrame([(1, "lost?")], row), ["id"])
    assert (1, "a") in {(r.id, r.v) for r in table.read().collect()}


@pytest.mark.parametrize("place", ["before", "after"])
def test_a_stream_that_dies_gives_each_event_once(spark, tmp_path, place):
    for i in range(4):
        spark.createDataFrame([(10 * i + j, START, j, "visit", 1.0, "{}" if j else '{"k": 1}') for j in range(5)], EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    log, commit = Table(spark, f"{tmp_path}/log"), Table._commit
    calls = []

    def dying(self, change):
        calls.append(1)
        if len(calls) == 3:
            if place == "after":
                commit(self, change)
            raise OSError("the driver is gone")
        return commit(self, change)

    log._commit = dying.__get__(log)
    with pytest.raises(Exception):  # noqa: B017
        log_stream(events, log, "events", f"{tmp_path}/cp").awaitTermination()
    log_stream(events, Table(spark, f"{tmp_path}/log"), "events", f"{tmp_path}/cp").awaitTermination()
    rows = Table(spark, f"{tmp_path}/log").read().collect()
    assert sorted(r.event_id for r in rows) == sorted(10 * i + j for i in range(4) for j in range(5))
    assert {r.props for r in rows} == {None, '{"k": 1}'}


def streamed(spark, tmp_path, rows, schema, build, mode, files):
    """Rows of a stream over `files` files in order of their time, one for each batch."""
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    out = Table(spark, f"{tmp_path}/out")
    with rocksdb(spark):
        stream.writeStream.foreachBatch(lambda df, n: out.append_once(df, "s", n)).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return out.read()


def test_active_users_at_any_time(spark, tmp_path):
    rng = random.Random(2)
    seconds = sorted(rng.randrange(6000) for _ in range(160))
    rows = [(i, START + dt.timedelta(seconds=s), rng.randrange(6), "view", 0.0, None) for i, s in enumerate(seconds)]
    changes = streamed(spark, tmp_path, [*rows, (999, START + dt.timedelta(days=2), 99, "view", 0.0, None)], EVENT, lambda s: stores.active_users(s.select("user_id", "ts")), "append", 4).cache()
    events = spark.createDataFrame(rows, EVENT).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for at in (0, 700, 1500, 2900, 4444, 5999, 6100, 9000):
        as_of = START + dt.timedelta(seconds=at)
        want = sorted(r.user_id for r in usage.active_users(events, str(as_of)).collect())
        assert sorted(r.user_id for r in stores.active_at(changes, F.lit(as_of)).collect()) == want


def test_conversations_are_kept_and_lapse(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string, at timestamp"
    rng = random.Random(3)
    minutes = sorted(rng.uniform(0, 400) for _ in range(120))
    rows = [(rng.randrange(9), i, "user", f"m{i}", START + dt.timedelta(minutes=m)) for i, m in enumerate(minutes)]
    noon = START + dt.timedelta(minutes=460)
    closing = (-1, 0, "user", "", noon)
    out = streamed(spark, tmp_path, [*rows, closing], schema, lambda s: stores.conversation_store(s, 60, 5), "update", 4)
    got = {r.conv_id: r for r in stores.stored(out).collect() if r.conv_id >= 0}
    messages = spark.createDataFrame(rows, schema)
    kept = conversation.kept_conversations(messages, F.lit(noon), 1000, 60)
    assert {c: r.last_active for c, r in got.items()} == {r.conv_id: r.last_active for r in kept.collect()}
    for conv, r in got.items():  # since the last pause of over an hour, five at most
        own, since = [x for x in rows if x[0] == conv], []
        for before, x in zip([None, *own], own):
            since = [x] if before is not None and x[4] - before[4] > dt.timedelta(hours=1) else [*since, x]
        assert [m.text for m in r.messages] == [x[3] for x in since][-5:]
    assert "expired" in {r.state for r in out.collect()}


class Counting:
    """Fails on texts with `bad`, and says how many texts each call had."""

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[float(len(texts)), float(len(t))] for t in texts]


def test_batches_of_32_across_arrow_borders(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        texts = spark.range(0, 100, 1, 1).select("id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
        rows = embedding.embed(texts, Counting).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.id for r in rows] == list(range(100)) and [r.embedding[1] for r in rows] == list(range(100))
    assert [r.embedding[0] for r in rows] == [32] * 96 + [4] * 4  # each call's size


def test_failures_are_rows(spark):
    rows = [(i, "bad" if i == 5 else None if i == 6 else f"text {i}", "kept") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, error string").coalesce(1)
    got = {r.doc_id: r for r in embedding.embed(frame, Counting).collect()}
    assert len(got) == 40 and got[5].embedding is None and got[5].error == "ValueError: bad text"
    assert got[6].embedding == [1.0, 0.0] and all(r.error is None for i, r in got.items() if i != 5)
    assert embedding.embed(frame.limit(0), Counting).count() == 0


def test_texts_and_what_an_index_lacks(spark):
    items = spark.createDataFrame([(1, "T", "body " * 300), (2, None, "b"), (3, "t", " "), (4, "t", None)], "doc_id bigint, title string, content string")
    texts = {r.doc_id: r.text for r in embedding.text_to_embed(items).collect()}
    assert texts == {1: "T\nT\n" + "body " * 300, 2: "\n\nb"}
    index = embedding.missing(embedding.text_to_embed(items), spark.createDataFrame([], "doc_id bigint, text_sha256 string")).select("doc_id", "text_sha256")
    assert index.count() == 2 and embedding.missing(embedding.text_to_embed(items.withColumn("content", F.when(F.col("doc_id") == 2, "c").otherwise(F.col("content")))), index).select("doc_id").collect()[0][0] == 2

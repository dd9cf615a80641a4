"""Visits, active users, conversations and job states over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "1 day"


def visits(events: DataFrame, gap: str = "120 seconds", late: str = WATERMARK) -> DataFrame:
    """Visits as session windows: one begins after a pause longer than gap. In append mode a visit comes out when the
    watermark has passed its end, so the last ones of a stream wait. events: user_id, ts (timestamp)."""
    sessions = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s"))
    return sessions.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).drop("s")


def active_users(events: DataFrame, window: str = "120 seconds", late: str = "120 seconds") -> DataFrame:
    """Users with an event in each window, with their latest one."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.max("ts").alias("last_ts"))


def latest_states(changes: DataFrame, late: str = WATERMARK) -> DataFrame:
    """The latest status of each job; equal changes count once. changes: job_id, status, ts. For update mode."""
    once = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["job_id", "status", "ts"])
    return once.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("ts"))


class VisitStarts(StatefulProcessor):
    """Marks the events that begin a visit, by the time of the user's event before; a user's state lapses after a while."""

    def __init__(self, gap_seconds: float = 120):
        self.gap = pd.Timedelta(seconds=gap_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts timestamp", ttlDurationMs=int(self.gap.total_seconds() * 1000 * 10))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("ts")
        before = pd.Timestamp(self.last.get()[0]) if self.last.exists() else pd.NaT
        previous = events.ts.shift(1)
        previous.iloc[0] = before
        begins = previous.isna() | (events.ts > previous + self.gap)
        self.last.update((max(events.ts.iloc[-1], before) if before is not pd.NaT else events.ts.iloc[-1],))
        if begins.any():
            yield pd.DataFrame({"user_id": key[0], "ts": events.ts[begins]})

    def close(self) -> None:
        pass


def visit_starts(events: DataFrame, gap_seconds: float = 120) -> DataFrame:
    """user_id and ts of the events that begin a visit, at once instead of when the visit is over. Needs the RocksDB
    state store."""
    return events.groupBy("user_id").transformWithStateInPandas(VisitStarts(gap_seconds), "user_id bigint, ts timestamp", "Append", "None")

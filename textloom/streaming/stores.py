"""Stores that a stream keeps up to date and that forget: active users and conversations.

State is kept for each key with one event-time timer, so a key costs nothing after it has lapsed. Both need the RocksDB
state store (spark.sql.streaming.stateStore.providerClass) and a watermark: a timer fires when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTIVE_SECONDS, IDLE_MINUTES, KEPT_MESSAGES = 120, 60, 50
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(when: pd.Timestamp) -> int:
    return int(when.value // 1_000_000)


class _Lapsing(StatefulProcessor):
    """A key's latest time and the timer of its lapse, the first millisecond after `idle`."""

    def __init__(self, idle: pd.Timedelta):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts timestamp, timer bigint")

    def latest(self) -> pd.Timestamp | None:
        return pd.Timestamp(self.last.get()[0]) if self.last.exists() else None

    def seen(self, when: pd.Timestamp) -> None:
        if self.last.exists():
            self.handle.deleteTimer(self.last.get()[1])
        timer = _millis(when + self.idle) + 1
        self.handle.registerTimer(timer)
        self.last.update((when.to_pydatetime(), timer))

    def close(self) -> None:
        pass


class ActiveUsers(_Lapsing):
    """A row when a user arrives, and one when the user's last event is too long ago."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, out = self.latest(), []
        for when in pd.concat([r.ts for r in rows]).sort_values():
            if last is None or when > last + self.idle:
                if last is not None:  # it lapsed before the watermark could tell
                    out.append((key[0], "lapsed", last, last + self.idle))
                out.append((key[0], "arrived", when, when))
            last = when if last is None or when > last else last
        self.seen(last)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "change", "last_ts", "ts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.latest()
        self.last.clear()
        yield pd.DataFrame([(key[0], "lapsed", last, last + self.idle)], columns=["user_id", "change", "last_ts", "ts"])


def active_users(events: DataFrame, seconds: int = ACTIVE_SECONDS, late: str = "0 seconds") -> DataFrame:
    """user_id, change (arrived or lapsed), last_ts and ts: when users become active and when they cease to be. Events
    (user_id, ts) of one batch are put in order; one that is older than the user's latest changes nothing."""
    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.transformWithStateInPandas(ActiveUsers(pd.Timedelta(seconds=seconds)), "user_id bigint, change string, last_ts timestamp, ts timestamp", "Append", "EventTime")


def active_at(changes: DataFrame, as_of: Column) -> DataFrame:
    """Users active at a time that the stream has passed: those with more arrivals than lapses until then."""
    arrived = F.count_if((F.col("change") == "arrived") & (F.col("ts") <= as_of))
    lapsed = F.count_if((F.col("change") == "lapsed") & (F.col("ts") < as_of))
    return changes.groupBy("user_id").agg((arrived - lapsed).alias("open")).where("open > 0").select("user_id")


_STORED = "conv_id bigint, state string, last_active timestamp, messages array<struct<role: string, text: string>>"


class ConversationStore(_Lapsing):
    """The last messages of each conversation, until it has been idle for too long."""

    def __init__(self, idle: pd.Timedelta, most: int):
        super().__init__(idle)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.messages = handle.getListState("messages", "role string, text string")

    def _row(self, key, state: str, last: pd.Timestamp, messages: list[tuple]) -> pd.DataFrame:
        kept = [{"role": r, "text": t} for r, t in messages]
        return pd.DataFrame({"conv_id": [key[0]], "state": [state], "last_active": [last], "messages": [kept]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["at", "turn"], kind="stable")
        last = self.latest()
        begins = new["at"].diff() > self.idle
        begins.iloc[0] = last is not None and new["at"].iloc[0] > last + self.idle
        kept = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        for role, text, fresh in zip(new.role, new.text, begins, strict=True):
            kept = ([] if fresh else kept)[1 - self.most :] + [(role, text)]  # a conversation that had lapsed begins anew
        kept = kept[-self.most :]
        latest = new["at"].iloc[-1] if last is None else max(last, new["at"].iloc[-1])
        self.messages.put(kept)
        self.seen(latest)
        yield self._row(key, "active", latest, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.latest()
        self.messages.clear()
        self.last.clear()
        yield self._row(key, "expired", last, [])


def conversation_store(messages: DataFrame, idle_minutes: int = IDLE_MINUTES, most: int = KEPT_MESSAGES, late: str = "0 seconds") -> DataFrame:
    """conv_id, state (active or expired), last_active and the last `most` messages, a row for each change of a conversation.
    messages: conv_id, turn, role, text and at (timestamp)."""
    keyed = messages.withWatermark("at", late).groupBy("conv_id")
    return keyed.transformWithStateInPandas(ConversationStore(pd.Timedelta(minutes=idle_minutes), most), _STORED, "Update", "EventTime")


def stored(changes: DataFrame) -> DataFrame:
    """The conversations in the store after all changes (an active row and a lapse of equal times: it has lapsed)."""
    latest = changes.groupBy("conv_id").agg(F.max_by(F.struct("state", "last_active", "messages"), F.struct("last_active", "state")).alias("row"))
    return latest.select("conv_id", "row.*").where("state = 'active'").drop("state")

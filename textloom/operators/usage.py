"""Usage analytics over an event log. Every function takes its clock as `as_of`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISIT_GAP = "INTERVAL 120 SECONDS"
ACTIVE_SECONDS = 120


def _time(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def distinct_users(events: DataFrame, as_of: str, kind: str | None = None) -> DataFrame:
    """One row: distinct users of the day of as_of, of the seven days before it, and of all time."""
    if kind is not None:
        events = events.where(F.col("event_type") == kind)
    now = _time(as_of)
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    today = (F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY"))
    week = (F.col("ts") >= now - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") <= now)
    user = F.col("user_id")
    return events.agg(F.countDistinct(F.when(today, user)).alias("today"), F.countDistinct(F.when(week, user)).alias("week"), F.countDistinct(user).alias("total"))


def daily_users(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("user_id").alias("users"))


def top_by_json_key(events: DataFrame, kind: str, path: str, n: int) -> DataFrame:
    """The most frequent values of a JSON key, ties to the smaller value; a missing key is a value of its own."""
    found = events.where((F.col("event_type") == kind) & F.col("props").isNotNull()).groupBy(F.get_json_object("props", path).alias("value")).agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), F.col("value").asc_nulls_first()).limit(n)


def totals(events: DataFrame, kind: str, as_of: str) -> DataFrame:
    day = F.date_trunc("day", _time(as_of)).cast("timestamp_ntz")
    of_kind = events.where(F.col("event_type") == kind)
    return of_kind.agg(F.count("*").alias("total"), F.count_if((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY"))).alias("today"))


def daily_counts(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def percent_of_most(counts: DataFrame, count: str = "n") -> DataFrame:
    """Counts with `percent`, their share of the largest one in whole percent; 0 where that is 0."""
    most = F.broadcast(counts.agg(F.max(count).alias("_most")))  # one row
    share = F.floor(100 * F.col(count) / F.col("_most") + 0.5).cast("int")
    return counts.join(most).withColumn("percent", F.when(F.col("_most") > 0, share).otherwise(0)).drop("_most")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """positive, negative and the rounded percentage by route, by confidence and over all. feedback: route, confidence,
    feedback ('positive' or 'negative'). Null and empty routes are UNKNOWN, such confidences unknown."""
    named = feedback.select(
        F.coalesce(F.nullif("route", F.lit("")), F.lit("UNKNOWN")).alias("route"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("unknown")).alias("confidence"), "feedback"
    )
    sums = named.groupingSets([["route"], ["confidence"], []], "route", "confidence").agg(
        F.grouping_id().alias("level"), F.count_if(F.col("feedback") == "positive").alias("positive"), F.count_if(F.col("feedback") == "negative").alias("negative"))
    both = F.col("positive") + F.col("negative")
    rate = F.when(both > 0, F.bround(100 * F.col("positive") / both, 0)).otherwise(0).cast("int")
    level = F.when(F.col("level") == 3, "total").when(F.col("level") == 1, "route").otherwise("confidence")
    return sums.select(level.alias("level"), "route", "confidence", "positive", "negative", rate.alias("rate"))


def daily_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_if(F.col("feedback") == "positive").alias("positive"), F.count_if(F.col("feedback") == "negative").alias("negative"))


def latest_negative(feedback: DataFrame, n: int) -> DataFrame:
    return feedback.where(F.col("feedback") == "negative").orderBy(F.desc("ts"), F.desc("id")).limit(n)


def visits(events: DataFrame, gap: str = VISIT_GAP) -> DataFrame:
    """Each user's visits: one begins after a pause longer than gap."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    before = F.lag("ts").over(own)
    begins = F.when(before.isNull() | (F.col("ts") > before + F.expr(gap)), 1).otherwise(0)
    numbered = events.withColumn("begins", begins).withColumn("visit", F.sum("begins").over(own))
    return numbered.groupBy("user_id", "visit").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events"))


def active_users(events: DataFrame, as_of: str, seconds: int = ACTIVE_SECONDS) -> DataFrame:
    """Users seen within so many seconds before as_of, with what has passed since."""
    now = _time(as_of)
    last = events.where(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    since = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))
    return last.select("user_id", "last_ts", since.alias("elapsed")).where(F.col("last_ts") >= now - F.expr(f"INTERVAL {seconds} SECONDS"))


def truncate_preview(feedback: DataFrame, size: int = 200) -> DataFrame:
    return feedback.withColumn("answer_preview", F.substring("answer_preview", 1, size))

"""Usage analytics over `events`, and feedback from `labels` joined to `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import usage
from .tables import table

AS_OF = "2024-01-31 00:00:00"


def daily_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_users(table(spark, d, "events"))


def distinct_users_by_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_users(table(spark, d, "events"), "2024-01-30 12:00:00")


def signup_users_by_window(spark: SparkSession, d: str) -> DataFrame:
    return usage.distinct_users(table(spark, d, "events"), AS_OF, "signup")


def top_views_by_json_key(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_by_json_key(table(spark, d, "events"), "view", "$.k", 10)


def top_clicks_by_json_key(spark: SparkSession, d: str) -> DataFrame:
    return usage.top_by_json_key(table(spark, d, "events"), "click", "$.k", 20)


def purchase_totals(spark: SparkSession, d: str) -> DataFrame:
    return usage.totals(table(spark, d, "events"), "purchase", "2024-01-30 12:00:00")


def daily_purchases(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_counts(table(spark, d, "events"), "purchase")


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return labels.join(docs, "doc_id").select(F.when(F.col("lang") == "es", "").otherwise(F.col("lang")).alias("route"), "source", F.when(F.col("source") != "src7", F.col("source")).alias("confidence"), F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("feedback"))


_FEEDBACK = """SELECT CASE WHEN lang = 'es' THEN 'UNKNOWN' ELSE lang END AS route, CASE WHEN source = 'src7' THEN 'unknown' ELSE source END AS confidence, quality
FROM labels JOIN documents USING (doc_id)"""


def daily_purchase_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each day's purchases in percent of those of the day with most."""
    return usage.percent_of_most(usage.daily_counts(table(spark, d, "events"), "purchase"))


def feedback_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return usage.feedback_summary(_feedback(spark, d))


def _event_feedback(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").where(F.col("event_type").isin("purchase", "error"))
    return events.select(F.col("event_id").alias("id"), "ts", "user_id", F.when(F.col("event_type") == "purchase", "positive").otherwise("negative").alias("feedback"))


def daily_feedback_pivot(spark: SparkSession, d: str) -> DataFrame:
    return usage.daily_feedback(_event_feedback(spark, d))


def recent_negative(spark: SparkSession, d: str) -> DataFrame:
    return usage.latest_negative(_event_feedback(spark, d), 20).select("id", "ts", "user_id")


def visits_gap_120s(spark: SparkSession, d: str) -> DataFrame:
    return usage.visits(table(spark, d, "events"))


def visits_gap_1d(spark: SparkSession, d: str) -> DataFrame:
    return usage.visits(table(spark, d, "events"), "INTERVAL 1 DAY")


def active_users_as_of(spark: SparkSession, d: str) -> DataFrame:
    return usage.active_users(table(spark, d, "events"), "2024-01-30 23:00:00", 7200)


_VISITS = """WITH b AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL '{gap}' THEN 1 ELSE 0 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM b)
SELECT user_id, CAST(visit AS BIGINT) AS visit, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM n GROUP BY user_id, visit"""

QUERIES = {f.__name__: f for f in (daily_distinct_users, distinct_users_by_window, signup_users_by_window, top_views_by_json_key, top_clicks_by_json_key, purchase_totals, daily_purchases, daily_purchase_shares, feedback_grouping_sets, daily_feedback_pivot, recent_negative, visits_gap_120s, visits_gap_1d, active_users_as_of)}
_WINDOWS = """SELECT count(DISTINCT CASE WHEN ts >= date_trunc('day', TIMESTAMP '{0}') AND ts < date_trunc('day', TIMESTAMP '{0}') + INTERVAL 1 DAY THEN user_id END) AS today,
count(DISTINCT CASE WHEN ts >= TIMESTAMP '{0}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{0}' THEN user_id END) AS week, count(DISTINCT user_id) AS total FROM events"""
_TOP = "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE event_type = '{0}' AND props IS NOT NULL GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT {1}"
SQL = {
    "daily_distinct_users": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "distinct_users_by_window": _WINDOWS.format("2024-01-30 12:00:00"),
    "signup_users_by_window": _WINDOWS.format(AS_OF) + " WHERE event_type = 'signup'",
    "top_views_by_json_key": _TOP.format("view", 10),
    "top_clicks_by_json_key": _TOP.format("click", 20),
    "purchase_totals": "SELECT count(*) AS total, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS today FROM events WHERE event_type = 'purchase'",
    "daily_purchases": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1",
    "daily_purchase_shares": "WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT day, n, CAST(floor(100 * n / (SELECT max(n) FROM c) + 0.5) AS INTEGER) AS percent FROM c",
    "feedback_grouping_sets": f"""WITH f AS ({_FEEDBACK}), s AS (SELECT CASE grouping(route, confidence) WHEN 3 THEN 'total' WHEN 1 THEN 'route' ELSE 'confidence' END AS level, route, confidence,
count(*) FILTER (WHERE quality = 1) AS positive, count(*) FILTER (WHERE quality = 0) AS negative FROM f GROUP BY GROUPING SETS ((route), (confidence), ()))
SELECT *, CAST(CASE WHEN positive + negative > 0 THEN round_even(100.0 * positive / (positive + negative), 0) ELSE 0 END AS INTEGER) AS rate FROM s""",
    "daily_feedback_pivot": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'purchase') AS positive, count(*) FILTER (WHERE event_type = 'error') AS negative FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1",
    "recent_negative": "SELECT event_id AS id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "visits_gap_120s": _VISITS.format(gap="120 seconds"),
    "visits_gap_1d": _VISITS.format(gap="1 day"),
    "active_users_as_of": """SELECT user_id, max(ts) AS last_ts, CAST(floor(epoch(TIMESTAMP '2024-01-30 23:00:00')) - floor(epoch(max(ts))) AS BIGINT) AS elapsed FROM events WHERE ts <= TIMESTAMP '2024-01-30 23:00:00' GROUP BY user_id
HAVING max(ts) >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 7200 SECOND""",
}

"""Chat histories over `conversations`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conversation
from .tables import table


def history_last_turns(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_messages(table(spark, d, "conversations"), 4)


def last_user_turn(spark: SparkSession, d: str) -> DataFrame:
    return conversation.last_user_message(table(spark, d, "conversations"))


def fallback_query(spark: SparkSession, d: str) -> DataFrame:
    return conversation.fallback_queries(table(spark, d, "conversations"))


def prompt_history(spark: SparkSession, d: str) -> DataFrame:
    return conversation.prompt_history(table(spark, d, "conversations"), 400)


def _active(spark: SparkSession, d: str) -> DataFrame:
    """Turns dealt over the minutes before noon."""
    minutes = (F.col("conv_id") * 7 + F.col("turn")) % 120
    return table(spark, d, "conversations").select("conv_id", (F.lit("2024-01-31 12:00:00").cast("timestamp_ntz") - F.make_dt_interval(mins=minutes.cast("int"))).alias("at"))


def kept_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversation.kept_conversations(_active(spark, d), F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"), 50).select("conv_id", F.date_format("last_active", "HH:mm").alias("last_active"))


QUERIES = {f.__name__: f for f in (history_last_turns, last_user_turn, fallback_query, prompt_history, kept_conversations)}
_LAST = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= {0}"
SQL = {
    "history_last_turns": _LAST.format(4),
    "last_user_turn": "SELECT conv_id, max_by(text, turn) FILTER (WHERE role = 'user') AS text FROM conversations GROUP BY conv_id",
    "fallback_query": """WITH u AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, text FROM conversations WHERE role = 'user'),
w AS (SELECT *, list_filter(list_filter(string_split_regex(trim(previous), '\\s+'), lambda x: x <> ''), lambda x: NOT list_contains(string_split_regex(trim(text), '\\s+'), x)) AS kept FROM u)
SELECT conv_id, turn, CASE WHEN coalesce(len(kept), 0) > 0 THEN array_to_string(kept, ' ') || ' ' || text ELSE text END AS query FROM w""",
    "prompt_history": f"""WITH l AS ({_LAST.format(10)}), j AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS text FROM l GROUP BY conv_id),
t AS (SELECT *, right(text, 400) AS tail FROM j)
SELECT conv_id, CASE WHEN length(text) > 400 THEN CASE WHEN contains(tail, chr(10)) THEN substring(tail, instr(tail, chr(10)) + 1) ELSE tail END ELSE text END AS history FROM t""",
    "kept_conversations": """WITH a AS (SELECT conv_id, max(TIMESTAMP '2024-01-31 12:00:00' - to_minutes((conv_id * 7 + turn) % 120)) AS at_ts FROM conversations GROUP BY conv_id)
SELECT conv_id, strftime(at_ts, '%H:%M') AS last_active FROM a WHERE at_ts >= TIMESTAMP '2024-01-31 11:00:00' ORDER BY at_ts DESC, conv_id LIMIT 50""",
}

"""Chat histories: the turns that a model sees, follow-up queries, and which conversations stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS, CAP, STORED, IDLE_MINUTES = 5, 50, 100, 60


def last_messages(messages: DataFrame, n: int = 2 * TURNS) -> DataFrame:
    """The last n messages of each conversation."""
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_back", F.row_number().over(late)).where(F.col("_back") <= n).drop("_back")


def last_user_message(messages: DataFrame) -> DataFrame:
    """conv_id and the text of its latest user turn; null without one."""
    return messages.groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("text"))


def follow_up(previous: Column, question: Column) -> Column:
    """The words of the previous question that the new one lacks, in order and with repeats, then the new one."""
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    kept = F.filter(words(previous), lambda w: ~F.array_contains(words(question), w))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.concat(F.array_join(kept, " "), F.lit(" "), question)).otherwise(question)


def fallback_queries(messages: DataFrame) -> DataFrame:
    """conv_id, turn and the query of each user turn, filled up from the user turn before it."""
    users = messages.where(F.col("role") == "user")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return users.select("conv_id", "turn", before.alias("previous"), "text").select("conv_id", "turn", follow_up(F.col("previous"), F.col("text")).alias("query"))


def kept_conversations(messages: DataFrame, now: Column, most: int = STORED, idle_minutes: int = IDLE_MINUTES) -> DataFrame:
    """The `most` conversations used last, of those not idle for longer. messages: conv_id, at."""
    used = messages.groupBy("conv_id").agg(F.max("at").alias("last_active"))
    return used.where(F.col("last_active") >= now - F.expr(f"INTERVAL {idle_minutes} MINUTES")).orderBy(F.desc("last_active"), "conv_id").limit(most)


def prompt_history(messages: DataFrame, budget: int) -> DataFrame:
    """conv_id and the transcript of the last turns; the tail of a longer one, cut at a line."""
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"))
    joined = last_messages(messages).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    tail = F.substring("text", -budget, budget)
    cut = F.when(F.contains(tail, F.lit("\n")), F.substring(tail, F.instr(tail, "\n") + 1, F.length(tail))).otherwise(tail)
    return joined.select("conv_id", F.when(F.length("text") > budget, cut).otherwise(F.col("text")).alias("history"))


def prompt_context(hits: DataFrame, budget: int = 8000, least: int = 500) -> DataFrame:
    """query_id and its passages, each cut to an equal share of the budget but no less than `least`."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    share = F.greatest(F.floor(F.lit(budget) / n), F.lit(least)).cast("int")
    cut = hits.select("query_id", "rank", F.substring("content", F.lit(1), share).alias("content"))
    return cut.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("context"))

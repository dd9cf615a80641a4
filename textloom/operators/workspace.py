"""A user's documents: highlights, folders, translated pages, sessions, batches of conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_score, memo_snippet, snippet

MOST_PAGES = 5


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not ended, with their user."""
    return sessions.where(F.col("expires_at") > now).join(users, sessions.user_id == users.id).select("token", "username", "role", "expires_at")


def has_role(role: Column, least: str, roles: tuple[str, ...] = ("viewer", "editor", "admin")) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in roles]), role) > roles.index(least)


def page_range(text: Column, pages: Column, most: int = MOST_PAGES) -> Column:
    """The pages of '3' or '3-7'; null for other text, more than `most`, or pages that a document has not."""
    first, last = F.regexp_extract(text, r"^\s*(\d+)\s*(?:-\s*\d+\s*)?$", 1), F.regexp_extract(text, r"^\s*\d+\s*-\s*(\d+)\s*$", 1)
    a = F.nullif(first, F.lit("")).cast("int")
    b = F.coalesce(F.nullif(last, F.lit("")).cast("int"), a)
    return F.when((a >= 1) & (b >= a) & (b <= pages) & (b - a < most), F.sequence(F.least(a, b), F.greatest(a, b)))


def enriched(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with how many of their pages (doc_id, page, status) there are and are done."""
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "done").alias("done"))
    return documents.join(counts, "doc_id", "left").fillna(0, ["pages", "done"])


def page_overlay(stored: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status of each page: that of a job in flight (doc_id, first, last, status) before the stored one."""
    active = jobs.select("doc_id", F.explode(F.sequence("first", "last")).alias("page"), F.col("status").alias("active"))
    latest = active.groupBy("doc_id", "page").agg(F.max("active").alias("active"))
    return stored.join(latest, ["doc_id", "page"], "full").select("doc_id", "page", F.coalesce("active", "status").alias("status"))


def without_range(stored: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages that no cancelled range covers."""
    return stored.join(ranges.select("doc_id", F.explode(F.sequence("first", "last")).alias("page")), ["doc_id", "page"], "left_anti")


def memo_search(highlights: DataFrame, terms: list[str]) -> DataFrame:
    """Highlights that hold any of the terms in memo or text."""
    both = F.lower(F.concat_ws(" ", "memo", "text"))
    hit = F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(both, t))
    return highlights.where(hit).select("doc_id", "id", "page", memo_snippet(F.col("memo"), F.col("text")).alias("snippet"))


def memos_and_pages(highlights: DataFrame, pages: DataFrame, terms: list[str], most: int = 20) -> DataFrame:
    """One answer of two kinds: the first `most` highlights that hold a term (by doc_id and id), and the `most` best pages.

    highlights: doc_id, id, page, memo, text; pages: doc_id, title, page, text. A page scores 10 for each term in its title
    and one for each time that a term stands in its text. Gives kind, place in its kind, doc_id, page, id (null for
    pages), score (null for memos), snippet, and total, how many rows the answer has."""
    memos = memo_search(highlights, terms).orderBy("doc_id", "id").limit(most)
    array, text = F.array(*[F.lit(t.lower()) for t in terms]), F.coalesce("text", F.lit(""))
    score = count_score(F.coalesce("title", F.lit("")), text, array)
    found = pages.select("doc_id", "page", score.alias("score"), snippet(text, F.lit(terms[0])).alias("snippet")).where("score > 0").orderBy(F.desc("score"), "doc_id", "page").limit(most)
    place = lambda *order: F.row_number().over(Window.orderBy(*order))  # noqa: E731  - of `most` rows
    both = memos.select(F.lit("memo").alias("kind"), place("doc_id", "id").alias("place"), "doc_id", "page", "id", F.lit(None).cast("bigint").alias("score"), "snippet").unionByName(
        found.select(F.lit("page").alias("kind"), place(F.desc("score"), "doc_id", "page").alias("place"), "doc_id", "page", F.lit(None).cast(highlights.schema["id"].dataType).alias("id"), "score", "snippet"))
    return both.join(F.broadcast(both.agg(F.count("*").alias("total"))))


def by_page(highlights: DataFrame) -> DataFrame:
    """doc_id, page and the ids of its highlights in order of creation."""
    return highlights.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"]).alias("ids")).orderBy("doc_id", "page")


def unfiled(documents: DataFrame) -> DataFrame:
    return documents.where(F.coalesce("folder", F.lit("")) == "")


def titled(hits: DataFrame, titles: DataFrame) -> DataFrame:
    """Hits with the title that a user gave, where there is one."""
    return hits.join(titles.select("doc_id", F.col("title").alias("_given")), "doc_id", "left").withColumn("title", F.coalesce("_given", "title")).drop("_given")


def batch_summary(results: DataFrame) -> DataFrame:
    """One row of totals over converted files."""
    return results.agg(F.count("*").alias("files"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"), F.coalesce(F.sum("paragraphs"), F.lit(0)).alias("paragraphs"), F.coalesce(F.sum("tables"), F.lit(0)).alias("tables"))


def structure_profile(paragraphs: DataFrame) -> DataFrame:
    """Counts of a document's parts (doc_id, kind, level, style) and warnings about its headings."""
    h1 = F.count_if((F.col("kind") == "heading") & (F.col("level") == 1))
    counts = paragraphs.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("paragraph", "table", "image", "heading")], h1.alias("h1"), F.sort_array(F.collect_set("style")).alias("styles"))
    return counts.withColumn("warning", F.when(F.col("h1") == 0, "no h1").when(F.col("h1") > 1, "several h1"))


def sequence_numbers(fields: DataFrame) -> DataFrame:
    """Numbers of SEQ fields (doc_id, category, pos, explicit): the explicit one, or one more than the counter, which an
    explicit number raises and never lowers. What the counter is ahead of the fields without a number only grows."""
    own = Window.partitionBy("doc_id", "category").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = fields.withColumn("n", F.count_if(F.col("explicit").isNull()).over(own).cast("int"))
    ahead = F.greatest(F.coalesce(F.max(F.col("explicit") - F.col("n")).over(own), F.lit(0)), F.lit(0))
    return counted.withColumn("number", F.coalesce("explicit", ahead + F.col("n"))).drop("n")


def nearest_figure(nodes: DataFrame, reach: int = 3) -> DataFrame:
    """For each node (doc_id, pos, kind) the nearest figure within `reach` siblings, the one before on a tie."""
    own = Window.partitionBy("doc_id").orderBy("pos")
    near = []
    for d in range(1, reach + 1):
        for side in (F.lag, F.lead):
            near.append(F.when(side("kind", d).over(own) == "figure", side("pos", d).over(own)))
    return nodes.withColumn("figure", F.coalesce(*near))

"""Retrieval for many questions at once, each by its own route.

A route decides which searches a question needs: none (CHAT), one (SIMPLE), one for each part (COMPARE), or a search for
each step that a planner asks for (REASON). All searches that can run together are one batch, keyed by question and
part, so a leg's index is read once for a batch and not for each question. Questions whose planner is satisfied leave
the frontier; the loop ends after `most` batches or when nobody is left.

A leg takes (queries of query_id and text, depth) and gives query_id, doc_id, score and rank; query_id may be a struct.
Planners, decomposers and scorers are arguments: functions on columns or frames, so they run on executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stored
from . import rag
from .search import DEDUP_CHARS, HIT_CHARS, RERANK_FACTOR, Corpus, bm25, corpus_of, filter_or_all, lexical_scorer, parts_of_query

SUMMARY_DOCS, SUMMARY_CHARS, SHORTEST_PART, LONGEST_PART = 5, 100, 3, 200
Leg = Callable[[DataFrame, int], DataFrame]
Scorer = Callable[[Column, Column], Column]


def keyword_leg(items: DataFrame, corpus: Corpus | None = None) -> Leg:
    """BM25 over items; the corpus is measured once for all batches."""
    known = corpus or corpus_of(items)
    return lambda queries, depth: bm25(items, queries, depth, corpus=known)


def metadata_condition(filters: dict[str, str | None], meta: Column, path: Column, by_path: str = "doc_category") -> Column:
    """Whether a hit has the wanted metadata. Empty wishes don't count; a hit without metadata is judged by its path alone,
    which must begin with the wish for `by_path`."""
    wishes = {key: value for key, value in filters.items() if value}
    known = F.coalesce(F.size(F.map_keys(meta)) > 0, F.lit(False))
    wanted = F.lit(True)
    for key, value in wishes.items():
        other = F.coalesce(F.startswith(path, F.lit(value)), F.lit(False)) if key == by_path else F.lit(True)
        wanted = wanted & F.when(known, F.coalesce(F.element_at(meta, key), F.lit("")) == value).otherwise(other)
    return wanted


def once(hits: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """The first hit of each key among those whose content begins alike."""
    same = Window.partitionBy(key, F.substring(F.coalesce("content", F.lit("")), 1, DEDUP_CHARS)).orderBy(*order)
    return hits.withColumn("_nth", F.row_number().over(same)).where("_nth = 1").drop("_nth")


def retrieve(leg: Leg, items: DataFrame, queries: DataFrame, deepest: int, scorer: Scorer = lexical_scorer, condition: Column | None = None) -> DataFrame:
    """What one batch of queries finds: query_id, rank, score and the items' columns, content cut to HIT_CHARS.

    queries: query_id, text, k and reranked. A reranked query fetches RERANK_FACTOR times k and is put in the scorer's
    order. Hits that begin alike count once, after the cut; then those that meet the condition stay, or all if none does."""
    fetch = F.col("k") * F.when(F.col("reranked"), RERANK_FACTOR).otherwise(1)
    # hits meet the items first: beside them they are few, and Spark knows their size
    hits = leg(queries.select("query_id", "text"), deepest * RERANK_FACTOR).join(items.withColumn("content", F.substring("content", 1, HIT_CHARS)), "doc_id")
    full = hits.join(queries, "query_id").where(F.col("rank") <= fetch)
    new = F.when(F.col("reranked"), F.round(scorer(F.col("text"), F.concat_ws("\n", "title", "content")), 6))
    scored = full.withColumn("_new", new)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("_new", F.lit(0.0))), "rank", "doc_id")
    ranked = scored.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= F.col("k"))
    found = once(ranked.withColumns({"score": F.coalesce("_new", "score"), "rank": F.col("_at")}).drop("_new", "_at", "text", "k", "reranked"), "query_id", ["rank"])
    return found if condition is None else filter_or_all(found, condition)


def merged(hits: DataFrame, questions: DataFrame, k: int, always: Column, scorer: Scorer = lexical_scorer) -> DataFrame:
    """Hits of several searches for each question as one list `place`: those that begin alike once, the k best by the
    scorer's view of the question where `always` holds or there are more than k, else in the order of part and rank.
    hits: query_id, part, rank, title, content and more; questions: query_id, text."""
    first = once(hits, "query_id", ["part", "rank"]).join(questions.select("query_id", "text"), "query_id")
    many = F.count("*").over(Window.partitionBy("query_id")) > k
    new = F.when(always | many, F.round(scorer(F.col("text"), F.concat_ws("\n", "title", "content")), 6))
    scored = first.withColumn("_new", new)
    best = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("_new", F.lit(0.0))), "part", "rank", "doc_id")
    placed = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    return placed.withColumn("score", F.coalesce("_new", "score")).drop("_new", "text")


def plan_of(reply: Column) -> Column:
    """A planner's reply as a struct of sufficient and query: its JSON, alone or in a fence; else by its words, where
    "insufficient" or no such word means that more is wanted."""
    shape = "sufficient boolean, query string"
    text = F.trim(reply)
    bare = F.from_json(F.regexp_extract(text, r"(?s)^(\{.*\})", 1), shape)
    fenced = F.from_json(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), shape)
    low = F.lower(text)
    lacking = F.contains(low, F.lit("insufficient")) | F.contains(low, F.lit("not sufficient"))
    by_words = F.struct(
        F.coalesce(~lacking & F.contains(low, F.lit("sufficient")), F.lit(False)).alias("sufficient"),
        F.when(lacking, F.regexp_extract(text, r'"query"\s*:\s*"([^"]*)"', 1)).otherwise("").alias("query"))
    valid = lambda s: s["sufficient"].isNotNull() | s["query"].isNotNull()
    chosen = F.when(valid(bare), bare).when(valid(fenced), fenced).otherwise(by_words)
    return F.struct(F.coalesce(chosen["sufficient"], F.lit(False)).alias("sufficient"), F.trim(F.coalesce(chosen["query"], F.lit(""))).alias("query"))


def summaries(collected: DataFrame) -> DataFrame:
    """query_id, found and a summary of the first SUMMARY_DOCS hits for a planner's prompt."""
    order = Window.partitionBy("query_id").orderBy("part", "rank")
    line = F.concat(F.col("n").cast("string"), F.lit(". ["), F.coalesce("title", F.lit("?")), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), 1, SUMMARY_CHARS), F.lit("..."))
    few = collected.withColumn("n", F.row_number().over(order))
    lines = F.collect_list(F.when(F.col("n") <= SUMMARY_DOCS, F.struct("n", line.alias("line"))))
    return few.groupBy("query_id").agg(F.count("*").alias("found"), F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("summary"))


def agent(questions: DataFrame, items: DataFrame, leg: Leg, planner: Callable[[DataFrame], DataFrame], k: int, most: int = rag.MOST_STEPS, scorer: Scorer = lexical_scorer) -> tuple[DataFrame, DataFrame]:
    """Searches as a planner asks, for all questions (query_id, text) at once.

    planner: a frame of query_id, text, step, found and summary with one column more, `reply`; see plan_of. Each batch's
    frontier and new hits are written, so a planner's model is asked once and lost executors repeat no step. A question
    without any hit is searched as it stands. Gives the k hits of each question (query_id, place, part, items' columns)
    and its log (query_id, steps, search_queries)."""
    spark = questions.sparkSession
    asked: DataFrame | None = None
    collected: DataFrame | None = None
    open_ones = questions.select("query_id", "text")
    for step in range(most):
        known = summaries(collected) if collected is not None else questions.select("query_id", F.lit(0).cast("bigint").alias("found"), F.lit("").alias("summary")).where("false")
        seen = open_ones.join(known, "query_id", "left").select("query_id", "text", F.lit(step).alias("step"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("summary", F.lit("")).alias("summary"))
        plan = planner(seen).select("query_id", "text", "step", plan_of(F.col("reply")).alias("plan"))
        wish = stored.written(plan.select("query_id", "text", "step", F.when(~F.col("plan.sufficient") & (F.col("plan.query") != ""), F.col("plan.query")).alias("query")), "agent-plan")
        asked = wish if asked is None else asked.unionByName(wish)
        open_ones = wish.where("query is not null").select("query_id", "text")
        if open_ones.isEmpty():
            break
        batch = wish.where("query is not null").select("query_id", F.col("query").alias("text"), F.lit(k).alias("k"), F.lit(False).alias("reranked"))
        new = retrieve(leg, items, batch, k, scorer).withColumn("part", F.lit(step))
        both = new if collected is None else collected.unionByName(new)
        collected = stored.written(once(both, "query_id", ["part", "rank"]), "agent-hits")
    log = asked.groupBy("query_id").agg((F.max("step") + 1).alias("steps"), F.transform(F.array_sort(F.collect_list(F.when(F.col("query").isNotNull(), F.struct("step", "query")))), lambda x: x["query"]).alias("search_queries"))
    bare = questions.select("query_id", "text", F.lit(k).alias("k"), F.lit(True).alias("reranked"))
    if collected is not None:
        bare = bare.join(collected.select("query_id"), "query_id", "left_anti")
    bare = stored.written(bare, "agent-bare")
    log = log.join(bare.select("query_id", F.col("text").alias("_own")), "query_id", "left").select("query_id", "steps", F.when(F.col("_own").isNotNull(), F.concat("search_queries", F.array("_own"))).otherwise(F.col("search_queries")).alias("search_queries"))
    rest = retrieve(leg, items, bare, k, scorer).withColumn("part", F.lit(most))
    hits = rest if collected is None else collected.unionByName(rest)
    return merged(hits, questions, k, F.lit(False), scorer), log.unionByName(questions.join(log, "query_id", "left_anti").select("query_id", F.lit(0).alias("steps"), F.array().cast("array<string>").alias("search_queries")))


def parts_column(parts: Column, question: Column) -> Column:
    """Up to MOST_PARTS of a decomposer's parts of 3 to 200 characters; the question itself if fewer than two are left."""
    good = F.slice(F.filter(F.transform(parts, F.trim), lambda p: F.length(p).between(SHORTEST_PART, LONGEST_PART)), 1, rag.MOST_PARTS)
    return F.when(F.size(good) > 1, good).otherwise(F.array(question))


def routed(questions: DataFrame, items: DataFrame, leg: Leg, decompose: Callable[[Column], Column], planner: Callable[[DataFrame], DataFrame], k: int = 5, scorer: Scorer = lexical_scorer, pages: DataFrame | None = None, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The context of each question and what is known of the search, by its route.

    questions: query_id, text, search_text (rewritten from the history) and reply of a classifier. pages: query_id and
    the items' columns of a page that stands in where nothing was found. Gives (query_id, route, place, items' columns,
    score) and (query_id, route, confidence, reasoning_steps, search_queries, hits). Confidence counts what was found."""
    q = stored.written(questions.withColumn("route", rag.route(F.col("text"), F.col("reply"))).drop("reply"), "routed-questions")
    direct = q.where(F.col("route").isin("SIMPLE", "COMPARE")).withColumn("parts", F.when(F.col("route") == "COMPARE", parts_column(decompose(F.col("search_text")), F.col("search_text"))).otherwise(F.array("search_text")))
    n = F.size("parts")
    tasks = direct.select("query_id", (n > 1).alias("several"), F.when(n > 1, F.greatest(F.lit(3), F.floor(F.lit(k) / n) + 1)).otherwise(k).cast("int").alias("k"), F.posexplode("parts").alias("part", "part_text"))
    keyed = tasks.select(F.struct("query_id", "part", "several").alias("query_id"), F.col("part_text").alias("text"), "k", (~F.col("several")).alias("reranked"))
    found = retrieve(leg, items, keyed, max(k, parts_of_query(k, 2)), scorer, condition).select(F.col("query_id.query_id").alias("_q"), F.col("query_id.part").alias("part"), F.col("query_id.several").alias("several"), "*").drop("query_id").withColumnRenamed("_q", "query_id")
    found = stored.written(found, "routed-hits")
    one = found.where("not several").withColumn("place", F.col("rank")).drop("several")
    several = merged(found.where("several").drop("several"), q, k, F.lit(True), scorer)
    reasoned, log = agent(q.where("route = 'REASON'").select("query_id", "text"), items, leg, planner, k, scorer=scorer)
    context = stored.written(one.unionByName(several, allowMissingColumns=True).unionByName(reasoned, allowMissingColumns=True), "routed-context")
    counts = context.groupBy("query_id").agg(F.count("*").alias("hits"))
    own = q.join(log, "query_id", "left").join(counts, "query_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    answers = own.select(
        "query_id", "route", F.when(F.col("route") == "CHAT", "high").otherwise(rag.confidence(F.col("route"), hits)).alias("confidence"),
        F.when(F.col("route") == "CHAT", 0).when(F.col("route") == "REASON", F.col("steps")).otherwise(1).alias("reasoning_steps"),
        F.when(F.col("route") == "CHAT", F.array().cast("array<string>")).when(F.col("route") == "REASON", F.col("search_queries")).otherwise(F.array("search_text")).alias("search_queries"), hits.alias("hits"))
    named = context.join(q.select("query_id", "route"), "query_id")
    if pages is not None:
        empty = q.where("route <> 'CHAT'").select("query_id", "route").join(context.select("query_id"), "query_id", "left_anti")
        named = named.unionByName(pages.join(empty, "query_id").withColumn("place", F.lit(1)), allowMissingColumns=True)
    return named, answers

"""Routed retrieval over `documents` for every item of `benchmark`, with plain stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing
from .search import _POSTED, _TOKENS, _bm25_sql, _sql
from .tables import ITEMS_SQL, QUESTIONS_SQL, items, questions

K = 5
ENOUGH = 8  # hits that satisfy the stand-in planner


def _sentences(text: Column) -> Column:
    return F.split(text, r"\. ")


def _reply(text: Column) -> Column:
    """Stands in for a classifier: no comma is chat; one sentence is simple, two compare, more want reasoning."""
    n = F.size(_sentences(text))
    return F.when(~F.contains(text, F.lit(",")), "It is CHAT.").when(n == 1, "simple").when(n == 2, "COMPARE: two things").otherwise("reason")


def planner(seen: DataFrame) -> DataFrame:
    """Stands in for a planning model: asks for the question's sentences in turn until it has seen ENOUGH hits."""
    wish = F.to_json(F.struct((F.col("found") >= ENOUGH).alias("sufficient"), F.get(_sentences(F.col("text")), F.col("step")).alias("query")))
    return seen.withColumn("reply", F.concat(F.lit("```json\n"), wish, F.lit("\n```")))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", "text", F.col("text").alias("search_text"), _reply(F.col("text")).alias("reply"))


def _routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = items(spark, d)
    return routing.routed(asked(spark, d), docs, routing.keyword_leg(docs), _sentences, planner, K)


def routed_search(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)[0].select("query_id", "route", "place", "doc_id", "title", F.round("score", 6).alias("score"))


def routed_answers(spark: SparkSession, d: str) -> DataFrame:
    return _routed(spark, d)[1].select("query_id", "route", "confidence", "reasoning_steps", F.array_join("search_queries", " | ").alias("search_queries"), "hits")


def agent_search(spark: SparkSession, d: str) -> DataFrame:
    """Every question by the agent, whatever its route."""
    docs = items(spark, d)
    hits, log = routing.agent(questions(spark, d), docs, routing.keyword_leg(docs), planner, K)
    return hits.join(log, "query_id").select("query_id", "place", "doc_id", "part", "steps", F.size("search_queries").alias("searches"))


_SCORE = f"""CASE WHEN len(list_distinct({_TOKENS.format("{0}")})) > 0 THEN round(len(list_filter(list_distinct({_TOKENS.format("{0}")}), lambda x: list_contains({_TOKENS.format("title || chr(10) || content")}, x))) / len(list_distinct({_TOKENS.format("{0}")})), 6) ELSE 0.0 END"""
_ROUTES = """routed AS (SELECT query_id, text, string_split(text, '. ') AS s, CASE WHEN NOT contains(text, ',') THEN 'CHAT' WHEN len(string_split(text, '. ')) = 1 THEN 'SIMPLE' WHEN len(string_split(text, '. ')) = 2 THEN 'COMPARE' ELSE 'REASON' END AS route FROM questions)"""
_SHORT = "short AS (SELECT doc_id, title, substring(content, 1, 1600) AS content, substring(content, 1, 200) AS head FROM items)"


def _agent_sql(who: str, chosen: str) -> str:
    """CTEs up to {who}_best(query_id, place, doc_id, title, part, score) and {who}_log(query_id, steps, queries); chosen: a
    condition on routed. Hits of all sentences are found, then kept as far as the planner asks for them."""
    return f"""{who}_tasks AS (SELECT query_id * 10 + step AS query_id, s[step + 1] AS text FROM routed, (VALUES (0), (1), (2)) x(step) WHERE {chosen} AND coalesce(s[step + 1], '') <> '' AND trim(s[step + 1]) <> ''),
{_bm25_sql(who + "_tasks", K, name="_" + who)},
{who}_all AS (SELECT query_id // 10 AS q, query_id % 10 AS step, rank, doc_id, title, content, head, score FROM hits_{who} JOIN short USING (doc_id)),
{who}_own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, step, head ORDER BY rank) AS n FROM {who}_all) WHERE n = 1),
{who}_once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, head ORDER BY step, rank) AS nth FROM {who}_own) WHERE nth = 1),
{who}_open AS (SELECT r.query_id AS q, x.step, coalesce((SELECT count(*) FROM {who}_once o WHERE o.q = r.query_id AND o.step < x.step), 0) AS found, r.query_id * 10 + x.step IN (SELECT query_id FROM {who}_tasks) AS wished FROM routed r, (VALUES (0), (1), (2)) x(step) WHERE {chosen}),
{who}_runs AS (SELECT q, step, wished AND found < {ENOUGH} AS goes, coalesce(bool_and(wished AND found < {ENOUGH}) OVER (PARTITION BY q ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reached FROM {who}_open),
{who}_got AS (SELECT o.* FROM {who}_once o JOIN {who}_runs r ON r.q = o.q AND r.step = o.step AND r.goes AND r.reached),
{who}_bare AS (SELECT query_id, text FROM routed WHERE {chosen} AND query_id NOT IN (SELECT q FROM {who}_got)),
{_bm25_sql(who + "_bare", 3 * K, name="_" + who + "_bare")},
{who}_rest AS (SELECT q, 3 AS step, place AS rank, doc_id, title, content, head, score FROM (SELECT *, row_number() OVER (PARTITION BY q, head ORDER BY place) AS n FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank, doc_id) AS place FROM (
SELECT b.query_id AS q, rank, doc_id, title, content, head, {_SCORE.format("text")} AS score FROM hits_{who}_bare JOIN short USING (doc_id) JOIN {who}_bare b USING (query_id))) WHERE place <= {K}) WHERE n = 1),
{who}_both AS (SELECT q, step, rank, doc_id, title, content, score FROM {who}_got UNION ALL SELECT q, step, rank, doc_id, title, content, score FROM {who}_rest),
{who}_scored AS (SELECT b.*, count(*) OVER (PARTITION BY q) > {K} AS many, {_SCORE.format("text")} AS new FROM {who}_both b JOIN routed r ON r.query_id = q),
{who}_best AS (SELECT * FROM (SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN many THEN new ELSE 0 END DESC, step, rank, doc_id) AS place, doc_id, title, step AS part, CASE WHEN many THEN new ELSE score END AS score FROM {who}_scored) WHERE place <= {K}),
{who}_log AS (SELECT r.q AS query_id, max(r.step) FILTER (WHERE reached) + 1 AS steps, list_concat(coalesce(list(s[r.step + 1] ORDER BY r.step) FILTER (WHERE goes AND reached), []), CASE WHEN r.q IN (SELECT query_id FROM {who}_bare) THEN [any_value(text)] ELSE [] END) AS queries FROM {who}_runs r JOIN routed USING (query_id) GROUP BY r.q)""".replace("USING (query_id) GROUP BY r.q", "ON routed.query_id = r.q GROUP BY r.q")  # fmt: skip


_DIRECT = f"""direct AS (SELECT query_id, text, route, CASE WHEN route = 'COMPARE' AND len(list_filter(s, lambda p: length(trim(p)) BETWEEN 3 AND 200)) > 1 THEN list_transform(list_filter(s, lambda p: length(trim(p)) BETWEEN 3 AND 200), lambda p: trim(p))[1:3] ELSE [text] END AS parts FROM routed WHERE route IN ('SIMPLE', 'COMPARE')),
tasks AS (SELECT query_id * 10 + unnest(range(len(parts))) AS query_id, unnest(parts) AS text FROM direct),
{_bm25_sql("tasks", 3 * K)},
found AS (SELECT d.query_id AS q, d.text, len(parts) AS n, h.query_id % 10 AS part, h.rank, h.score, doc_id, title, content, head FROM hits h JOIN direct d ON d.query_id = h.query_id // 10 JOIN short USING (doc_id)),
single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, head ORDER BY place) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY new DESC, rank, doc_id) AS place FROM (SELECT *, {_SCORE.format("text")} AS new FROM found WHERE n = 1)) WHERE place <= {K}) WHERE nth = 1),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, part, head ORDER BY rank) AS m FROM found WHERE n > 1 AND rank <= greatest(3, {K} // n + 1)) WHERE m = 1),
several AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY new DESC, part, rank, doc_id) AS place FROM (SELECT *, {_SCORE.format("text")} AS new FROM (SELECT *, row_number() OVER (PARTITION BY q, head ORDER BY part, rank) AS nth FROM cut) WHERE nth = 1)),
context AS (SELECT q AS query_id, place, doc_id, title, new AS score FROM single UNION ALL SELECT q, place, doc_id, title, new FROM several WHERE place <= {K} UNION ALL SELECT query_id, place, doc_id, title, score FROM why_best)"""
_ALL = (ITEMS_SQL, QUESTIONS_SQL, _POSTED, _SHORT, _ROUTES, _agent_sql("why", "route = 'REASON'"), _DIRECT)

QUERIES = {f.__name__: f for f in (routed_search, routed_answers, agent_search)}
SQL = {
    "routed_search": _sql(*_ALL, select="SELECT query_id, route, CAST(place AS INTEGER) AS place, doc_id, title, round(score, 6) AS score FROM context JOIN routed USING (query_id)"),
    "routed_answers": _sql(*_ALL, "counted AS (SELECT query_id, count(*) AS n FROM context GROUP BY query_id), known AS (SELECT r.*, coalesce(c.n, 0) AS hits FROM routed r LEFT JOIN counted c USING (query_id))",
        select="""SELECT query_id, route, CASE WHEN route = 'CHAT' OR hits >= CASE WHEN route = 'COMPARE' THEN 3 ELSE 2 END THEN 'high' WHEN hits > 0 THEN 'medium' ELSE 'low' END AS confidence,
CAST(CASE route WHEN 'CHAT' THEN 0 WHEN 'REASON' THEN steps ELSE 1 END AS INTEGER) AS reasoning_steps, CASE route WHEN 'CHAT' THEN '' WHEN 'REASON' THEN array_to_string(queries, ' | ') ELSE text END AS search_queries, hits FROM known LEFT JOIN why_log USING (query_id)"""),
    "agent_search": _sql(ITEMS_SQL, QUESTIONS_SQL, _POSTED, _SHORT, _ROUTES, _agent_sql("all", "true"), select="SELECT query_id, CAST(place AS INTEGER) AS place, doc_id, CAST(part AS INTEGER) AS part, CAST(steps AS INTEGER) AS steps, CAST(len(queries) AS INTEGER) AS searches FROM all_best JOIN all_log USING (query_id)"),
}

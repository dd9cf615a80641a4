"""Retrieval over `documents` and `embeddings` with the queries of `benchmark`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import stored
from ..functions import text as T
from ..operators import evaluation, search
from .tables import ITEMS_SQL, QUESTIONS_SQL, items, questions, table, vectors

TERMS = ["ther", "onen", "heer"]
K = 10


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(items(spark, d), questions(spark, d), K).select("query_id", "doc_id", "score", "rank")


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    one = items(spark, d).limit(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit("the reention onthe worthless").alias("text"))
    return search.bm25(items(spark, d), one, 20).select("doc_id", "score", "rank")


def analyser():
    """Stands in for a morphological analyser: runs of ASCII letters are nouns, runs of digits numbers, all else symbols."""
    import re

    pattern = re.compile(r"[a-z]+|[0-9]+|[^a-z0-9\s]+", re.I)
    return lambda text: [(m, "N" if m[0].isascii() and m[0].isalpha() else "SN" if m[0].isdecimal() else "SY") for m in pattern.findall(text)]


def bm25_analysed(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over the forms that an analyser gives, nouns alone."""
    return search.bm25(items(spark, d), questions(spark, d), K, tokens=search.analysed(analyser, {"N"})).select("query_id", "doc_id", "score", "rank")


def corpus_statistics(spark: SparkSession, d: str) -> DataFrame:
    return search.lengths(items(spark, d)).select("n", F.round("avgdl", 6).alias("avgdl"))


def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(items(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def naive_search(spark: SparkSession, d: str) -> DataFrame:
    return search.presence_search(items(spark, d), TERMS, 50)


def page_term_count_search(spark: SparkSession, d: str) -> DataFrame:
    return search.page_search(items(spark, d), TERMS, 50)


def whole_query_search(spark: SparkSession, d: str) -> DataFrame:
    return search.whole_query_search(items(spark, d), " Onen ").select("doc_id", "title")


def client_snippets(spark: SparkSession, d: str) -> DataFrame:
    found = items(spark, d).where(F.contains(F.lower("content"), F.lit("tion")))
    snippet = T.snippet(F.col("content"), F.lit("tion"), 50, 100, 150, "...", True)
    return found.select("doc_id", snippet.alias("snippet"), T.highlight(snippet, "tion").alias("marked"))


def knn_batch(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    asked = v.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    return search.knn(v, asked, K).select("query_id", "doc_id", "score", "rank")


def knn_search(spark: SparkSession, d: str) -> DataFrame:
    query = [((i * 37) % 17 - 8) / 32 for i in range(64)]
    return search.knn_one(vectors(spark, d), query, 30, 0.3)


def _vector_questions(spark: SparkSession, d: str) -> DataFrame:
    """Question i goes with vector i."""
    return questions(spark, d).join(vectors(spark, d).withColumnRenamed("doc_id", "query_id"), "query_id")


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return search.hybrid(items(spark, d), vectors(spark, d), _vector_questions(spark, d), 15).select("query_id", "doc_id", "score", "rank")


def hybrid_reranked(spark: SparkSession, d: str) -> DataFrame:
    return search.search(items(spark, d), vectors(spark, d), _vector_questions(spark, d), "hybrid", 5).select("query_id", "doc_id", "title", "score", "rank")


def keyword_filtered(spark: SparkSession, d: str) -> DataFrame:
    out = search.search(items(spark, d), None, questions(spark, d), "keyword", 5, F.col("lang") == "fr", reranked=False)
    return out.select("query_id", "doc_id", "lang", "score", "rank")


def filtered_or_all(spark: SparkSession, d: str) -> DataFrame:
    hits = search.bm25(items(spark, d), questions(spark, d), K).join(items(spark, d).select("doc_id", "lang"), "doc_id")
    return search.filter_or_all(hits, F.col("lang") == "de").select("query_id", "doc_id", "lang")


def prefix_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return search.first_of_prefix(items(spark, d), None, [F.col("doc_id")]).select("doc_id", "title")


def decomposed_search(spark: SparkSession, d: str) -> DataFrame:
    """Each question in two halves of its words, answered apart and joined."""
    words = F.split("text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    halves = questions(spark, d).select("query_id", F.posexplode(F.array(F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))).alias("part", "text"))
    keyed = halves.select((F.col("query_id") * 2 + F.col("part")).alias("query_id"), "text")
    depth = search.parts_of_query(K, 2)
    hits = search.bm25(items(spark, d), keyed, depth).select(F.floor(F.col("query_id") / 2).alias("query_id"), (F.col("query_id") % 2).alias("part"), "rank", "doc_id")
    return search.decomposed(hits.join(items(spark, d).select("doc_id", "content"), "doc_id"), K).select("query_id", "doc_id", "part", "place")


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Cases: a question is answered by documents that hold its text; one without such a document is negative."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    asked, corpus = questions(spark, d), search.corpus_of(items(spark, d))
    keyword = search.bm25(items(spark, d), asked, K, corpus=corpus).withColumn("mode", F.lit("bm25"))
    naive = search.top(search.bm25(items(spark, d), asked, 50, k1=0.0, corpus=corpus).select("query_id", "doc_id", "score"), K).withColumn("mode", F.lit("binary"))
    hits = keyword.unionByName(naive, allowMissingColumns=True).select("mode", F.col("query_id").alias("case_id"), "doc_id", "rank")
    results = hits.join(items(spark, d).select("doc_id", "content"), "doc_id").join(bench, "case_id").select("mode", "case_id", "rank", F.contains("content", "text").alias("correct"))
    cases = bench.select("case_id", F.concat(F.lit("length-"), F.floor(F.length("text") / 100).cast("string")).alias("category"), F.lit(False).alias("negative"))
    return evaluation.score_cases(results, cases, K, ["bm25", "binary"])


def recall_mrr_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_evaluated(spark, d))


LEAST_SHARE = 0.6  # of a question's words that a hit must hold to be shown


def _shown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Reranked hits that hold LEAST_SHARE of a question's words, with a section (language/source/id) and a url; the
    sections and urls that are right, those of documents with the question's text: by the whole section where the id is
    even, else by language and source; a url where three divides it. A question that stands in no document is negative."""
    docs, bench = items(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")
    section = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string"))
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    corpus = search.corpus_of(docs)
    hits = search.search(docs, None, questions(spark, d), "keyword", K, corpus=corpus).where(F.col("score") >= LEAST_SHARE)
    results = hits.select(F.lit("reranked").alias("mode"), F.col("query_id").alias("case_id"), "rank", section.alias("section"), url.alias("url"))
    wide = search.bm25(docs, questions(spark, d), 50, corpus=corpus).select(F.col("query_id").alias("case_id"), "doc_id").join(docs.select("doc_id", "content", "lang", "source"), "doc_id").join(bench, "case_id")
    right = stored.written(wide.where(F.contains("content", "text")).select("case_id", "doc_id", "lang", "source"), "right")  # read three times
    prefix = F.when(F.col("doc_id") % 2 == 0, section).otherwise(F.concat_ws("/", "lang", "source"))
    sections = right.select("case_id", prefix.alias("prefix"))
    urls = right.where("doc_id % 3 = 0").select("case_id", url.alias("url"))
    cases = bench.select("case_id").join(right.select("case_id").distinct().withColumn("_found", F.lit(True)), "case_id", "left")
    cases = cases.select("case_id", F.when(F.col("_found"), "positive").otherwise("negative").alias("category"), F.col("_found").isNull().alias("negative"))
    return results, sections, urls, cases


def expected_sections(spark: SparkSession, d: str) -> DataFrame:
    """Which shown results are right, by prefixes of several lengths and by urls."""
    results, sections, urls, _ = _shown(spark, d)
    return evaluation.matched(results, sections, urls).select("case_id", "rank", "section", "url", "correct")


def negative_cases(spark: SparkSession, d: str) -> DataFrame:
    """Hits and reciprocal ranks, negative cases among them: those are right with nothing to show."""
    results, sections, urls, cases = _shown(spark, d)
    return evaluation.score_cases(evaluation.matched(results, sections, urls), cases, K, ["reranked"]).select("case_id", "category", "hit", F.round("rr", 6).alias("rr"))


def exclusive_wins(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.exclusive_wins(_evaluated(spark, d), "bm25", "binary")


_TOKENS = "list_filter(string_split_regex(trim(lower({0})), '\\s+'), lambda x: length(x) >= 2)"
_POSTED = f"""toks AS (SELECT doc_id, {_TOKENS.format("title")} AS t, {_TOKENS.format("content")} AS c FROM items),
listed AS (SELECT doc_id, list_concat(t, list_concat(t, list_concat(t, c))) AS tokens FROM toks),
posted AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM listed WHERE len(tokens) > 0) GROUP BY doc_id, term),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT doc_id, any_value(dl) AS dl FROM posted GROUP BY doc_id)),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM posted, stats GROUP BY term, n),
idf AS (SELECT term, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw)"""


def _bm25_sql(asked: str, k: int, k1: float = 1.5, name: str = "") -> str:
    """CTEs up to hits{name}(query_id, doc_id, score, rank); asked: a table of query_id, text."""
    return f"""asked{name} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format("text")}) AS term FROM {asked}) GROUP BY query_id, term),
scored{name} AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM asked{name} JOIN idf USING (term) JOIN posted USING (term), stats GROUP BY query_id, doc_id),
hits{name} AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored{name} WHERE score > 0) WHERE rank <= {k})"""


def _sql(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


_NEAR = """near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(1 / (1 + round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9)), 9) AS score
FROM embeddings q, embeddings v WHERE {0})) WHERE rank <= {1})"""
_FUSED = """fused AS (SELECT query_id, doc_id, round(sum(part), 6) AS score FROM (SELECT query_id, doc_id, 0.3 / (60 + rank) AS part FROM hits UNION ALL SELECT query_id, doc_id, (1 - 0.3) / (60 + rank) FROM near) GROUP BY query_id, doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {0})"""
_ASKED_VECTORS = "q.vec_id IN (SELECT item_id FROM benchmark)"
_WITH_VECTOR = "vq AS (SELECT * FROM questions WHERE query_id IN (SELECT vec_id FROM embeddings))"
_PRESENT = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(content), '{t}') THEN 1 ELSE 0 END" for t in TERMS)
_COUNTED = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 10 ELSE 0 END + CAST((length(content) - length(replace(lower(content), '{t}', ''))) // {len(t)} AS BIGINT)" for t in TERMS)
_SNIPPET = """CASE WHEN pos > 0 THEN (CASE WHEN greatest(1, pos - {b}) > 1 THEN '...' ELSE '' END) || substring(content, greatest(1, pos - {b}), least(length(content), pos - 1 + {n} + {a}) - greatest(1, pos - {b}) + 1) || (CASE WHEN least(length(content), pos - 1 + {n} + {a}) < length(content) THEN '...' ELSE '' END) ELSE substring(content, 1, {h}) END"""
_EVALUATED = _sql(
    ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", K), _bm25_sql("questions", 50, 0.0, "2"),
    f"""runs AS (SELECT 'bm25' AS mode, query_id AS case_id, doc_id, rank FROM hits UNION ALL SELECT 'binary', query_id, doc_id, rank FROM hits2 WHERE rank <= {K}),
results AS (SELECT mode, case_id, min(CASE WHEN contains(d.text, b.text) THEN rank END) AS first FROM runs JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = case_id GROUP BY mode, case_id),
scored_cases AS (SELECT m.mode, b.item_id AS case_id, 'length-' || CAST(length(b.text) // 100 AS VARCHAR) AS category, CASE WHEN first IS NULL THEN 0 ELSE 1 END AS hit, coalesce(1 / first, 0.0) AS rr FROM benchmark b CROSS JOIN (VALUES ('bm25'), ('binary')) m(mode) LEFT JOIN results r ON r.mode = m.mode AND r.case_id = b.item_id)""", select="{}")  # fmt: skip

_SHOWN = (
    ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", 3 * K), _bm25_sql("questions", 50, name="_wide"),
    f"""r AS (SELECT query_id, doc_id, lang, source, rank, list_distinct({_TOKENS.format("q.text")}) AS qt, {_TOKENS.format("title || chr(10) || substring(content, 1, 1600)")} AS pt FROM hits JOIN items USING (doc_id) JOIN questions q USING (query_id)),
s AS (SELECT *, CASE WHEN len(qt) > 0 THEN round(len(list_filter(qt, lambda x: list_contains(pt, x))) / len(qt), 6) ELSE 0.0 END AS score FROM r),
shown AS (SELECT query_id AS case_id, n AS rank, lang || '/' || source || '/' || doc_id AS section, 'doc/' || doc_id AS url FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS n FROM s) WHERE n <= {K} AND score >= {LEAST_SHARE}),
fits AS (SELECT query_id AS case_id, d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN lang || '/' || source || '/' || d.doc_id ELSE lang || '/' || source END AS prefix FROM hits_wide h JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = h.query_id WHERE contains(d.text, b.text)),
marked AS (SELECT *, EXISTS (SELECT 1 FROM fits f WHERE f.case_id = shown.case_id AND starts_with(shown.section, f.prefix)) OR EXISTS (SELECT 1 FROM fits f WHERE f.case_id = shown.case_id AND f.doc_id % 3 = 0 AND 'doc/' || f.doc_id = shown.url) AS correct FROM shown)""")  # fmt: skip

QUERIES = {f.__name__: f for f in (expected_sections, negative_cases, bm25_analysed, bm25_batch, bm25_search, corpus_statistics, document_frequencies, naive_search, page_term_count_search, whole_query_search, client_snippets, knn_batch, knn_search, rrf_hybrid, hybrid_reranked, keyword_filtered, filtered_or_all, prefix_dedup_first, decomposed_search, recall_mrr_by_mode, exclusive_wins)}
_LIST_QUERY = "[" + ", ".join(str(((i * 37) % 17 - 8) / 32) for i in range(64)) + "]::DOUBLE[]"
SQL = {
    "bm25_batch": _sql(ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", K), select="SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits"),
    "bm25_search": _sql(ITEMS_SQL, "one AS (SELECT CAST(0 AS BIGINT) AS query_id, 'the reention onthe worthless' AS text)", _POSTED, _bm25_sql("one", 20), select="SELECT doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits"),
    "bm25_analysed": re.sub(r"list_filter\(string_split_regex\(trim\(lower\((\w+)\)\).*?>= 2\)", r"regexp_extract_all(lower(\1), '[a-z]+')", _sql(ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", K), select="SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits")),
    "corpus_statistics": _sql(ITEMS_SQL, _POSTED, select="SELECT n, round(avgdl, 6) AS avgdl FROM stats"),
    "document_frequencies": _sql(ITEMS_SQL, _POSTED, select="SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM posted GROUP BY term"),
    "naive_search": _sql(ITEMS_SQL, select=f"SELECT doc_id, score FROM (SELECT doc_id, {_PRESENT} AS score FROM items) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"),
    "page_term_count_search": _sql(
        ITEMS_SQL, select=f"SELECT doc_id, score, {_SNIPPET.format(a=60, b=60, n=4, h=120)} AS snippet FROM (SELECT *, {_COUNTED} AS score, instr(lower(content), '{TERMS[0]}') AS pos FROM items) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50"),
    "whole_query_search": _sql(ITEMS_SQL, select="SELECT doc_id, title FROM items WHERE contains(lower(title), 'onen') OR contains(lower(content), 'onen')"),
    "client_snippets": _sql(
        ITEMS_SQL, f"s AS (SELECT doc_id, {_SNIPPET.format(a=100, b=50, n=4, h=150)} AS snippet FROM (SELECT *, instr(lower(content), 'tion') AS pos FROM items) WHERE pos > 0)",
        select="SELECT doc_id, snippet, regexp_replace(replace(replace(replace(replace(snippet, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(?i)(tion)', '<mark>\\1</mark>', 'g') AS marked FROM s"),
    "knn_batch": _sql(_NEAR.format("q.vec_id % 20 = 0", K), select="SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM near"),
    "knn_search": f"""SELECT * FROM (SELECT vec_id AS doc_id, round(1 / (1 + list_sum(list_transform(list_zip({_LIST_QUERY}, embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9) AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 30) WHERE score >= 0.3""",
    "rrf_hybrid": _sql(ITEMS_SQL, QUESTIONS_SQL, _WITH_VECTOR, _POSTED, _bm25_sql("vq", 30), _NEAR.format(_ASKED_VECTORS, 30), _FUSED.format(15), select="SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM best"),
    "hybrid_reranked": _sql(
        ITEMS_SQL, QUESTIONS_SQL, _WITH_VECTOR, _POSTED, _bm25_sql("vq", 30), _NEAR.format(_ASKED_VECTORS, 30), _FUSED.format(15),
        f"""r AS (SELECT query_id, doc_id, title, rank, list_distinct({_TOKENS.format("q.text")}) AS qt, {_TOKENS.format("title || chr(10) || substring(content, 1, 1600)")} AS pt FROM best JOIN items USING (doc_id) JOIN questions q USING (query_id)),
s AS (SELECT *, CASE WHEN len(qt) > 0 THEN round(len(list_filter(qt, lambda x: list_contains(pt, x))) / len(qt), 6) ELSE 0.0 END AS score FROM r)""",
        select="SELECT query_id, doc_id, title, score, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, doc_id) AS n FROM s) WHERE n <= 5"),
    "keyword_filtered": _sql(
        ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", 10), "m AS (SELECT h.*, lang, count(*) FILTER (WHERE lang = 'fr') OVER (PARTITION BY query_id) AS matched FROM hits h JOIN items USING (doc_id))",
        select="SELECT query_id, doc_id, lang, score, CAST(rank AS INTEGER) AS rank FROM m WHERE (lang = 'fr' OR matched = 0) AND rank <= 5"),
    "filtered_or_all": _sql(
        ITEMS_SQL, QUESTIONS_SQL, _POSTED, _bm25_sql("questions", K), "m AS (SELECT h.*, lang, count(*) FILTER (WHERE lang = 'de') OVER (PARTITION BY query_id) AS matched FROM hits h JOIN items USING (doc_id))",
        select="SELECT query_id, doc_id, lang FROM m WHERE lang = 'de' OR matched = 0"),
    "prefix_dedup_first": _sql(ITEMS_SQL, select="SELECT doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY substring(content, 1, 200) ORDER BY doc_id) AS n FROM items) WHERE n = 1"),
    "decomposed_search": _sql(
        ITEMS_SQL, QUESTIONS_SQL,
        "w AS (SELECT query_id, string_split(text, ' ') AS w FROM questions), halves AS (SELECT query_id * 2 AS query_id, array_to_string(w[1:(len(w) + 1) // 2], ' ') AS text FROM w UNION ALL SELECT query_id * 2 + 1, array_to_string(w[(len(w) + 1) // 2 + 1:], ' ') FROM w)",
        _POSTED, _bm25_sql("halves", 6),
        "p AS (SELECT query_id // 2 AS query_id, query_id % 2 AS part, rank, doc_id, content FROM hits JOIN items USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, substring(content, 1, 200) ORDER BY part, rank) AS nth FROM p), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS place FROM o WHERE nth = 1)",
        select=f"SELECT query_id, doc_id, part, CAST(place AS INTEGER) AS place FROM n WHERE place <= {K}"),
    "expected_sections": _sql(*_SHOWN, select="SELECT case_id, CAST(rank AS INTEGER) AS rank, section, url, correct FROM marked"),
    "negative_cases": _sql(*_SHOWN, """firsts AS (SELECT case_id, min(rank) FILTER (WHERE correct) AS first, count(*) AS n FROM marked GROUP BY case_id),
c AS (SELECT item_id AS case_id, item_id NOT IN (SELECT case_id FROM fits) AS negative FROM benchmark)""", select="""SELECT c.case_id, CASE WHEN negative THEN 'negative' ELSE 'positive' END AS category, CAST(CASE WHEN negative THEN CASE WHEN n IS NULL THEN 1 ELSE 0 END WHEN first IS NULL THEN 0 ELSE 1 END AS INTEGER) AS hit,
round(CASE WHEN negative THEN CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END ELSE coalesce(1 / first, 0.0) END, 6) AS rr FROM c LEFT JOIN firsts USING (case_id)"""),
    "recall_mrr_by_mode": _EVALUATED.format("SELECT mode, category, round(avg(hit), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS cases FROM scored_cases GROUP BY GROUPING SETS ((mode, category), (mode))"),
    "exclusive_wins": _EVALUATED.format("SELECT count(*) FILTER (WHERE a = 1 AND b = 0) AS only_first, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_second, count(*) FILTER (WHERE a = 1 AND b = 1) AS both, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM (SELECT case_id, max(CASE WHEN mode = 'bm25' THEN hit END) AS a, max(CASE WHEN mode = 'binary' THEN hit END) AS b FROM scored_cases GROUP BY case_id)"),
}

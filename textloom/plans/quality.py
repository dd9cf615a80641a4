"""Document checks over `documents`; lines are paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import emitters
from ..operators import validation
from .tables import table

FORBIDDEN = {"ther": "there", "onen": "one"}
GROUPS = [["tion", "ther", "onen"], ["elle", "eau"]]
MAX_CHARS = 120


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return validation.paragraphs_of(table(spark, d, "documents"))


def forbidden_term_hits(spark: SparkSession, d: str) -> DataFrame:
    return validation.forbidden_terms(_paragraphs(spark, d), "warning", FORBIDDEN).select("doc_id", "paragraph_index", "char_start", "char_end", "detail")


def lateral_term_hits(spark: SparkSession, d: str) -> DataFrame:
    """The same hits by a table function in SQL."""
    emitters.register(spark)
    lines = "SELECT d.doc_id, l.nth AS paragraph_index, l.line FROM {docs} d, LATERAL text_lines(d.text) l"
    terms = ", ".join(f"'{t}'" for t in FORBIDDEN)
    hits = spark.sql(f"SELECT p.doc_id, p.paragraph_index, h.* FROM ({lines}) p, LATERAL term_hits(p.line, array({terms})) h", docs=table(spark, d, "documents"))
    return hits.select("doc_id", F.col("paragraph_index").cast("bigint").alias("paragraph_index"), F.col("char_start").cast("bigint").alias("char_start"), F.col("char_end").cast("bigint").alias("char_end"), F.concat("term", F.lit(" > "), F.element_at(F.create_map(*[F.lit(x) for pair in FORBIDDEN.items() for x in pair]), F.col("term"))).alias("detail"))


def numbering_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as numbered headings: where a number doesn't follow the one before."""
    emitters.register(spark)
    number = F.concat_ws(".", (F.col("event_id") % 2 + 1).cast("string"), F.floor(F.col("value") / 4).cast("string"))
    headings = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), number.alias("number"))
    return spark.sql("SELECT * FROM numbering_gaps(TABLE({headings}))", headings=headings)


def term_preference(spark: SparkSession, d: str) -> DataFrame:
    return validation.preferred_terms(_paragraphs(spark, d), GROUPS).select("doc_id", "grp", "preferred", F.array_join(F.sort_array("others"), ",").alias("others"))


def long_sentences(spark: SparkSession, d: str) -> DataFrame:
    found = validation.sentence_length(_paragraphs(spark, d), "suggestion", MAX_CHARS)
    return found.select("doc_id", "paragraph_index", "char_start", "char_end")


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    rules = {"forbidden_terms": ("error", {"terms": {"worthless": "poor", "idiot": "person"}}), "sentence_length": ("suggestion", {"max_chars": 200})}
    docs = table(spark, d, "documents")
    return validation.scores(docs, validation.validate(_paragraphs(spark, d), rules))


def technical_issues(spark: SparkSession, d: str) -> DataFrame:
    return validation.validate(_paragraphs(spark, d), "technical")


QUERIES = {f.__name__: f for f in (forbidden_term_hits, lateral_term_hits, numbering_gaps, term_preference, long_sentences, document_scores, technical_issues)}
_PARAGRAPHS = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS paragraph_index FROM documents)"
_HITS = """s AS (SELECT doc_id, paragraph_index, term, string_split(text, term) AS parts, generate_subscripts(string_split(text, term), 1) AS i FROM p, (VALUES {0}) t(term) WHERE contains(text, term)),
h AS (SELECT doc_id, paragraph_index, term, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(term) AS BIGINT) AS pos FROM s WHERE i < len(parts))"""
_SENTENCES = r"""w AS (SELECT *, string_split(regexp_replace(text, '([.!?。])\s*', '\1' || chr(1), 'g'), chr(1)) AS parts FROM p),
q AS (SELECT doc_id, paragraph_index, text, parts, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM w),
l AS (SELECT doc_id, paragraph_index, text, trim(sentence) AS sentence, coalesce(CAST(list_sum(list_transform(parts[1:i - 1], lambda x: length(x))) AS BIGINT), 0) AS before FROM q)"""
SQL = {
    "forbidden_term_hits": f"WITH {_PARAGRAPHS}, {_HITS.format(', '.join(repr((t,)).replace(',)', ')') for t in FORBIDDEN))} SELECT doc_id, paragraph_index, pos AS char_start, pos + length(term) AS char_end, term || ' > ' || CASE term WHEN 'ther' THEN 'there' ELSE 'one' END AS detail FROM h",
    "term_preference": f"""WITH {_PARAGRAPHS}, {_HITS.format("('tion'), ('ther'), ('onen'), ('elle'), ('eau')")}, n AS (SELECT doc_id, term, count(*) AS n, CASE WHEN term IN ('elle', 'eau') THEN 1 ELSE 0 END AS grp, list_position(['tion', 'ther', 'onen', 'elle', 'eau'], term) AS place FROM h GROUP BY doc_id, term),
u AS (SELECT doc_id, grp, arg_max(term, n * 10 - place) AS preferred, list(term) AS terms FROM n GROUP BY doc_id, grp HAVING count(*) > 1)
SELECT doc_id, grp, preferred, array_to_string(list_sort(list_filter(terms, lambda x: x <> preferred)), ',') AS others FROM u""",
    "long_sentences": f"WITH {_PARAGRAPHS}, {_SENTENCES} SELECT doc_id, paragraph_index, place AS char_start, place + length(sentence) AS char_end FROM (SELECT *, before + instr(substring(text, before + 1), sentence) - 1 AS place FROM l) WHERE length(sentence) > {MAX_CHARS}",
    "document_scores": f"""WITH {_PARAGRAPHS}, {_HITS.format("('worthless'), ('idiot')")}, {_SENTENCES}, e AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM l WHERE length(sentence) > 200 GROUP BY doc_id)
SELECT d.doc_id, coalesce(e.n, 0) AS error, CAST(0 AS BIGINT) AS warning, coalesce(g.n, 0) AS suggestion, greatest(0, 100 - 10 * coalesce(e.n, 0) - coalesce(g.n, 0)) AS score FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN g USING (doc_id)""",
}
SQL["lateral_term_hits"] = SQL["forbidden_term_hits"]
SQL["numbering_gaps"] = """WITH n AS (SELECT user_id AS doc_id, event_id AS pos, event_id % 2 + 1 AS parent, CAST(floor(value / 4) AS BIGINT) AS own FROM events),
b AS (SELECT *, lag(parent) OVER w AS last_parent, lag(own) OVER w AS last_own FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, parent || '.' || own AS number, last_parent || '.' || last_own AS before FROM b WHERE parent = last_parent AND own <> last_own + 1"""

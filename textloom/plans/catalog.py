"""Glossary and menu over what the tables hold: abbreviations of `documents`, a tree of `pages` by host and language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary, trees
from .tables import table


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary of all lines of documents: abbr is the first word, en the rest, ko the language."""
    lines = table(spark, d, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    words = F.split("line", " ", 2)
    return lines.select((F.col("doc_id") * (1 << 24) + F.col("n")).alias("pos"), F.get(words, F.lit(0)).alias("abbr"), F.get(words, F.lit(1)).alias("en"), F.col("lang").alias("ko"))


_TERMS = """lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
terms AS (SELECT doc_id * 16777216 + n AS pos, trim(split_part(line, ' ', 1)) AS abbr, CASE WHEN contains(line, ' ') THEN substring(line, instr(line, ' ') + 1) END AS en, lang AS ko FROM lines)"""
_ONCE = "once AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY abbr, en ORDER BY pos) AS n FROM terms WHERE coalesce(abbr, '') <> '') WHERE n = 1)"
_LETTER = "CASE WHEN regexp_matches(upper(substring(abbr, 1, 1)), '^[A-Z]$') THEN upper(substring(abbr, 1, 1)) ELSE '#' END"


def glossary_import(spark: SparkSession, d: str) -> DataFrame:
    return glossary.in_order(glossary.distinct_first(_terms(spark, d)))


def letter_histogram(spark: SparkSession, d: str) -> DataFrame:
    return glossary.letter_histogram(glossary.distinct_first(_terms(spark, d)))


def glossary_filter(spark: SparkSession, d: str) -> DataFrame:
    return glossary.matches(glossary.distinct_first(_terms(spark, d)), "The")


def glossary_lookup(spark: SparkSession, d: str) -> DataFrame:
    return glossary.lookup(glossary.distinct_first(_terms(spark, d)), "the", 5)


def abbreviation_multimap(spark: SparkSession, d: str) -> DataFrame:
    return glossary.multimap(glossary.distinct_first(_terms(spark, d))).select("abbr", F.size("meanings").alias("n"), F.array_join("meanings", "|").alias("meanings"))


def abbreviation_join(spark: SparkSession, d: str) -> DataFrame:
    """Abbreviations of the texts; the glossary has those of all documents."""
    docs = table(spark, d, "documents")
    found = docs.select(F.col("doc_id").alias("pos"), F.explode(F.regexp_extract_all("text", F.lit(glossary.ABBREVIATION), F.lit(1))).alias("abbr"))
    terms = found.groupBy("abbr").agg(F.min("pos").alias("pos")).withColumn("en", F.concat(F.lit("of "), F.col("pos").cast("string")))
    return glossary.in_texts(docs, terms)


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """host > language > page; ids are 64-bit hashes of the path's text by md5."""
    p = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    ident = lambda c: F.conv(F.substring(F.md5(c), 1, 14), 16, 10).cast("bigint")
    none = F.lit(None)
    hosts = p.select("host").distinct().select(ident(F.col("host")).alias("id"), none.cast("bigint").alias("parent_id"), F.lit(0).cast("bigint").alias("pos"), F.col("host").alias("label"), none.cast("string").alias("url"))
    both = F.concat("host", F.lit("/"), "lang")
    langs = p.select("host", "lang").distinct().select(ident(both).alias("id"), ident(F.col("host")).alias("parent_id"), F.lit(0).cast("bigint").alias("pos"), F.col("lang").alias("label"), none.cast("string").alias("url"))
    leaves = p.select(F.col("page_id").alias("id"), ident(both).alias("parent_id"), F.col("page_id").alias("pos"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("label"), "url")
    return hosts.union(langs).union(leaves)


def menu_flatten(spark: SparkSession, d: str) -> DataFrame:
    return trees.breadcrumbs(trees.flatten(_nodes(spark, d)))


def section_counts(spark: SparkSession, d: str) -> DataFrame:
    return trees.counts_by_root(trees.flatten(_nodes(spark, d)))


def menu_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return trees.neighbours(trees.flatten(_nodes(spark, d)))


def menu_filter_keep_ancestors(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return trees.filtered(nodes, trees.flatten(nodes), "page 1").select("id", "label")


def menu_target_paths(spark: SparkSession, d: str) -> DataFrame:
    return trees.target_paths(trees.flatten(_nodes(spark, d)))


def menu_sections(spark: SparkSession, d: str) -> DataFrame:
    return trees.sections_with_children(_nodes(spark, d)).select("id", "label")


def next_sibling_order(spark: SparkSession, d: str) -> DataFrame:
    return trees.next_order(_nodes(spark, d).where("parent_id is not null").withColumn("ord", F.col("pos")))


def _outline(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as an outline: system on the first level, the user's on the second, answers on the third."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), level.alias("level"))


def outline_parents(spark: SparkSession, d: str) -> DataFrame:
    return trees.parents_by_level(_outline(spark, d))


def outline_spans(spark: SparkSession, d: str) -> DataFrame:
    return trees.until_next_heading(_outline(spark, d))


def menu_by_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every page by its path of labels, and by one with a language that its host may not have."""
    nodes = _nodes(spark, d)
    leaves = trees.flatten(nodes).where("depth = 3").select("id", "labels")
    other = F.array(F.get("labels", F.lit(0)), F.lit("de"), F.get("labels", F.lit(2)))
    paths = leaves.select((F.col("id") * 2).alias("path_id"), "labels").unionByName(leaves.select((F.col("id") * 2 + 1).alias("path_id"), other.alias("labels")))
    return trees.find_by_labels(nodes, paths).select("path_id", "id", "url")


def active_headings(spark: SparkSession, d: str) -> DataFrame:
    """Views as headings and purchases as places of a user's day: the last view at or before each purchase."""
    events = table(spark, d, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    views = events.where("event_type = 'view'").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), F.col("at").alias("offset"))
    return trees.active_headings(views, events.where("event_type = 'purchase'").select(F.col("user_id").alias("doc_id"), "at"))


QUERIES = {f.__name__: f for f in (menu_by_labels, active_headings, glossary_import, letter_histogram, glossary_filter, glossary_lookup, abbreviation_multimap, abbreviation_join, menu_flatten, section_counts, menu_neighbours, menu_filter_keep_ancestors, menu_target_paths, menu_sections, next_sibling_order, outline_parents, outline_spans)}
_ID = "CAST(('0x' || substring(md5({0}), 1, 14)) AS BIGINT)"
_NODES = f"""pg AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages),
nodes AS (SELECT DISTINCT {_ID.format("host")} AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(0 AS BIGINT) AS pos, host AS label, CAST(NULL AS VARCHAR) AS url FROM pg
UNION ALL SELECT DISTINCT {_ID.format("host || '/' || lang")}, {_ID.format("host")}, 0, lang, NULL FROM pg UNION ALL SELECT page_id, {_ID.format("host || '/' || lang")}, page_id, 'page ' || page_id, url FROM pg),
flat AS (SELECT id, url, label, [label] AS labels, id AS root, [{{'pos': pos, 'id': id}}] AS ord FROM nodes WHERE parent_id IS NULL
UNION ALL SELECT n.id, n.url, n.label, list_append(f.labels, n.label), f.root, list_append(f.ord, {{'pos': n.pos, 'id': n.id}}) FROM nodes n JOIN flat f ON n.parent_id = f.id)"""
_TREE = "WITH RECURSIVE " + _NODES + " "
_OUTLINE = "o AS (SELECT conv_id AS doc_id, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)"
SQL = {
    "menu_by_labels": _TREE + """, leaves AS (SELECT id, labels FROM flat WHERE len(labels) = 3), paths AS (SELECT id * 2 AS path_id, labels FROM leaves UNION ALL SELECT id * 2 + 1, [labels[1], 'de', labels[3]] FROM leaves),
named AS (SELECT labels, min_by(id, ord) AS id, min_by(url, ord) AS url FROM flat GROUP BY labels) SELECT path_id, id, url FROM paths JOIN named USING (labels)""",
    "active_headings": """WITH v AS (SELECT user_id AS doc_id, CAST(epoch_us(ts) AS DOUBLE) AS at_us, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT DISTINCT user_id AS doc_id, CAST(epoch_us(ts) AS DOUBLE) AS at_us FROM events WHERE event_type = 'purchase')
SELECT p.doc_id, p.at_us AS "at", v.id FROM p ASOF JOIN v ON p.doc_id = v.doc_id AND p.at_us >= v.at_us""",
    "glossary_import": f"WITH {_TERMS}, {_ONCE} SELECT pos, abbr, en, ko FROM once",
    "letter_histogram": f"WITH {_TERMS}, {_ONCE}, l AS (SELECT {_LETTER} AS letter, abbr, pos FROM once) SELECT letter, count(*) AS terms, array_to_string((list(abbr ORDER BY pos))[1:3], ', ') AS preview FROM l GROUP BY letter",
    "glossary_filter": f"WITH {_TERMS}, {_ONCE} SELECT pos, abbr, en, ko FROM once WHERE contains(lower(abbr), 'the') OR contains(lower(en), 'the') OR contains(ko, 'The')",
    "glossary_lookup": f"WITH {_TERMS}, {_ONCE} SELECT pos, abbr, en, ko, count(*) OVER () AS total FROM once WHERE contains(lower(abbr), 'the') OR contains(lower(en), 'the') OR contains(ko, 'the') ORDER BY lower(abbr) <> 'the', pos LIMIT 5",
    "abbreviation_multimap": f"WITH {_TERMS}, {_ONCE} SELECT upper(replace(abbr, 'ß', 'ss')) AS abbr, CAST(count(*) AS INTEGER) AS n, coalesce(string_agg(en, '|' ORDER BY pos), '') AS meanings FROM once WHERE length(abbr) >= 2 GROUP BY 1",
    "abbreviation_join": r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b([A-Z][A-Z0-9]+)\b', 1)) AS abbr FROM documents), g AS (SELECT abbr, 'of ' || min(doc_id) AS en FROM f GROUP BY abbr)
SELECT doc_id, abbr, count(*) AS n, any_value(en) AS en FROM f JOIN g USING (abbr) GROUP BY doc_id, abbr""",
    "menu_flatten": _TREE + "SELECT url, array_to_string(labels, ' > ') AS path FROM flat WHERE url IS NOT NULL",
    "section_counts": _TREE + "SELECT root, count(*) FILTER (WHERE url IS NOT NULL AND NOT starts_with(url, 'glossary:')) AS documents FROM flat GROUP BY root",
    "menu_neighbours": _TREE + "SELECT id, url, lag(url) OVER w AS before, lead(url) OVER w AS after FROM flat WHERE url <> '' WINDOW w AS (ORDER BY ord)",
    "menu_filter_keep_ancestors": _TREE + ", hit AS (SELECT id, ord FROM flat WHERE contains(label, 'page 1')), keep AS (SELECT DISTINCT unnest(list_transform(ord, lambda x: x.id)) AS id FROM hit) SELECT id, label FROM nodes WHERE id IN (SELECT id FROM keep)",
    "menu_target_paths": _TREE + "SELECT id, array_to_string(list_transform(labels, lambda x: replace(x, ' ', '-')), '/') || '/' || replace(label, ' ', '-') || '.html' AS path FROM flat",
    "menu_sections": _TREE + "SELECT id, label FROM nodes WHERE parent_id IS NULL AND id IN (SELECT parent_id FROM nodes)",
    "next_sibling_order": _TREE + "SELECT parent_id, max(pos) + 1 AS next FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "outline_parents": f"WITH {_OUTLINE} SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY a.doc_id, a.pos, a.level",
    "outline_spans": f"WITH {_OUTLINE} SELECT a.doc_id, a.pos, a.level, min(b.pos) AS until FROM o a LEFT JOIN o b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY a.doc_id, a.pos, a.level",
}

"""HTML pages over `pages`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import html_text, pages
from .tables import table


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return pages.titles(table(spark, d, "pages"))


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def page_index(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_items(table(spark, d, "pages"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """A page's paragraphs as titles, each whole."""
    parts = F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(parts).alias("pos", "title"))


def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    return pages.unique_ids(_paragraphs(spark, d))


def heading_slugs(spark: SparkSession, d: str) -> DataFrame:
    return pages.titles(table(spark, d, "pages")).select("page_id", T.slug(F.col("title")).alias("slug"))


def pretty_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.pretty_html(F.col("html")).alias("html"))


def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.escape_html(F.col("html")).alias("html"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.array_join(F.split(F.regexp_extract("url", "^[a-z]+://([^#?]+)", 1), "/"), " > ")
    return table(spark, d, "pages").select("page_id", T.short_url(F.col("url")).alias("name"), T.breadcrumb(path).alias("b")).select("page_id", "name", "b.*")


def section_split(spark: SparkSession, d: str) -> DataFrame:
    return pages.sections(table(spark, d, "pages"))


def section_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    paths = p.select("url", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("path"))
    return pages.section_items(p, paths, 800).select("page_id", "path", "title", "section_id", "chunk", "content")


def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """documents cut into chunks of paragraphs; a line is a paragraph."""
    content = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(pages.packed(content, 800)).alias("chunk", "content"))


def page_search_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html_text.html_text(F.col("html")).alias("text"))


def injected_ids(spark: SparkSession, d: str) -> DataFrame:
    return pages.inject_ids(table(spark, d, "pages"))


def empty_content_filter(spark: SparkSession, d: str) -> DataFrame:
    """Items to embed: those with content, as title twice and content."""
    items = pages.page_items(table(spark, d, "pages"), None).where(F.trim("content") != "")
    return items.select("page_id", F.concat_ws("\n", "title", "title", "content").alias("text"))


QUERIES = {f.__name__: f for f in (html_title, html_strip, page_index, slug_ids, heading_slugs, pretty_html, escaped_html, url_parts, section_split, section_index, chunk_pack, page_search_text, injected_ids, empty_content_filter)}


def _strip(column: str) -> str:
    text = f"regexp_replace({column}, '<[^>]+>', ' ', 'g')"
    for entity, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        text = f"replace({text}, '{entity}', '{raw}')"
    return rf"trim(regexp_replace({text}, '[ \t\n\r\f]+', ' ', 'g'))"


def _slug(column: str) -> str:
    made = rf"substring(lower(regexp_replace(trim(regexp_replace({column}, '[^a-zA-Z0-9_ \t\n\r\f\x{{AC00}}-\x{{D7A3}}-]', '', 'g')), '[ \t\n\r\f]+', '-', 'g')), 1, 50)"
    return f"CASE WHEN {made} = '' THEN 'section' ELSE {made} END"


_ITEM = f"SELECT page_id, url, coalesce({{t}}, url) AS title, substring({_strip('html')}, 1, {{n}}) AS content FROM pages"
_H1 = _strip("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
_TITLE = f"CASE WHEN regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>') THEN {_H1} END"
_BLOCK = "html|head|body|h1|h2|h3|h4|p|div|section|article|header|footer|nav|table|thead|tbody|tr|ul|ol|li"
_PACK = r"""c AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents),
s AS (SELECT doc_id, content, list_transform(string_split_regex(content, '\n\s*\n'), lambda p: {'done': []::VARCHAR[], 'now': p}) AS parts FROM c),
f AS (SELECT doc_id, content, list_reduce(list_prepend({'done': []::VARCHAR[], 'now': ''}, parts), lambda a, x: CASE WHEN length(a.now) + length(x.now) > 800 AND a.now <> '' THEN {'done': list_append(a.done, trim(a.now)), 'now': x.now}
WHEN a.now = '' THEN {'done': a.done, 'now': x.now} ELSE {'done': a.done, 'now': a.now || chr(10) || chr(10) || x.now} END) AS r FROM s),
g AS (SELECT doc_id, CASE WHEN length(content) <= 800 THEN [content] WHEN r.now <> '' THEN list_append(r.done, trim(r.now)) ELSE r.done END AS chunks FROM f)"""
SQL = {
    "chunk_pack": f"WITH {_PACK} SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk, unnest(chunks) AS content FROM g",
    "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_strip": f"SELECT page_id, {_strip('html')} AS text FROM pages",
    "page_index": _ITEM.format(t=_TITLE, n=5000),
    "slug_ids": f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1)) AS title, generate_subscripts(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), 1) - 1 AS pos FROM pages),
s AS (SELECT page_id, pos, {_slug('title')} AS slug FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, slug ORDER BY pos) - 1 AS nth FROM s)
SELECT page_id, CAST(pos AS INTEGER) AS pos, slug || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END AS section_id FROM n""",
    "heading_slugs": f"WITH t AS (SELECT page_id, {_TITLE} AS title FROM pages) SELECT page_id, {_slug('title')} AS slug FROM t",
    "pretty_html": rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)(<(?:{_BLOCK})(?: [^>]*)?>)', chr(10) || '\1', 'g'), '(?i)(</(?:{_BLOCK})>)', '\1' || chr(10), 'g'), '\n+', chr(10), 'g'), ' ') AS html FROM pages",
    "escaped_html": "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html FROM pages",
    "url_parts": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)/?$', 1), '\.html?$', '') AS name, list_filter(list_transform(string_split(regexp_extract(url, '^[a-z]+://([^#?]+)', 1), '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM pages)
SELECT page_id, name, coalesce(parts[1], '') AS doc_category, CAST(len(parts) AS INTEGER) AS depth, CASE WHEN len(parts) >= 3 THEN parts[len(parts) - 1] END AS parent_doc FROM p""",
    "empty_content_filter": f"WITH i AS ({_ITEM.replace("substring(", "(").replace(", 1, {n})", ")").format(t=_TITLE)}) SELECT page_id, title || chr(10) || title || chr(10) || content AS text FROM i WHERE trim(content) <> ''",
}

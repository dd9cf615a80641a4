"""Parts of documents: captions, numbers, ranges, references, folders, selections and streams of job states, over shapes
that the tables give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import stored
from ..functions import geometry
from ..functions import text as T
from ..operators import layout, toc, trees, validation, workspace
from ..sources.versions import Table
from .catalog import _TREE, _nodes
from .tables import table


def _marked() -> Column:
    """A part's name as a caption, a note, a heading, a line of contents or as it is."""
    kind, name = F.col("p_size") % 8, F.col("p_name")
    n, m = (F.col("p_size") % 12 + 1).cast("string"), (F.col("p_partkey") % 9 + 1).cast("string")
    made = [F.concat(F.lit("Figure "), n, F.lit("."), m, F.lit(": "), name), F.concat(F.lit("  table "), n, F.lit(") "), name), F.concat(F.lit("[CAUTION] "), name), F.concat(F.lit("note: "), name),
            F.concat(n, F.lit("."), m, F.lit(". "), name), F.concat(F.lit("("), n, F.lit(") "), name), F.concat(n, F.lit("."), m, F.lit(" "), name, F.lit(" ..... "), m)]
    out = F.when(kind == 0, made[0])
    for i, text in enumerate(made[1:], 1):
        out = out.when(kind == i, text)
    return out.otherwise(name)


_MARKED = """marked AS (SELECT p_partkey, p_size, CASE p_size % 8 WHEN 0 THEN 'Figure ' || n || '.' || m || ': ' || p_name WHEN 1 THEN '  table ' || n || ') ' || p_name WHEN 2 THEN '[CAUTION] ' || p_name WHEN 3 THEN 'note: ' || p_name
WHEN 4 THEN n || '.' || m || '. ' || p_name WHEN 5 THEN '(' || n || ') ' || p_name WHEN 6 THEN n || '.' || m || ' ' || p_name || ' ..... ' || m ELSE p_name END AS text FROM (SELECT *, p_size % 12 + 1 AS n, p_partkey % 9 + 1 AS m FROM part))"""


def text_marks(spark: SparkSession, d: str) -> DataFrame:
    """What the beginning of each text says it is: caption, note, number, heading by its size."""
    texts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), _marked().alias("text"))
    return texts.select("p_partkey", T.caption_id(F.col("text")).alias("caption_id"), T.special_block(F.col("text")).alias("block"), T.section_number(F.col("text")).alias("number"), T.heading_tag(F.lit(None).cast("string"), F.col("size")).alias("tag"), T.is_caption_like(F.col("text")).alias("caption_like"))


def contents_lines(spark: SparkSession, d: str) -> DataFrame:
    """Each text as a line of contents: its title, page, number and level, and the key by which headings are matched."""
    lines = table(spark, d, "part").select("p_partkey", T.toc_line(_marked()).alias("x"))
    return lines.select("p_partkey", "x.clean_text", "x.page_number", "x.numbering", "x.heading_level", T.match_key(F.col("x.clean_text")).alias("key"))


def _captioned(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as paragraphs: numbered headings, tables' captions, mentions of tables, and plain ones."""
    n = F.floor(F.col("value") / 3).cast("string")
    text = F.when(F.col("event_type") == "view", F.concat((F.col("event_id") % 3 + 1).cast("string"), F.lit("."), n, F.lit(". Heading"))).when(F.col("event_type") == "click", F.concat(F.lit("Table "), n, F.lit(": rows"))).when(F.col("event_type") == "purchase", F.concat(F.lit("as Table "), n, F.lit(" shows"))).otherwise("plain")
    return table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("paragraph_index"), text.alias("text"))


def structure_issues(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that don't follow, tables that are missing and tables that nothing speaks of."""
    rules = {"numbering_continuity": ("error", {}), "table_caption": ("warning", {"labels": ("표", "Table")})}
    return validation.validate(_captioned(spark, d), rules)


def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of tables whose caption the same user has."""
    texts = _captioned(spark, d).withColumn("ids", T.reference_ids(F.col("text")))
    captions = texts.select("doc_id", T.caption_id(F.col("text")).alias("caption_id")).where("caption_id is not null")
    return toc.resolve_references(texts.where(F.startswith("text", F.lit("as "))), captions, F.col("ids")).select("doc_id", "paragraph_index", "caption_id")


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The pages that a text asks for, of a document of so many, and whether the third is one of them."""
    text = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" "), F.col("turn").cast("string"))).when(F.col("turn") % 4 == 1, F.concat(F.col("turn").cast("string"), F.lit(" - "), (F.col("conv_id") % 9).cast("string"))).when(F.col("turn") % 4 == 2, F.concat(F.lit("1-"), F.col("turn").cast("string"))).otherwise("all")
    asked = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), (F.col("conv_id") % 7).cast("int").alias("pages"))
    return asked.select("conv_id", "turn", F.array_join(workspace.page_range(F.col("text"), F.col("pages")).cast("array<string>"), ",").alias("found"), F.coalesce(T.in_range(F.lit(3), F.col("text")), F.lit(False)).alias("third"))


def roles_and_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Who may edit, by role, and the address that a request came from."""
    role = F.when(F.col("event_type") == "purchase", "admin").when(F.col("event_type") == "click", "editor").when(F.col("event_type") == "view", "viewer").otherwise("nobody")
    forwarded = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" , 10.9.9.9"))).when(F.col("event_id") % 3 == 1, F.lit(""))
    return table(spark, d, "events").select("event_id", F.coalesce(workspace.has_role(role, "editor"), F.lit(False)).alias("may_edit"), T.client_address(forwarded, F.concat(F.lit("peer-"), F.col("user_id").cast("string"))).alias("address"))


def safe_paths(spark: SparkSession, d: str) -> DataFrame:
    """Links out of each page, resolved, and whether they stay among the contents."""
    base = F.concat(F.lit("contents/"), F.regexp_extract("url", r"^[a-z]+://(.*)$", 1))
    link = F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 6).cast("int")), F.lit("img/./x"), F.col("page_id").cast("string"), F.lit(".png"))
    resolved = T.resolve_url(base, link)
    return table(spark, d, "pages").select("page_id", resolved.alias("path"), T.is_content_path(resolved).alias("inside"), T.file_name(F.col("url")).alias("file_name"))


def menu_descendants(spark: SparkSession, d: str) -> DataFrame:
    """The documents under the first host."""
    flat = trees.flatten(_nodes(spark, d))
    first = flat.where("depth = 1").agg(F.min_by("id", "label")).first()[0]
    return trees.descendants(flat, first)


def siblings_swapped(spark: SparkSession, d: str) -> DataFrame:
    """The menu with the page of the least number moved down once."""
    nodes = _nodes(spark, d)
    first = nodes.where("url is not null").agg(F.min("id")).first()[0]
    return trees.swapped(nodes, first, 1).select("id", "parent_id", "pos")


def folder_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Folders and documents after the first host's folder has gone: what was in it hangs where that hung."""
    nodes = _nodes(spark, d)
    folders, documents = nodes.where("url is null").drop("url"), nodes.where("url is not null").select(F.col("id").alias("doc_id"), F.col("parent_id").alias("folder"))
    gone = folders.where("parent_id is null").agg(F.min_by("id", "label")).first()[0]
    left, moved = trees.remove_folder(folders, documents, gone)
    return left.select("id", "parent_id", F.lit("folder").alias("kind")).unionByName(moved.select(F.col("doc_id").alias("id"), F.col("folder").alias("parent_id"), F.lit("document").alias("kind")))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """A span for each number of an order: two to a line, four to a block."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"), F.max("l_partkey").alias("part"))
    number = F.col("l_linenumber") - 1
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.floor(number / 4).cast("int").alias("block"), F.floor(number % 4 / 2).cast("int").alias("line"), (number % 2).cast("int").alias("span"),
        F.concat(F.col("part").cast("string"), F.lit("w")).alias("text"), F.when(F.col("flag") == "R", 16).when(F.col("flag") == "A", 18).otherwise(2).alias("flags"), F.col("quantity").cast("double").alias("size"))


_SPANS = """spans AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1) // 4 AS block, (l_linenumber - 1) % 4 // 2 AS line, (l_linenumber - 1) % 2 AS span, max(l_partkey) || 'w' AS text, CASE max(l_returnflag) WHEN 'R' THEN 16 WHEN 'A' THEN 18 ELSE 2 END AS flags, CAST(max(l_quantity) AS DOUBLE) AS size FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


def block_texts(spark: SparkSession, d: str) -> DataFrame:
    return layout.block_texts(_spans(spark, d)).select("doc_id", "block", "text", "bold", "italic", "size")


def tagged_headings(spark: SparkSession, d: str) -> DataFrame:
    """Spans with the level of the heading of their order whose text is theirs: headings are the spans of large type."""
    spans = _spans(spark, d)
    headings = spans.where("size > 40").select("doc_id", "text", F.col("block").alias("level"), (F.col("block") * 4 + F.col("line") * 2 + F.col("span")).alias("pos"))
    return toc.tag_headings(spans.select("doc_id", "block", "line", "span", "text"), headings)


def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    """Where each order's contents stand: from the page that says so to the last one with dots before numbers."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"))
    text = F.when(F.col("flag") == "R", F.concat(F.lit("Contents of "), F.col("part").cast("string"))).when(F.col("flag") == "A", F.concat(F.lit("Part ..... "), F.col("part").cast("string"))).otherwise("text")
    return toc.toc_pages(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), text.alias("text")))


def selections(spark: SparkSession, d: str) -> DataFrame:
    """Boxes in percent of a page of 60 by 110, and whether they are selections of text."""
    box = F.struct((F.col("l_partkey") % 50).cast("double").alias("x"), (F.col("l_quantity") * 2).cast("double").alias("y"), (F.col("l_suppkey") % 20).cast("double").alias("w"), (F.col("l_tax") * 100).cast("double").alias("h"))
    rects = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.percent_rect(box, F.lit(60.0), F.lit(110.0)).alias("r"))
    return rects.select("l_orderkey", "l_linenumber", *[F.round(f"r.{c}", 6).alias(c) for c in "xywh"], geometry.is_selection(F.col("r")).alias("selection"))


def highlights_by_page(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).alias("page"), F.col("turn").alias("id"), (-F.col("turn")).alias("created_at"))
    return workspace.by_page(marks).select("doc_id", "page", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def own_titles(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a folder (source src1 has none), with the title that a label of high quality gives."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("source") != "src1", F.col("source")).alias("folder"), F.col("lang").alias("title"))
    titles = table(spark, d, "labels").where("quality = 1").select("doc_id", F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("title"))
    return workspace.titled(workspace.unfiled(docs), titles).select("doc_id", "title")


def conversion_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pages as converted files: one of an odd number has a warning, one of a multiple of five failed."""
    p = table(spark, d, "pages")
    results = p.select((F.col("page_id") % 5 != 0).alias("success"), F.when(F.col("page_id") % 2 == 1, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.length("html").alias("paragraphs"), F.size(F.regexp_extract_all("html", F.lit("<table"), F.lit(0))).alias("tables"))
    return workspace.batch_summary(results)


def latest_job_states(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each user's job by a stream over events, each written twice; equal changes count once."""
    from ..streaming import visits

    changes = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    twice = stored.written(changes.unionByName(changes), "changes")
    stream = spark.readStream.schema(twice.schema).parquet(twice.inputFiles()[0].rsplit("/", 1)[0])
    path = stored.shared_path(spark, "states")
    log = Table(spark, path)
    write = lambda batch, number: log.append_once(batch.withColumn("batch", F.lit(number)), "states", number)
    visits.latest_states(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    last = log.read().groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "batch")).alias("x"))
    return last.select("job_id", "x.status", F.col("x.ts").cast("timestamp_ntz").alias("ts"))


QUERIES = {f.__name__: f for f in (text_marks, contents_lines, structure_issues, resolved_references, page_ranges, roles_and_addresses, safe_paths, menu_descendants, siblings_swapped, folder_deleted, block_texts, tagged_headings, contents_pages, selections, highlights_by_page, own_titles, conversion_totals, latest_job_states)}
_CAPTIONED = """cap AS (SELECT user_id AS doc_id, event_id AS paragraph_index, CASE event_type WHEN 'view' THEN (event_id % 3 + 1) || '.' || n || '. Heading' WHEN 'click' THEN 'Table ' || n || ': rows' WHEN 'purchase' THEN 'as Table ' || n || ' shows' ELSE 'plain' END AS text, event_type AS kind, n, event_id % 3 + 1 AS top FROM (SELECT *, CAST(floor(value / 3) AS BIGINT) AS n FROM events))"""
SQL = {
    "text_marks": f"""WITH {_MARKED} SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 'fig-' || (p_size % 12 + 1) || '-' || (p_partkey % 9 + 1) WHEN 1 THEN 'tbl-' || (p_size % 12 + 1) END AS caption_id, CASE p_size % 8 WHEN 2 THEN 'caution' WHEN 3 THEN 'note' END AS block,
CASE p_size % 8 WHEN 4 THEN (p_size % 12 + 1) || '.' || (p_partkey % 9 + 1) WHEN 5 THEN CAST(p_size % 12 + 1 AS VARCHAR) END AS number, CASE WHEN p_size >= 20 THEN 'h1' WHEN p_size >= 16 THEN 'h2' WHEN p_size >= 14 THEN 'h3' ELSE 'p' END AS tag, p_size % 8 IN (0, 1) AND length(text) < 150 AS caption_like FROM marked""",
    "contents_lines": rf"""WITH {_MARKED}, c AS (SELECT p_partkey, CASE WHEN p_size % 8 = 6 THEN regexp_replace(text, ' \.\.\.\.\. \d+$', '') ELSE trim(text) END AS clean_text, CASE WHEN p_size % 8 = 6 THEN CAST(p_partkey % 9 + 1 AS INTEGER) END AS page_number, nullif(regexp_extract(trim(text), '^(\d+(\.\d+)*)\.?\s', 1), '') AS numbering FROM marked)
SELECT *, CAST(CASE WHEN numbering IS NULL THEN 1 ELSE least(len(string_split(numbering, '.')), 6) END AS INTEGER) AS heading_level, trim(regexp_replace(regexp_replace(lower(trim(clean_text)), '\s+', ' ', 'g'), '(\D)\s*\d+$', '\1')) AS key FROM c""",
    "structure_issues": f"""WITH {_CAPTIONED}, num AS (SELECT doc_id, paragraph_index, top, n, lag(top) OVER w AS last_top, lag(n) OVER w AS last_n FROM cap WHERE kind = 'view' WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_index)),
m AS (SELECT doc_id, paragraph_index, n, CASE kind WHEN 'click' THEN 0 ELSE 3 END AS s, length('Table ' || n) AS l FROM cap WHERE kind IN ('click', 'purchase')),
g AS (SELECT doc_id, n, count(*) AS mentions, min({{'p': paragraph_index, 's': s, 'e': s + l}}) AS one FROM m GROUP BY doc_id, n), b AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM g)
SELECT doc_id, 'numbering_continuity' AS rule_id, 'structure' AS category, 'error' AS severity, paragraph_index, CAST(0 AS BIGINT) AS char_start, CAST(length(top || '.' || n) + 1 AS BIGINT) AS char_end, last_top || '.' || last_n || ' > ' || top || '.' || n AS detail FROM num WHERE top = last_top AND n <> last_n + 1
UNION ALL SELECT doc_id, 'table_caption', 'structure', 'warning', one.p, one.s, one.e, 'Table missing: ' || (before + 1) FROM b WHERE n <> before + 1
UNION ALL SELECT m.doc_id, 'table_caption', 'structure', 'warning', paragraph_index, s, s + l, 'Table without reference: ' || m.n FROM m JOIN g ON g.doc_id = m.doc_id AND g.n = m.n WHERE mentions <= 1""",
    "resolved_references": f"WITH {_CAPTIONED} SELECT doc_id, paragraph_index, 'tbl-' || n AS caption_id FROM cap c WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM cap k WHERE k.kind = 'click' AND k.doc_id = c.doc_id AND k.n = c.n)",
    "page_ranges": """WITH a AS (SELECT conv_id, turn, conv_id % 7 AS pages, CASE WHEN turn % 4 = 3 THEN NULL WHEN turn % 4 = 2 THEN 1 ELSE turn END AS a, CASE turn % 4 WHEN 0 THEN turn WHEN 1 THEN conv_id % 9 WHEN 2 THEN turn END AS b FROM conversations)
SELECT conv_id, turn, CASE WHEN a >= 1 AND b >= a AND b <= pages AND b - a < 5 THEN array_to_string(range(a, b + 1), ',') END AS found, coalesce(3 BETWEEN a AND b, false) AS third FROM a""",
    "roles_and_addresses": "SELECT event_id, event_type IN ('purchase', 'click') AS may_edit, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 256) ELSE 'peer-' || user_id END AS address FROM events",
    "safe_paths": r"""WITH b AS (SELECT page_id, url, CAST(page_id % 6 AS INTEGER) AS ups, list_filter(string_split('contents/' || regexp_extract(url, '^[a-z]+://(.*)$', 1), '/'), lambda x: true) AS parts FROM pages),
r AS (SELECT page_id, url, ups, parts[1:len(parts) - 1] AS folder FROM b), k AS (SELECT *, folder[1:greatest(len(folder) - ups, 0)] AS kept, greatest(ups - len(folder), 0) AS over FROM r)
SELECT page_id, repeat('../', CAST(over AS INTEGER)) || array_to_string(list_append(list_append(kept, 'img'), 'x' || page_id || '.png'), '/') AS path, over = 0 AND len(kept) > 0 AS inside, translate(url, '<>:"/\|?*', '_________') AS file_name FROM k""",
    "menu_descendants": _TREE + "SELECT id, url FROM flat WHERE url IS NOT NULL AND root = (SELECT min_by(id, label) FROM flat WHERE len(labels) = 1)",
    "siblings_swapped": _TREE + """, one AS (SELECT min(id) AS id FROM nodes WHERE url IS NOT NULL), w AS (SELECT id, lead(id) OVER (PARTITION BY parent_id ORDER BY pos, id) AS other, pos, lead(pos) OVER (PARTITION BY parent_id ORDER BY pos, id) AS other_pos FROM nodes),
x AS (SELECT * FROM w WHERE id = (SELECT id FROM one)) SELECT n.id, n.parent_id, CASE WHEN x.other IS NOT NULL AND n.id = x.id THEN x.other_pos WHEN n.id = x.other THEN x.pos ELSE n.pos END AS pos FROM nodes n, x""",
    "folder_deleted": _TREE + ", gone AS (SELECT min_by(id, label) AS id FROM nodes WHERE parent_id IS NULL) SELECT n.id, CASE WHEN n.parent_id = g.id THEN NULL ELSE n.parent_id END AS parent_id, CASE WHEN url IS NULL THEN 'folder' ELSE 'document' END AS kind FROM nodes n, gone g WHERE n.id <> g.id",
    "block_texts": f"WITH {_SPANS} SELECT doc_id, CAST(block AS INTEGER) AS block, string_agg(text, ' ' ORDER BY line, span) AS text, bool_or(flags >= 16) AS bold, bool_or(flags % 16 = 2) AS italic, max(size) AS size FROM spans GROUP BY doc_id, block",
    "tagged_headings": f"""WITH {_SPANS}, h AS (SELECT doc_id, text, arg_max(block, block * 4 + line * 2 + span) AS level FROM spans WHERE size > 40 GROUP BY doc_id, text)
SELECT doc_id, CAST(block AS INTEGER) AS block, CAST(line AS INTEGER) AS line, CAST(span AS INTEGER) AS span, text, CAST(level AS INTEGER) AS level FROM spans LEFT JOIN h USING (doc_id, text)""",
    "contents_pages": """WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2), s AS (SELECT doc_id, min(page) AS start FROM p WHERE flag = 'R' AND page <= 10 GROUP BY doc_id)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(coalesce(min(page) FILTER (WHERE page > start AND flag <> 'A') - 1, max(page)) AS INTEGER) AS end FROM p JOIN s USING (doc_id) GROUP BY doc_id, start""".replace(" AS end FROM", ' AS "end" FROM'),
    "selections": """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS DOUBLE) / 60.0::DOUBLE * 100 AS x, CAST(l_quantity * 2 AS DOUBLE) / 110.0::DOUBLE * 100 AS y, CAST(l_suppkey % 20 AS DOUBLE) / 60.0::DOUBLE * 100 AS w, CAST(l_tax * 100 AS DOUBLE) / 110.0::DOUBLE * 100 AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, w >= 0.5 AND h >= 0.1 AND h <= 6 AND x >= -1 AND y >= -1 AND x + w <= 101 AND y + h <= 101 AS selection FROM r""",
    "highlights_by_page": "SELECT conv_id AS doc_id, turn % 3 AS page, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn DESC) AS ids FROM conversations GROUP BY 1, 2",
    "own_titles": "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label ' || d.doc_id ELSE lang END AS title FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND quality = 1 WHERE source = 'src1' OR source IS NULL",
    "conversion_totals": "SELECT count(*) AS files, count(*) FILTER (WHERE page_id % 5 <> 0) AS succeeded, count(*) FILTER (WHERE page_id % 5 = 0) AS failed, CAST(sum(page_id % 2) AS BIGINT) AS warnings, CAST(sum(length(html)) AS BIGINT) AS paragraphs, CAST(sum(len(regexp_extract_all(html, '<table'))) AS BIGINT) AS tables FROM pages",
    "latest_job_states": "SELECT user_id AS job_id, arg_max(event_type, ts) AS status, max(ts) AS ts FROM events GROUP BY user_id",
}

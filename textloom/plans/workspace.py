"""Layout, workspace and contents operators over shapes that the tables give: boxes of line items, orders as sessions,
conversations as documents with parts, lines of documents as headings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions import text as T
from ..operators import layout, toc, workspace
from .tables import table


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each line item: some orders share a page, quantity and part set the place, tax the height."""
    x, y = (F.col("l_partkey") % 50).cast("double"), (F.col("l_quantity") * 2).cast("double")
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 20).alias("doc_id"), F.floor(F.col("l_orderkey") / 4000).cast("int").alias("page"), F.col("l_linenumber").alias("nth"), F.col("l_orderkey").alias("own"),
        F.col("l_discount").alias("conf"), x.alias("x0"), y.alias("y0"), (x + F.col("l_suppkey") % 60 + 5).cast("double").alias("x1"), (y + F.col("l_tax") * 100 + 4).alias("y1"))


_BOXES = """boxes AS (SELECT l_orderkey % 20 AS doc_id, CAST(l_orderkey // 4000 AS INTEGER) AS page, l_linenumber AS nth, l_orderkey AS own, l_discount AS conf, CAST(l_partkey % 50 AS DOUBLE) AS x0, l_quantity * 2 AS y0,
CAST(l_partkey % 50 + l_suppkey % 60 + 5 AS DOUBLE) AS x1, l_quantity * 2 + l_tax * 100 + 4 AS y1 FROM lineitem)"""


def regions_kept(spark: SparkSession, d: str) -> DataFrame:
    return layout.non_maximum_suppression(_boxes(spark, d))


def regions_clipped(spark: SparkSession, d: str) -> DataFrame:
    """Each order is a page; its first two boxes are captures."""
    boxes = _boxes(spark, d).withColumn("doc_id", F.col("own"))
    return layout.clip_by_captures(boxes.where("nth > 2"), boxes.where("nth <= 2")).select("own", "nth", "x0", F.round("y0", 6).alias("y0"), "x1", F.round("y1", 6).alias("y1"))


def blocks_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    return layout.outside_tables(boxes.where("nth > 1"), boxes.where("nth = 1")).select("own", "nth")


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    return layout.reading_order(_boxes(spark, d), 100.0).select("own", "nth", "column")


def overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    """IoU of every two boxes of an order."""
    boxes = _boxes(spark, d)
    side = lambda n: boxes.select("own", F.col("nth").alias(f"n{n}"), F.struct("x0", "y0", "x1", "y1").alias(f"b{n}"))
    return side(1).join(side(2), "own").where("n1 < n2").select("own", "n1", "n2", F.round(geometry.iou(F.col("b1"), F.col("b2")), 6).alias("iou"))


def dominant_sizes(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "part").select((F.col("p_partkey") % 100).alias("doc_id"), F.lit(1).alias("page"), F.col("p_size").cast("double").alias("size"), F.col("p_name").alias("text"))
    return layout.dominant_size(spans)


def valid_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sessions of customers: one ends ten days after its date."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("token"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("role"))
    return workspace.valid_sessions(orders, users, F.lit("1997-06-01 00:00:00").cast("timestamp_ntz")).select("token", "username", "role")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("role").alias("status"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.lit(1).alias("first"), F.greatest(F.lit(1), F.max("turn").cast("int")).alias("last")).withColumn("status", F.lit("running"))


def page_overlay(spark: SparkSession, d: str) -> DataFrame:
    return workspace.page_overlay(_stored(spark, d), _ranges(spark, d))


def pages_after_cancel(spark: SparkSession, d: str) -> DataFrame:
    return workspace.without_range(_stored(spark, d), _ranges(spark, d))


def translated_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    pages = _stored(spark, d).withColumn("status", F.when(F.col("status") == "user", "done").otherwise("wait"))
    return workspace.enriched(docs, pages)


def structure_profile(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "paragraph").otherwise("table")
    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), kind.alias("kind"), F.lit(1).alias("level"), F.col("role").alias("style"))
    return workspace.structure_profile(parts).select("doc_id", "paragraphs", "tables", "images", "headings", "h1", "warning", F.array_join("styles", ",").alias("styles"))


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """One line item for each number of an order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag"), F.max("l_quantity").alias("l_quantity"))


def sequence_numbers(spark: SparkSession, d: str) -> DataFrame:
    fields = _numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("category"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_quantity") > 45, F.col("l_linenumber") + 3).alias("explicit"))
    return workspace.sequence_numbers(fields).select("doc_id", "category", "pos", "number")


def nearest_figures(spark: SparkSession, d: str) -> DataFrame:
    nodes = _numbered(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "R", "figure").otherwise("p").alias("kind"))
    return workspace.nearest_figure(nodes).select("doc_id", "pos", "figure")


def memo_search(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.lit(1).alias("page"), F.when(F.col("role") == "user", F.col("text")).alias("memo"), F.col("text"))
    return workspace.memo_search(marks, ["tion", "ther"])


def _contents(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines as entries, with a page number of their own, and as blocks, ten to a page."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    blocks = lines.select("doc_id", (F.floor(F.col("n") / 10) + 1).cast("int").alias("page"), (F.col("n") % 10).alias("block_idx"), "text")
    entries = lines.select("doc_id", F.col("n").alias("pos"), F.concat("text", F.lit(" ..... "), (F.floor(F.col("n") / 10) + 1).cast("string")).alias("raw"))
    parsed = entries.select("doc_id", "pos", T.toc_clean(F.col("raw")).alias("clean_text"), T.toc_page(F.col("raw")).alias("page_number"))
    return parsed, blocks


def contents_match_rate(spark: SparkSession, d: str) -> DataFrame:
    return toc.match_rate(toc.match(*_contents(spark, d)))


def memos_and_pages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as highlights and documents as pages: both kinds in one answer."""
    marks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.lit(1).alias("page"), F.when(F.col("role") == "user", F.col("text")).alias("memo"), F.col("text"))
    own = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.lit(1).alias("page"), "text")
    return workspace.memos_and_pages(marks, own, ["tion", "ther"], 25)


def contents_report(spark: SparkSession, d: str) -> DataFrame:
    """Reports over conversations: turns as entries, those of the assistant matched on the page of their number."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    entries = turns.select("doc_id", F.col("turn").alias("pos"), F.col("text").alias("clean_text"), (F.col("turn") % 3 + 1).alias("heading_level"), F.col("turn").alias("page_number"), (F.col("role") != "system").alias("is_section"))
    near = F.when(F.col("turn") % 2 == 0, F.array(F.struct(F.col("text").alias("text"), F.lit(3).alias("page"), F.lit(0.625).alias("similarity")))).otherwise(F.array().cast("array<struct<text:string,page:int,similarity:double>>"))
    matches = turns.select("doc_id", F.col("turn").alias("pos"), (F.col("role") == "assistant").alias("matched"), F.col("turn").cast("int").alias("page_num"), F.lit(0.875).alias("similarity"), near.alias("suggestions"))
    return toc.report(entries, matches, "sample.pdf")


def long_regions(spark: SparkSession, d: str) -> DataFrame:
    """Turns as regions: those of forty characters or more."""
    return layout.long_enough(table(spark, d, "conversations").select("conv_id", "turn", "text"), 40).select("conv_id", "turn")


def contents_candidates(spark: SparkSession, d: str) -> DataFrame:
    entries, blocks = _contents(spark, d)
    return toc.candidates(entries, blocks).groupBy("doc_id", "pos").agg(F.count("*").alias("blocks"))


def streamed_visits(spark: SparkSession, d: str) -> DataFrame:
    """events as a stream to its end: a last event, days after all others, moves the watermark past every visit."""
    from ..stored import shared_path, written
    from ..streaming import visits

    path = shared_path(spark, "visits")
    events = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = written(events.select(F.lit(None).cast("bigint").alias("user_id"), "ts").agg(F.max("user_id").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts")), "last-event")
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    closing = spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rsplit("/", 1)[0])
    query = visits.visits(stream.unionByName(closing)).writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.schema("user_id bigint, first_ts timestamp, last_ts timestamp, events bigint").parquet(path)
    return found.withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (regions_kept, regions_clipped, blocks_outside_tables, reading_order, overlapping_pairs, dominant_sizes, valid_sessions, page_overlay, pages_after_cancel, translated_counts, structure_profile, sequence_numbers, nearest_figures, memo_search, memos_and_pages, contents_report, long_regions, contents_match_rate, contents_candidates, streamed_visits)}
_STORED = "stored AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page, role AS status FROM conversations), ranges AS (SELECT conv_id AS doc_id, greatest(1, CAST(max(turn) AS INTEGER)) AS last FROM conversations GROUP BY conv_id), active AS (SELECT doc_id, CAST(unnest(range(1, last + 1)) AS INTEGER) AS page FROM ranges)"
SQL = {
    "streamed_visits": """WITH b AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 120 SECOND THEN 0 ELSE 1 END AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS visit FROM b) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM n GROUP BY user_id, visit""",
    "regions_clipped": f"""WITH {_BOXES}, caps AS (SELECT own, page, list({{'x0': x0, 'y0': CAST(y0 AS DOUBLE), 'x1': x1, 'y1': CAST(y1 AS DOUBLE), 'gone': false, 'area': CAST(0 AS DOUBLE)}} ORDER BY nth, x0, y0, x1, y1) AS cs FROM boxes WHERE nth <= 2 GROUP BY own, page),
r AS (SELECT b.own, b.nth, b.x0, b.x1, b.y0, b.y1, cs, CASE WHEN cs IS NOT NULL THEN list_reduce(list_prepend({{'x0': b.x0, 'y0': CAST(b.y0 AS DOUBLE), 'x1': b.x1, 'y1': CAST(b.y1 AS DOUBLE), 'gone': false, 'area': CAST((b.x1 - b.x0) * (b.y1 - b.y0) AS DOUBLE)}}, cs), lambda a, c:
CASE WHEN a.gone OR least(a.x1, c.x1) <= greatest(a.x0, c.x0) OR least(a.y1, c.y1) <= greatest(a.y0, c.y0) THEN a
WHEN (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / a.area > 0.5 THEN {{'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': a.y1, 'gone': true, 'area': a.area}}
WHEN least(a.y1, c.y1) - greatest(a.y0, c.y0) >= least(a.x1, c.x1) - greatest(a.x0, c.x0) THEN a
WHEN c.y0 > a.y0 THEN {{'x0': a.x0, 'y0': a.y0, 'x1': a.x1, 'y1': least(a.y1, c.y0), 'gone': false, 'area': a.area}}
ELSE {{'x0': a.x0, 'y0': greatest(a.y0, c.y1), 'x1': a.x1, 'y1': a.y1, 'gone': false, 'area': a.area}} END) END AS f FROM boxes b LEFT JOIN caps USING (own, page) WHERE b.nth > 2)
SELECT own, nth, x0, round(CASE WHEN cs IS NULL THEN y0 ELSE f.y0 END, 6) AS y0, x1, round(CASE WHEN cs IS NULL THEN y1 ELSE f.y1 END, 6) AS y1 FROM r
WHERE cs IS NULL OR (x1 - x0) * (y1 - y0) > 0 AND NOT f.gone AND f.y1 > f.y0 AND f.y1 - f.y0 >= 5""",
    "blocks_outside_tables": f"WITH {_BOXES} SELECT own, nth FROM boxes a WHERE nth > 1 AND NOT EXISTS (SELECT 1 FROM boxes t WHERE t.nth = 1 AND t.doc_id = a.doc_id AND t.page = a.page AND a.x0 < t.x1 AND a.x1 > t.x0 AND a.y0 < t.y1 AND a.y1 > t.y0)",
    "regions_kept": f"""WITH {_BOXES}, l AS (SELECT list({{'kept': [boxes][1:0], 'b': boxes}} ORDER BY conf DESC, x0, y0, x1, y1, doc_id, page, nth, own) AS bs FROM boxes GROUP BY doc_id, page),
f AS (SELECT list_reduce(list_prepend({{'kept': list_transform(bs, lambda x: x.b)[1:0], 'b': bs[1].b}}, bs), lambda a, x: CASE WHEN len(list_filter(a.kept, lambda k: greatest(0, least(k.x1, x.b.x1) - greatest(k.x0, x.b.x0)) * greatest(0, least(k.y1, x.b.y1) - greatest(k.y0, x.b.y0))
> 0.3 * ((k.x1 - k.x0) * (k.y1 - k.y0) + (x.b.x1 - x.b.x0) * (x.b.y1 - x.b.y0) - greatest(0, least(k.x1, x.b.x1) - greatest(k.x0, x.b.x0)) * greatest(0, least(k.y1, x.b.y1) - greatest(k.y0, x.b.y0))))) > 0 THEN a ELSE {{'kept': list_append(a.kept, x.b), 'b': x.b}} END).kept AS kept FROM l)
SELECT k.* FROM (SELECT unnest(kept) AS k FROM f)""",
    "memos_and_pages": """WITH m AS (SELECT conv_id AS doc_id, turn AS id, text, role FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ther')),
mm AS (SELECT 'memo' AS kind, row_number() OVER (ORDER BY doc_id, id) AS place, doc_id, CAST(1 AS INTEGER) AS page, id, CAST(NULL AS BIGINT) AS score, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS snippet FROM m),
p AS (SELECT doc_id, text, instr(lower(text), 'tion') AS pos, CASE WHEN contains(lower(source), 'tion') THEN 10 ELSE 0 END + CASE WHEN contains(lower(source), 'ther') THEN 10 ELSE 0 END + CAST((length(text) - length(replace(lower(text), 'tion', ''))) // 4 + (length(text) - length(replace(lower(text), 'ther', ''))) // 4 AS BIGINT) AS score FROM documents),
pp AS (SELECT 'page' AS kind, row_number() OVER (ORDER BY score DESC, doc_id) AS place, doc_id, CAST(1 AS INTEGER) AS page, CAST(NULL AS BIGINT) AS id, score, CASE WHEN pos > 0 THEN (CASE WHEN greatest(1, pos - 60) > 1 THEN '...' ELSE '' END) || substring(text, greatest(1, pos - 60), least(length(text), pos - 1 + 4 + 60) - greatest(1, pos - 60) + 1) || (CASE WHEN least(length(text), pos - 1 + 4 + 60) < length(text) THEN '...' ELSE '' END) ELSE substring(text, 1, 120) END AS snippet FROM p WHERE score > 0),
b AS (SELECT * FROM mm WHERE place <= 25 UNION ALL SELECT * FROM pp WHERE place <= 25) SELECT kind, CAST(place AS INTEGER) AS place, doc_id, page, id, score, snippet, (SELECT count(*) FROM b) AS total FROM b""",
    "contents_report": """WITH t AS (SELECT conv_id AS doc_id, turn, role, text, '"' || text || '"' AS q, turn % 3 + 1 AS l FROM conversations),
b AS (SELECT doc_id, turn AS a, 0 AS b, CASE role WHEN 'system' THEN '- [skipped] ' || q || ' (figure or table)' WHEN 'assistant' THEN '✓ h' || l || ': ' || q || ' (p.' || turn || ') → matched (similarity 0.88)' ELSE '✗ h' || l || ': ' || q || ' (p.' || turn || ') → no match' END AS line FROM t
UNION ALL SELECT doc_id, turn, 1, '   near: "' || substring(text, 1, 60) || '" (p.3, 0.63)' FROM t WHERE role NOT IN ('system', 'assistant') AND turn % 2 = 0),
c AS (SELECT doc_id, count(*) FILTER (WHERE role <> 'system') AS n, count(*) FILTER (WHERE role = 'assistant') AS m FROM t GROUP BY doc_id),
x AS (SELECT * FROM b UNION ALL SELECT doc_id, -1000, 0, '[report] sample.pdf' FROM c UNION ALL SELECT doc_id, -1000, 1, repeat('-', 50) FROM c UNION ALL SELECT doc_id, 1000000, 0, repeat('-', 50) FROM c
UNION ALL SELECT doc_id, 1000000, 1, n || ' sections | ' || m || ' matched (' || printf('%.1f', CASE WHEN n > 0 THEN 100.0 * m / n ELSE 0 END) || '%) | ' || (n - m) || ' not' FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a, b) AS INTEGER) AS line_no, line FROM x""",
    "long_regions": "SELECT conv_id, turn FROM conversations WHERE length(text) >= 40",
    "reading_order": f"WITH {_BOXES} SELECT own, nth, CASE WHEN x1 - x0 > 60 THEN 'full' WHEN (x0 + x1) / 2 < 50 THEN 'left' ELSE 'right' END AS \"column\" FROM boxes",
    "overlapping_pairs": f"""WITH {_BOXES}, p AS (SELECT own, a.nth AS n1, b.nth AS n2, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS s, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM boxes a JOIN boxes b USING (own) WHERE a.nth < b.nth)
SELECT own, n1, n2, round(s / (t - s), 6) AS iou FROM p""",
    "dominant_sizes": "SELECT doc_id, CAST(1 AS INTEGER) AS page, size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, size) AS k FROM (SELECT p_partkey % 100 AS doc_id, CAST(p_size AS DOUBLE) AS size, sum(length(p_name)) AS n FROM part GROUP BY 1, 2)) WHERE k = 1",
    "valid_sessions": "SELECT CAST(o_orderkey AS VARCHAR) AS token, c_name AS username, c_mktsegment AS role FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate + INTERVAL 10 DAY > TIMESTAMP '1997-06-01 00:00:00'",
    "page_overlay": f"WITH {_STORED} SELECT coalesce(s.doc_id, a.doc_id) AS doc_id, coalesce(s.page, a.page) AS page, CASE WHEN a.page IS NOT NULL THEN 'running' ELSE status END AS status FROM stored s FULL JOIN active a ON s.doc_id = a.doc_id AND s.page = a.page",
    "pages_after_cancel": f"WITH {_STORED} SELECT doc_id, page, status FROM stored s WHERE NOT EXISTS (SELECT 1 FROM active a WHERE a.doc_id = s.doc_id AND a.page = s.page)",
    "translated_counts": "SELECT conv_id AS doc_id, count(*) AS pages, count(*) FILTER (WHERE role = 'user') AS done FROM conversations GROUP BY conv_id",
    "structure_profile": """SELECT conv_id AS doc_id, count(*) FILTER (WHERE role = 'user') AS paragraphs, count(*) FILTER (WHERE role NOT IN ('user', 'system')) AS tables, CAST(0 AS BIGINT) AS images, count(*) FILTER (WHERE role = 'system') AS headings, count(*) FILTER (WHERE role = 'system') AS h1,
CASE WHEN count(*) FILTER (WHERE role = 'system') = 0 THEN 'no h1' WHEN count(*) FILTER (WHERE role = 'system') > 1 THEN 'several h1' END AS warning, array_to_string(list_sort(list_distinct(list(role))), ',') AS styles FROM conversations GROUP BY conv_id""",
    "sequence_numbers": """WITH f AS (SELECT l_orderkey AS doc_id, l_returnflag AS category, list(l_linenumber ORDER BY l_linenumber) AS poss, list({'c': 0, 'e': CAST(CASE WHEN l_quantity > 45 THEN l_linenumber + 3 END AS INTEGER), 'o': CAST([] AS INTEGER[])} ORDER BY l_linenumber) AS xs
FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL) GROUP BY ALL),
r AS (SELECT doc_id, category, poss, list_reduce(list_prepend({'c': 0, 'e': CAST(NULL AS INTEGER), 'o': CAST([] AS INTEGER[])}, xs), lambda a, x: {'c': CASE WHEN x.e IS NULL THEN a.c + 1 ELSE greatest(a.c, x.e) END, 'e': CAST(NULL AS INTEGER), 'o': list_append(a.o, CASE WHEN x.e IS NULL THEN a.c + 1 ELSE x.e END)}).o AS numbers FROM f)
SELECT doc_id, category, unnest(poss) AS pos, unnest(numbers) AS number FROM r""",
    "nearest_figures": """WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_returnflag = 'R' AS fig, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL))
SELECT a.doc_id, a.pos, arg_min(b.pos, abs(b.i - a.i) * 2 + CASE WHEN b.i > a.i THEN 1 ELSE 0 END) AS figure FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.fig AND b.i <> a.i AND abs(b.i - a.i) <= 3 GROUP BY a.doc_id, a.pos""",
    "memo_search": """SELECT conv_id AS doc_id, turn AS id, CAST(1 AS INTEGER) AS page, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '...' ELSE text END AS snippet FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(text), 'ther')""",
    "contents_candidates": """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents), e AS (SELECT doc_id, n AS pos, n // 10 AS page FROM l)
SELECT e.doc_id, CAST(e.pos AS INTEGER) AS pos, count(*) AS blocks FROM e JOIN l ON l.doc_id = e.doc_id AND l.n // 10 BETWEEN e.page - 2 AND e.page + 2 GROUP BY e.doc_id, e.pos""",
}

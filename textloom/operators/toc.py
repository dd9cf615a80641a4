"""Tables of contents found, and their entries matched to headings in the body."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import stored
from ..functions.text import match_key

FUZZY, SUGGESTED, WINDOW, SUGGESTIONS = 0.80, 0.50, 2, 3
_DOTS = r"(?:\.{3,}|·{3,}|…)\s*\d+"
_MATCH = "doc_id bigint, pos int, matched boolean, matched_text string, page_num int, similarity double, suggestions array<struct<text:string,page:int,similarity:double>>"
_NEAR = pa.struct({"text": pa.string(), "page": pa.int32(), "similarity": pa.float64()})
_MATCHED = pa.schema({"doc_id": pa.int64(), "pos": pa.int32(), "matched": pa.bool_(), "matched_text": pa.string(), "page_num": pa.int32(), "similarity": pa.float64(), "suggestions": pa.list_(_NEAR)})


def toc_pages(pages: DataFrame, words: tuple[str, ...] = ("contents", "목차", "차례"), first: int = 10) -> DataFrame:
    """doc_id, start and end: the first of the leading pages with a keyword, up to the page before one without dot leaders."""
    heading = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower("text"), w))
    dotted = F.regexp_like("text", F.lit(_DOTS))
    start = pages.where((F.col("page") <= first) & heading).groupBy("doc_id").agg(F.min("page").alias("start"))
    joined = pages.join(start, "doc_id")
    ends = joined.groupBy("doc_id", "start").agg(F.min(F.when((F.col("page") > F.col("start")) & ~dotted, F.col("page"))).alias("stop"), F.max("page").alias("last"))
    return ends.select("doc_id", "start", F.coalesce(F.col("stop") - 1, F.col("last")).alias("end"))


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching characters over all (difflib)."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def candidates(entries: DataFrame, blocks: DataFrame, window: int = WINDOW) -> DataFrame:
    """Entries with the blocks of the pages near theirs; pages are written out, so the join is by equality."""
    near = entries.withColumn("page", F.explode(F.sequence(F.col("page_number") - window, F.col("page_number") + window)))
    return near.join(blocks, ["doc_id", "page"])


def _begun(key: str, own: range, blocks: list[tuple], used: set[int]) -> tuple | None:
    """The first free block, or two in a row, that the key begins: similarity, places and text."""
    for i in own:
        page, _, text, block = blocks[i]
        if i in used or not block:
            continue
        if block.startswith(key):
            return 1.0, (i,), text
        after = blocks[i + 1] if i + 1 < len(blocks) else None
        if after and after[3] and page is not None and after[0] == page and len(block) < len(key) and key.startswith(block) and f"{block} {after[3]}".startswith(key):
            return 1.0, (i, i + 1), f"{text} {after[2]}"
    return None


def _alike(key: str, own: range, blocks: list[tuple], used: set[int], matchers: dict[int, SequenceMatcher]) -> tuple[tuple | None, list[dict]]:
    """The most similar free block by FUZZY or more, as _begun gives it, and suggestions. A ratio is counted only where
    its upper bounds (difflib's quick ones) reach what is asked for."""
    best, near = None, []
    for i in own:
        page, _, text, block = blocks[i]
        if i in used or not block:
            continue
        if i not in matchers:
            matchers[i] = SequenceMatcher(None, "", block)
        m = matchers[i]
        m.set_seq1(key)
        least = best[0] if best else SUGGESTED
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            continue
        ratio = m.ratio()
        if ratio >= FUZZY and (best is None or ratio > best[0]):
            best = ratio, (i,), text
        elif ratio >= SUGGESTED:
            near.append({"text": text, "page": page, "similarity": ratio})
    near.sort(key=lambda s: -s["similarity"])
    return best, near[:SUGGESTIONS]


def _matched(entries: list[tuple], blocks: list[tuple]) -> Iterator[tuple]:
    """pos, matched, matched_text, page_num, similarity and suggestions of a document's entries (pos, page_number,
    key_text, is_section); blocks: page, block_idx, text, key_text. An entry that begins a block needs no ratios."""
    entries.sort(key=lambda e: (e[0] is None, e[0] or 0))
    blocks.sort(key=lambda b: (b[0] is None, b[0] or 0, b[1] is None, b[1] or 0))
    pages = [b[0] for b in blocks if b[0] is not None]
    used, matchers = set(), {}
    for pos, page, key, section in entries:
        best, near = None, []
        if section and key:
            own = range(len(blocks)) if page is None else range(bisect_left(pages, page - WINDOW), bisect_right(pages, page + WINDOW))
            best = _begun(key, own, blocks, used)
            if best is None:
                best, near = _alike(key, own, blocks, used, matchers)
        if best:
            used.update(best[1])
            yield pos, True, best[2], blocks[best[1][0]][0], best[0], []
        else:
            yield pos, False, None, None, None, near


def _rows(lists: pa.ListArray) -> list[list[tuple]]:
    values = lists.flatten()
    rows = list(zip(*(values.field(i).to_pylist() for i in range(values.type.num_fields)), strict=True))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return [rows[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(doc, *row) for doc, e, b in zip(batch.column("doc_id").to_pylist(), _rows(batch.column("entry")), _rows(batch.column("block")), strict=True) for row in _matched(e, b)]
        columns = list(zip(*found, strict=True)) or [()] * len(_MATCHED)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MATCHED, strict=True)], schema=_MATCHED)


def match(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each entry's heading: a block that begins with it, or two in a row that do, else the most similar by FUZZY or more;
    a block serves one entry (both of two do), in the order of the contents. Else up to three suggestions. Where entries
    have a column is_section, those it is false for (figures, tables) have neither."""
    stored.bounded_batches(entries.sparkSession)
    section = F.coalesce("is_section", F.lit(True)) if "is_section" in entries.columns else F.lit(True)
    e = entries.select("doc_id", F.struct("pos", "page_number", match_key(F.col("clean_text")).alias("key_text"), section.alias("is_section")).alias("entry"))
    b = blocks.select("doc_id", F.struct("page", "block_idx", "text", match_key(F.col("text")).alias("key_text")).alias("block"))
    both = e.unionByName(b, allowMissingColumns=True).groupBy("doc_id").agg(F.collect_list("entry").alias("entry"), F.collect_list("block").alias("block"))
    return both.where(F.size("entry") > 0).mapInArrow(_match, _MATCH)


def match_rate(matches: DataFrame) -> DataFrame:
    return matches.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if("matched").alias("matched"), F.round(100 * F.avg(F.col("matched").cast("int")), 1).alias("percent"))


def report_lines(entries: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, pos and a line of a report for each entry."""
    mark = F.when(F.col("matched"), F.format_string("[OK] %s (p.%d)", "clean_text", "page_num")).otherwise(F.format_string("[--] %s", "clean_text"))
    return entries.join(matches, ["doc_id", "pos"]).select("doc_id", "pos", mark.alias("line"))


def report(entries: DataFrame, matches: DataFrame, name: str, rule: str = "-" * 50) -> DataFrame:
    """doc_id, line_no and line of each document's report: a head, a line for each entry with its level and page, its
    suggestions (60 characters of each) below one that has no match, and a foot with how many sections were matched.

    entries: doc_id, pos, clean_text, heading_level, page_number and is_section; matches as `match` gives them."""
    both = entries.join(matches.select("doc_id", "pos", "matched", "page_num", "similarity", "suggestions"), ["doc_id", "pos"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))
    quoted = F.concat(F.lit('"'), F.col("clean_text"), F.lit('"'))
    level = F.concat(F.lit("h"), F.col("heading_level").cast("string"), F.lit(": "), quoted)
    own = (
        F.when(~F.col("is_section"), F.concat(F.lit("- [skipped] "), quoted, F.lit(" (figure or table)")))
        .when(F.col("matched"), F.concat(F.lit("✓ "), level, F.format_string(" (p.%d) → matched (similarity %.2f)", "page_num", "similarity")))
        .otherwise(F.concat(F.lit("✗ "), level, F.concat(F.lit(" (p."), F.coalesce(F.col("page_number").cast("string"), F.lit("?")), F.lit(") → no match"))))
    )
    near = F.transform("suggestions", lambda s: F.concat(F.lit('   near: "'), F.substring(s["text"], 1, 60), F.format_string('" (p.%d, %.2f)', s["page"], s["similarity"])))
    shown = F.when(F.col("is_section") & ~F.col("matched"), F.coalesce(near, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    body = both.select("doc_id", F.col("pos").cast("bigint").alias("a"), F.posexplode(F.concat(F.array(own), shown)).alias("b", "line"))
    counts = both.groupBy("doc_id").agg(F.count_if("is_section").alias("n"), F.count_if(F.col("is_section") & F.col("matched")).alias("m"))
    rate = F.when(F.col("n") > 0, 100 * F.col("m") / F.col("n")).otherwise(0.0)
    foot = F.concat(F.col("n").cast("string"), F.lit(" sections | "), F.col("m").cast("string"), F.format_string(" matched (%.1f%%)", rate), F.lit(" | "), (F.col("n") - F.col("m")).cast("string"), F.lit(" not"))
    low, high = F.lit(-(1 << 62)), F.lit(1 << 62)
    head = counts.select("doc_id", low.alias("a"), F.posexplode(F.array(F.lit(f"[report] {name}"), F.lit(rule))).alias("b", "line"))
    last = counts.select("doc_id", high.alias("a"), F.posexplode(F.array(F.lit(rule), foot)).alias("b", "line"))
    lines = head.unionByName(body).unionByName(last)
    return lines.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("a", "b"))).alias("line_no"), "line")


def tag_headings(blocks: DataFrame, headings: DataFrame, least: int = 2) -> DataFrame:
    """Blocks with the level of the heading whose text is theirs (the last of equals); blocks of digits alone go."""
    last = headings.select("doc_id", match_key(F.col("text")).alias("key_text"), "level", "pos").where(F.length("key_text") >= least).groupBy("doc_id", "key_text").agg(F.max_by("level", "pos").alias("level"))
    body = blocks.where(~F.regexp_like(F.trim("text"), F.lit(r"^\d+$"))).withColumn("key_text", match_key(F.col("text")))
    return body.join(last, ["doc_id", "key_text"], "left").drop("key_text")


def resolve_references(texts: DataFrame, captions: DataFrame, ids: Column) -> DataFrame:
    """Reference ids in texts (an array column) that a caption of the document has."""
    each = texts.withColumn("caption_id", F.explode(ids))
    return each.join(captions.select("doc_id", "caption_id").distinct(), ["doc_id", "caption_id"], "left_semi")

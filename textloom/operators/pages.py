"""HTML pages as index items: titles, sections, chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .html_text import searchable_text

SECTION_MOST, SECTION_LEAST, PAGE_MOST = 3200, 100, 5000
_HEADING = re.compile(r"<(h[1-3])([^>]*)>(.*?)</\1>", re.I | re.S)
_ID = re.compile(r"""id=["']([^"']+)["']""")


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", T.first_heading(F.col("html")).alias("title"))


def page_items(pages: DataFrame, most: int | None = PAGE_MOST) -> DataFrame:
    """One item for each page: the title (the url without one) and the beginning of its text, or with most=None all of it."""
    text = T.strip_tags(F.col("html"))
    return pages.select("page_id", "url", F.coalesce(T.first_heading(F.col("html")), F.col("url")).alias("title"), (text if most is None else F.substring(text, 1, most)).alias("content"))


def unique_ids(titles: DataFrame) -> DataFrame:
    """page_id, pos and a section id for each title: of like slugs on a page the second has -1, the third -2, or the next
    number whose id no title before has."""

    def number(page: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        tried: dict[str, int] = {}
        page, ids = page.sort_values("pos"), []
        for slug in page.slug:
            name, n = slug, tried.get(slug, 0)
            while name in taken:
                n += 1
                name = f"{slug}-{n}"
            tried[slug] = n
            taken.add(name)
            ids.append(name)
        return pd.DataFrame({"page_id": page.page_id, "pos": page.pos, "section_id": ids})

    slugged = titles.select("page_id", "pos", T.slug(F.col("title")).alias("slug"))
    return slugged.groupBy("page_id").applyInPandas(number, "page_id bigint, pos int, section_id string")


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page, html in zip(batch.page_id, batch.html, strict=True):
            html = html or ""
            found = list(_HEADING.finditer(html))
            taken: set[str] = set()
            for pos, (m, after) in enumerate(zip(found, [*found[1:], None][: len(found)], strict=True)):
                title = searchable_text(m[3])
                own = _ID.search(m[2])
                name = own[1] if own else None
                if name is None:
                    base = re.sub(r"\s+", "-", re.sub(r"[^a-zA-Z0-9_\s가-힣-]", "", title).strip()).lower()[: T.SECTION_SLUG] or "section"
                    name, n = base, 0
                    while name in taken:
                        n += 1
                        name = f"{base}-{n}"
                taken.add(name)
                out.append((page, pos, int(m[1][1]), title, name, own is None, searchable_text(html[m.end() : after.start() if after else len(html)])))
        yield pd.DataFrame(out, columns=["page_id", "pos", "level", "title", "section_id", "made", "content"])


def sections(pages: DataFrame) -> DataFrame:
    """A row for each h1 to h3 with what follows it up to the next; text before the first heading is left out."""
    return pages.select("page_id", "html").mapInPandas(_split, "page_id bigint, pos int, level int, title string, section_id string, made boolean, content string")


def merge_short(found: DataFrame, least: int = SECTION_LEAST) -> DataFrame:
    """Sections shorter than `least` join the one before them; the first of a page stands in any case."""
    own = Window.partitionBy("page_id").orderBy("pos")
    begins = F.when((F.col("pos") == 0) | (F.length("content") >= least), 1).otherwise(0)
    grouped = found.withColumn("begins", begins).withColumn("grp", F.sum("begins").over(own))
    part = F.when(F.col("begins") == 1, F.col("content")).otherwise(F.concat(F.lit("\n\n"), F.col("title"), F.lit("\n"), F.col("content")))
    parts = grouped.select("page_id", "grp", F.struct("pos", "level", "title", "section_id", part.alias("part")).alias("s"))
    merged = parts.groupBy("page_id", "grp").agg(F.array_sort(F.collect_list("s")).alias("s"))
    head = F.col("s")[0]
    return merged.select("page_id", head["pos"].alias("pos"), head["level"].alias("level"), head["title"].alias("title"), head["section_id"].alias("section_id"), F.array_join(F.transform("s", lambda x: x["part"]), "").alias("content"))


def packed(content: Column, most: int = SECTION_MOST) -> Column:
    """Chunks of whole paragraphs of at most `most` characters; a longer paragraph stands alone, uncut."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"))

    def add(a: Column, p: Column) -> Column:
        full = (F.length(a["now"]) + F.length(p) > most) & (a["now"] != "")
        done = F.when(full, F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"])
        now = F.when(full | (a["now"] == ""), p).otherwise(F.concat(a["now"], F.lit("\n\n"), p))
        return F.struct(done.alias("done"), now.alias("now"))

    end = F.aggregate(F.split(content, r"\n\s*\n"), start, add, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]))
    return F.when(F.length(content) <= most, F.array(content)).otherwise(end)


def chunks(found: DataFrame, most: int = SECTION_MOST) -> DataFrame:
    """Long sections as several, numbered from the second on."""
    each = found.select("page_id", "pos", "level", "title", "section_id", F.posexplode(packed(F.col("content"), most)).alias("chunk", "content"))
    later = F.col("chunk") > 0
    number = (F.col("chunk") + 1).cast("string")
    return each.select("page_id", "pos", "chunk", "level", F.concat("title", F.when(later, F.concat(F.lit(" (계속 "), number, F.lit(")"))).otherwise("")).alias("title"), F.concat("section_id", F.when(later, F.concat(F.lit("-"), number)).otherwise("")).alias("section_id"), "content")


def section_items(pages: DataFrame, paths: DataFrame, most: int = SECTION_MOST, least: int = SECTION_LEAST) -> DataFrame:
    """Index items of all pages: url, breadcrumb path and its metadata, title, section, content. paths: url, path."""
    made = chunks(merge_short(sections(pages), least), most)
    with_url = made.join(pages.select("page_id", "url"), "page_id").join(paths, "url", "left")
    path = F.concat_ws(" > ", F.coalesce("path", F.col("url")), "title")
    return with_url.select("page_id", "url", path.alias("path"), T.breadcrumb(path).alias("metadata"), "title", "section_id", F.col("level").alias("heading_level"), "chunk", "content")


def inject_ids(pages: DataFrame) -> DataFrame:
    """The pages' HTML with an id in each heading that has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = {(r.page_id, r.pos): r.section_id for part in _split(iter([batch])) for r in part[part.made].itertuples()}
            out = []
            for page, html in zip(batch.page_id, batch.html, strict=True):
                count = iter(range(1 << 30))

                def mark(m, page=page, count=count):
                    own = ids.get((page, next(count)))
                    return m[0] if own is None else f'<{m[1]} id="{own}"{m[2]}>{m[3]}</{m[1]}>'

                out.append(_HEADING.sub(mark, html or ""))
            yield pd.DataFrame({"page_id": batch.page_id, "html": out})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, html string")

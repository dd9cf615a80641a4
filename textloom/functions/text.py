"""Column functions for text: tokens, scores, snippets, slugs, HTML and numbering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_ALONE = 60, 60, 120
SECTION_SLUG = 50


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case parts between white space with `least` characters or more."""
    return F.filter(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), lambda x: F.length(x) >= least)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlaps."""
    return F.when(F.length(term) > 0, F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term))).otherwise(0).cast("bigint")


def presence_score(title: Column, content: Column, terms: Column) -> Column:
    """10 for each term in the title and 1 for each in the content."""
    t, c = F.lower(title), F.lower(content)
    return F.aggregate(terms, F.lit(0), lambda a, x: a + F.when(F.contains(t, x), 10).otherwise(0) + F.when(F.contains(c, x), 1).otherwise(0))


def count_score(title: Column, content: Column, terms: Column) -> Column:
    """10 for each term in the title and 1 for each time that it stands in the content."""
    t, c = F.lower(title), F.lower(content)
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: a + F.when(F.contains(t, x), 10).otherwise(0) + occurrences(c, x))


def snippet(text: Column, term: Column, before: int = SNIPPET_BEFORE, after: int = SNIPPET_AFTER, alone: int = SNIPPET_ALONE, mark: str = "...", alone_mark: bool = False) -> Column:
    """What stands around a term, with marks where text is left out; the beginning if the term is absent."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(F.lit(1), at - before)
    end = F.least(F.length(text), at - 1 + F.length(term) + after)
    body = F.concat(F.when(start > 1, mark).otherwise(""), F.substring(text, start, end - start + 1), F.when(end < F.length(text), mark).otherwise(""))
    head = F.substring(text, 1, alone)
    if alone_mark:
        head = F.concat(head, F.when(F.length(text) > alone, mark).otherwise(""))
    return F.when(at > 0, body).otherwise(head)


def memo_snippet(memo: Column, text: Column, size: int = 120) -> Column:
    chosen = F.when(F.coalesce(memo, F.lit("")) != "", memo).otherwise(F.coalesce(text, F.lit("")))
    return F.when(F.length(chosen) > size, F.concat(F.substring(chosen, 1, size), F.lit("..."))).otherwise(chosen)


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def straight_quotes(text: Column) -> Column:
    return F.translate(text, "‘’“”", "''\"\"")


def highlight(text: Column, term: str) -> Column:
    """The escaped text with every match of the term in <mark>."""
    return F.regexp_replace(escape_html(text), "(?i)(" + re.escape(term) + ")", "<mark>$1</mark>")


def strip_tags(html: Column) -> Column:
    """Tags become spaces, five entities characters, and white space is collapsed."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        text = F.replace(text, F.lit(entity), F.lit(raw))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def first_heading(html: Column) -> Column:
    """The text of the first h1; null without one."""
    found = F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(F.regexp_like(html, F.lit("(?is)<h1[^>]*>.*?</h1>")), strip_tags(found))


def slug(title: Column, size: int = SECTION_SLUG) -> Column:
    """ASCII word characters, Hangul and hyphens of the trimmed title, spaces as hyphens, lower case, cut to size."""
    kept = F.trim(F.regexp_replace(title, r"[^a-zA-Z0-9_ \t\n\r\f\x{AC00}-\x{D7A3}-]", ""))
    made = F.substring(F.lower(F.regexp_replace(kept, r"[ \t\n\r\f]+", "-")), 1, size)
    return F.when(made == "", "section").otherwise(made)


def path_segment(label: Column) -> Column:
    """A label as a part of a path: no reserved characters, white space as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.trim(label), r'[<>:"/\\|?*]', ""), r"\s+", "-")


def file_name(name: Column) -> Column:
    return F.translate(name, '<>:"/\\|?*', "_________")


def breadcrumb(path: Column) -> Column:
    """doc_category, depth and, from three parts on, parent_doc of a path with '>' between its parts."""
    parts = F.filter(F.transform(F.split(path, ">"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.coalesce(F.get(parts, F.lit(0)), F.lit("")).alias("doc_category"), F.size(parts).alias("depth"), F.when(F.size(parts) >= 3, F.get(parts, F.size(parts) - 2)).alias("parent_doc")
    )


def pretty_html(html: Column, tags: str = "html|head|body|h1|h2|h3|h4|p|div|section|article|header|footer|nav|table|thead|tbody|tr|ul|ol|li") -> Column:
    """A line break before each opening and after each closing block tag; runs of breaks collapse."""
    text = F.regexp_replace(html, rf"(?i)(<(?:{tags})(?: [^>]*)?>)", "\n$1")
    text = F.regexp_replace(text, rf"(?i)(</(?:{tags})>)", "$1\n")
    return F.trim(F.regexp_replace(text, "\n+", "\n"))


def sentences(text: Column) -> Column:
    """Parts after each of . ! ? and the ideographic full stop, with or without white space."""
    return F.split(text, r"(?<=[.!?。])\s*")


def section_number(text: Column) -> Column:
    """'1.2' of '1.2. Title' and '1' of '(1) Title'; null for others."""
    dotted = F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)*)\.\s", 1)
    bracketed = F.regexp_extract(F.trim(text), r"^\((\d+)\)\s", 1)
    return F.nullif(F.coalesce(F.nullif(dotted, F.lit("")), bracketed), F.lit(""))


def number_level(number: Column) -> Column:
    return F.transform(F.split(number, r"\."), lambda x: x.cast("bigint"))


def caption_id(text: Column) -> Column:
    """'fig-2-1' of 'Figure 2.1: x', 'tbl-3' of 'Table 3. x'; a separator must follow the number. Null for others."""
    pattern = r"(?i)^\s*(figure|fig\.?|table|그림|표)\s*(\d+(?:[.-]\d+)*)\s*[:.)\]-]"
    kind, number = F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    prefix = F.when(kind.isin("table", "표"), "tbl-").otherwise("fig-")
    return F.when(number != "", F.concat(prefix, F.regexp_replace(number, r"[.]", "-")))


def reference_ids(text: Column) -> Column:
    """Caption ids that a text speaks of."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)((?:figure|fig\.?|table|그림|표)\s*\d+(?:[.-]\d+)*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: caption_id(F.concat(x, F.lit(":")))))


def special_block(text: Column) -> Column:
    """note, caution or warning of 'NOTE: x', '[NOTE] x' or '※ NOTE x'; null for others."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?i)^\s*(?:※\s*)?\[?(note|caution|warning)\]?\s*[:\s]", 1)), F.lit(""))


def heading_tag(style: Column, size: Column, sizes=((20.0, "h1"), (16.0, "h2"), (14.0, "h3"))) -> Column:
    """h1..h6 of a style 'Heading n', else by font size, else p."""
    by_style = F.regexp_extract(F.coalesce(style, F.lit("")), r"(?i)^(?:heading|제목)\s*([1-6])$", 1)
    by_size = F.lit(None).cast("string")
    for least, tag in reversed(sizes):
        by_size = F.when(size >= least, tag).otherwise(by_size)
    return F.when(by_style != "", F.concat(F.lit("h"), by_style)).otherwise(F.coalesce(by_size, F.lit("p")))


def _toc_digits(text: Column) -> Column:
    """The page number at the end of a line after leaders or a gap; empty without one. Greedy: found from the end."""
    return F.regexp_extract(text, r"(?s)^.*(?:\.{2,}|·{2,}|…|\s{2,})\s*(\d+)\s*$", 1)


def toc_clean(text: Column) -> Column:
    """A line of a table of contents without its leaders and page number."""
    body = F.regexp_extract(text, r"^\s*(.*[^\s.·…\x{85}\x{2028}\x{2029}])?[\s.·…]+\d+\s*$", 1)
    return F.when(_toc_digits(text) != "", F.trim(body)).otherwise(F.trim(text))


def toc_page(text: Column) -> Column:
    page = _toc_digits(text)
    return F.when(page != "", page.cast("int"))


def toc_line(text: Column) -> Column:
    """clean_text, page_number, numbering and heading_level of a line of a table of contents."""
    clean = toc_clean(text)
    numbering = F.regexp_extract(clean, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    level = F.when(numbering != "", F.least(F.size(F.split(numbering, r"\.")), F.lit(6))).otherwise(1)
    return F.struct(clean.alias("clean_text"), toc_page(text).alias("page_number"), F.nullif(numbering, F.lit("")).alias("numbering"), level.alias("heading_level"))


def match_key(text: Column) -> Column:
    """Lower case, white space collapsed, a page number at the end left out."""
    one = F.regexp_replace(F.lower(F.trim(text)), r"\s{2,}|[\t\n\x0B\f\r]", " ")
    ends = F.regexp_like(F.substring(one, -2, 2), F.lit(r"\d"))  # others need no look at the whole text
    return F.trim(F.when(ends, F.regexp_replace(one, r"(?<=\D)\s*\d+$", "")).otherwise(one))


def client_address(forwarded: Column, peer: Column) -> Column:
    """The first address of X-Forwarded-For, else the peer's."""
    first = F.trim(F.get(F.split(F.coalesce(forwarded, F.lit("")), ","), F.lit(0)))
    return F.when(first != "", first).otherwise(peer)


def short_url(url: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(url, r"([^/]+)/?$", 1), r"\.html?$", "")


def resolve_url(base: Column, link: Column) -> Column:
    """A relative link against the folder of a page: '.' goes, '..' takes the folder before it away, at any depth; one
    that leads above the path's beginning stays. A root or a scheme with its host is never taken away."""
    joined = F.when(F.regexp_like(link, F.lit(r"^(?:[a-z][a-z0-9+.-]*:|/|#)")), link).otherwise(F.concat(F.regexp_replace(base, r"[^/]*$", ""), link))
    root = F.regexp_extract(joined, r"^((?:[a-z][a-z0-9+.-]*:(?://[^/]*)?)?/?)", 1)
    parts = F.split(F.substring(joined, F.length(root) + 1, F.length(joined)), "/")
    none = F.expr("cast(array() as array<string>)")

    def step(kept: Column, part: Column) -> Column:
        leads_up = (part == "..") & (F.size(kept) > 0) & (F.element_at(kept, -1) != "..")
        return F.when(part == ".", kept).when(leads_up, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(F.concat(kept, F.array(part)))

    # what ends in '.' or '..' is a folder
    folder = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    return F.when(F.startswith(joined, F.lit("#")), joined).otherwise(F.concat(root, F.array_join(F.aggregate(folder, none, step), "/")))


def is_caption_like(text: Column, longest: int = 150) -> Column:
    return (F.length(text) < longest) & F.regexp_like(text, F.lit(r"(?i)^\s*(?:figure|fig\.|table|그림|표)\s*\d+"))


def is_content_path(path: Column, root: str = "contents/") -> Column:
    """Whether a path stands under the content folder and never leaves it."""
    return F.coalesce(F.startswith(path, F.lit(root)) & ~F.regexp_like(path, F.lit(r"(?:^|/)\.\.(?:/|$)|\\|\x{0}")), F.lit(False))


def in_range(page: Column, text: Column) -> Column:
    """Whether a page is in a range '3' or '3-7'."""
    first = F.nullif(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("")).cast("int")
    last = F.nullif(F.regexp_extract(text, r"-\s*(\d+)\s*$", 1), F.lit("")).cast("int")
    return page.between(first, F.coalesce(last, first))

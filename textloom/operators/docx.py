"""The body of a DOCX file (its XML) as HTML: headings, nested lists, and tables with spans. One document at a time."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _find(node: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        node = next((k for k in node if _name(k) == name), None) if node is not None else None
    return node


def _value(node: ET.Element | None, default: str = "") -> str:
    return default if node is None else next((v for a, v in node.attrib.items() if a.rsplit("}", 1)[-1] == "val"), default)


def _runs(paragraph: ET.Element) -> str:
    """Texts of the runs, bold and italic ones marked; runs of one kind in a row are one."""
    parts: list[list] = []
    for run in paragraph.iter():
        if _name(run) != "r":
            continue
        text = "".join((t.text or "") if _name(t) == "t" else "\t" if _name(t) == "tab" else " " if _name(t) == "br" else "" for t in run)
        kind = tuple(tag for tag, own in (("strong", "b"), ("em", "i")) if (mark := _find(run, "rPr", own)) is not None and _value(mark, "1") not in ("0", "false"))
        if parts and parts[-1][0] == kind:
            parts[-1][1] += text
        elif text:
            parts.append([kind, text])
    return "".join("".join(f"<{k}>" for k in kind) + html.escape(text, quote=False) + "".join(f"</{k}>" for k in reversed(kind)) for kind, text in parts)


def table_html(table: ET.Element) -> str:
    """Rows and cells; a cell merged down spans rows, one of several columns spans columns; a first row marked so is a header."""
    rows = [r for r in table if _name(r) == "tr"]
    grid: list[list[dict]] = []
    for row in rows:
        cells, at = [], 0
        for cell in (c for c in row if _name(c) == "tc"):
            cols = int(_value(_find(cell, "tcPr", "gridSpan"), "1") or 1)
            merge = _find(cell, "tcPr", "vMerge")
            goes_on = merge is not None and _value(merge, "continue") != "restart"
            cells.append({"at": at, "cols": cols, "on": goes_on, "rows": 1, "text": "<br>".join(t for p in cell if _name(p) == "p" and (t := _runs(p)))})
            at += cols
        grid.append(cells)
    for i in range(len(grid) - 1, 0, -1):
        for cell in grid[i]:
            above = next((c for c in grid[i - 1] if c["at"] == cell["at"]), None)
            if cell["on"] and above is not None:
                above["rows"] += cell["rows"]
            else:
                cell["on"] = False
    head = bool(rows) and _find(rows[0], "trPr", "tblHeader") is not None
    out = []
    for i, cells in enumerate(grid):
        tag = "th" if head and i == 0 else "td"
        spans = lambda c: (f' colspan="{c["cols"]}"' if c["cols"] > 1 else "") + (f' rowspan="{c["rows"]}"' if c["rows"] > 1 else "")
        out.append("<tr>" + "".join(f"<{tag}{spans(c)}>{c['text']}</{tag}>" for c in cells if not c["on"]) + "</tr>")
    return "<table>" + "".join(out) + "</table>"


def body_html(source: str) -> str:
    """HTML of a document's XML; empty for XML that is not well formed."""
    try:
        root = ET.fromstring(source)
    except ET.ParseError:
        return ""
    body, out, depth = _find(root, "body") if _name(root) != "body" else root, [], 0
    for node in body if body is not None else ():
        level = _find(node, "pPr", "numPr", "ilvl")
        want = int(_value(level, "0")) + 1 if _name(node) == "p" and _find(node, "pPr", "numPr") is not None else 0
        while depth > want:
            out.append("</ul>")
            depth -= 1
        while depth < want:
            out.append("<ul>")
            depth += 1
        if _name(node) == "tbl":
            out.append(table_html(node))
        elif _name(node) == "p" and (text := _runs(node)):
            style = re.fullmatch(r"(?i)(?:heading|제목)\s*([1-6])", _value(_find(node, "pPr", "pStyle")))
            tag = "li" if want else f"h{style[1]}" if style else "p"
            out.append(f"<{tag}>{text}</{tag}>")
    return "".join(out) + "</ul>" * depth


@F.pandas_udf(StringType())
def docx_html(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else body_html(x))

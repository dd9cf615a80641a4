"""HTML as searchable text: tables as Markdown, MathML as LaTeX, entities as characters. Small helpers for one page."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What MathML operators and letters are in LaTeX.
SYMBOLS = {
    "±": r"\pm", "×": r"\times", "÷": r"\div", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∞": r"\infty", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∂": r"\partial",
    "∇": r"\nabla", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "∪": r"\cup", "∩": r"\cap", "→": r"\rightarrow", "←": r"\leftarrow", "⇒": r"\Rightarrow", "⋅": r"\cdot", "√": r"\sqrt",
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau",
    "φ": r"\phi", "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Σ": r"\Sigma", "Φ": r"\Phi", "Ω": r"\Omega",
}
ACCENTS = {"^": r"\hat", "ˆ": r"\hat", "¯": r"\bar", "‾": r"\bar", "~": r"\tilde", "˜": r"\tilde", "→": r"\vec", "˙": r"\dot", ".": r"\dot"}
_LIMITS = (r"\sum", r"\prod", r"\int", r"\lim", "lim")


def _tag(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _latex(node: ET.Element) -> str:
    tag, kids = _tag(node), list(node)
    if tag in ("mi", "mn", "mo", "mtext", "ms"):
        text = (node.text or "").strip()
        return rf"\text{{{text}}}" if tag == "mtext" and text else SYMBOLS.get(text, text)
    if tag in ("annotation", "annotation-xml", "mspace", "mphantom", "none", "mprescripts"):
        return " " if tag == "mspace" else ""
    part = [_latex(k) for k in kids]
    joined = "".join(part)
    if tag == "mfrac" and len(part) == 2:
        return rf"\frac{{{part[0]}}}{{{part[1]}}}"
    if tag == "msqrt":
        return rf"\sqrt{{{joined}}}"
    if tag == "mroot" and len(part) == 2:
        return rf"\sqrt[{part[1]}]{{{part[0]}}}"
    if tag == "msub" and len(part) == 2:
        return f"{part[0]}_{{{part[1]}}}"
    if tag == "msup" and len(part) == 2:
        return f"{part[0]}^{{{part[1]}}}"
    if tag in ("msubsup", "munderover") and len(part) == 3:
        return f"{part[0]}_{{{part[1]}}}^{{{part[2]}}}"
    if tag == "munder" and len(part) == 2:
        return f"{part[0]}_{{{part[1]}}}" if part[0].startswith(_LIMITS) else rf"\underset{{{part[1]}}}{{{part[0]}}}"
    if tag == "mover" and len(part) == 2:
        mark = (kids[1].text or "").strip()
        return rf"{ACCENTS[mark]}{{{part[0]}}}" if mark in ACCENTS else rf"\overset{{{part[1]}}}{{{part[0]}}}"
    if tag == "mtable":
        return r"\begin{matrix}" + r" \\ ".join(part) + r"\end{matrix}"
    if tag in ("mtr", "mlabeledtr"):
        return " & ".join(part)
    if tag == "mfenced":
        separators = node.get("separators", ",")
        return rf"\left{node.get('open', '(')}" + (separators[:1] + " " if separators else "").join(part) + rf"\right{node.get('close', ')')}"
    if tag == "mmultiscripts":
        cut = next((i for i, k in enumerate(kids) if _tag(k) == "mprescripts"), len(kids))
        scripts = lambda s: "".join((f"_{{{a}}}" if a else "") + (f"^{{{b}}}" if b else "") for a, b in zip(s[::2], s[1::2], strict=False))
        return (f"{{}}{scripts(part[cut + 1 :])}" if cut < len(kids) else "") + (part[0] if part else "") + scripts(part[1:cut])
    return joined


def mathml_to_latex(source: str) -> str:
    """LaTeX of a <math> element; its bare text if it isn't well formed."""
    try:
        return _latex(ET.fromstring(re.sub(r"&(?!amp;|lt;|gt;|quot;|apos;|#)\w+;", lambda m: html.unescape(m[0]), source))).strip()
    except ET.ParseError:
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", source)).strip()


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            if not self.rows:
                self.rows.append([])
            span = {k: int(v) if (v or "").isdigit() and int(v) > 0 else 1 for k, v in attrs if k in ("colspan", "rowspan")}
            self.cell = {"head": tag == "th", "text": [], "cols": span.get("colspan", 1), "rows": span.get("rowspan", 1)}
            self.rows[-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell["text"].append(" ")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"].append(data)


def table_grid(source: str) -> tuple[list[list[str]], bool, bool]:
    """The cells of a table with spans written out, whether its first row is a header, and whether any cell spans."""
    parser = _Table()
    parser.feed(source)
    rows = [r for r in parser.rows if r]
    grid: list[list[str]] = []
    below: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        out: list[str] = []
        cells = iter(row)
        while True:
            if (i, len(out)) in below:
                out.append(below[i, len(out)])
                continue
            cell = next(cells, None)
            if cell is None:
                break
            text = " ".join("".join(cell["text"]).split())
            for _ in range(cell["cols"]):
                for k in range(1, cell["rows"]):
                    below[i + k, len(out)] = text
                out.append(text)
        grid.append(out)
    return grid, bool(rows) and all(c["head"] for c in rows[0]), any(c["cols"] > 1 or c["rows"] > 1 for r in rows for c in r)


def table_to_text(source: str) -> str:
    """GitHub Markdown; for a table with spans lines of 'header: value' pairs, without values that equal their header."""
    grid, headed, spans = table_grid(source)
    if not grid:
        return ""
    width = max(map(len, grid))
    grid = [r + [""] * (width - len(r)) for r in grid]
    head, body = (grid[0], grid[1:]) if headed else ([""] * width, grid)
    if spans:
        lines = [", ".join(f"{h}: {v}" if h else v for h, v in zip(head, row, strict=True) if v and v != h) for row in (body or [head])]
        return "\n".join(line for line in lines if line)
    line = lambda r: "| " + " | ".join(c.replace("|", r"\|") for c in r) + " |"
    return "\n".join([line(head), "| " + " | ".join(["---"] * width) + " |", *map(line, body)])


def searchable_text(source: str) -> str:
    """Text of HTML with tables and formulas kept; blank lines part blocks."""
    kept: list[str] = []

    def keep(made: str) -> str:
        kept.append(made)
        return f"\x00{len(kept) - 1}\x00"

    text = re.sub(r"(?is)<math\b.*?</math>", lambda m: keep(f"${mathml_to_latex(m[0])}$"), source)
    text = re.sub(r"(?is)<table\b.*?</table>", lambda m: keep("\n\n" + table_to_text(re.sub("\x00(\\d+)\x00", lambda k: html.escape(kept[int(k[1])]), m[0])) + "\n\n"), text)
    text = re.sub(r"(?i)</(?:p|div|li|h[1-6]|section|article)>|<br\s*/?>", "\n\n", text)
    text = html.unescape(re.sub(r"<[^>]+>", " ", text))
    text = re.sub(r"[ \t\r\f\v]+", " ", text)
    text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", text)).strip()


def _each(function):
    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else function(x))

    return run


def html_text(column: Column) -> Column:
    return _each(searchable_text)(column)


def table_text(column: Column) -> Column:
    return _each(table_to_text)(column)


def latex(column: Column) -> Column:
    return _each(mathml_to_latex)(column)


def unescaped(column: Column) -> Column:
    return _each(html.unescape)(column)

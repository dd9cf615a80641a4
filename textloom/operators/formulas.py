"""Office formulas (OMML) as MathML, one Arrow batch at a time."""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _name(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _part(node: ET.Element, name: str) -> str:
    found = next((k for k in node if _name(k) == name), None)
    return f"<mrow>{_inner(found)}</mrow>" if found is not None else "<mrow/>"


def _value(node: ET.Element, properties: str, name: str, default: str) -> str:
    for p in node:
        if _name(p) == properties:
            for k in p:
                if _name(k) == name:
                    return next((v for a, v in k.attrib.items() if a.rsplit("}", 1)[-1] == "val"), default)
    return default


def _run(text: str) -> str:
    """Digits are numbers, letters identifiers, spaces are kept as text, the rest operators."""
    out, at = [], 0
    while at < len(text):
        end = at + 1
        if text[at].isdigit():
            while end < len(text) and (text[end].isdigit() or text[end] in ".," and text[end + 1 : end + 2].isdigit()):
                end += 1
            out.append(f"<mn>{text[at:end]}</mn>")
        elif text[at].isalpha():
            while end < len(text) and text[end].isalpha():
                end += 1
            out.append(f"<mi>{html.escape(text[at:end])}</mi>")
        elif not text[at].isspace():
            out.append(f"<mo>{html.escape(text[at])}</mo>")
        at = end
    return "".join(out)


def _inner(node: ET.Element) -> str:
    return "".join(_element(k) for k in node)


def _element(e: ET.Element) -> str:
    name = _name(e)
    if name == "r":
        return _run("".join(t.text or "" for t in e if _name(t) == "t"))
    if name == "f":
        return f"<mfrac>{_part(e, 'num')}{_part(e, 'den')}</mfrac>"
    if name == "rad":
        hidden = _value(e, "radPr", "degHide", "0") in ("1", "on", "true")
        return f"<msqrt>{_part(e, 'e')}</msqrt>" if hidden else f"<mroot>{_part(e, 'e')}{_part(e, 'deg')}</mroot>"
    if name in ("sSup", "sSub", "sSubSup"):
        parts = {"sSup": ("e", "sup"), "sSub": ("e", "sub"), "sSubSup": ("e", "sub", "sup")}[name]
        return f"<m{name[1:].lower()}>{''.join(_part(e, p) for p in parts)}</m{name[1:].lower()}>"
    if name == "sPre":
        return f"<mmultiscripts>{_part(e, 'e')}<mprescripts/>{_part(e, 'sub')}{_part(e, 'sup')}</mmultiscripts>"
    if name == "nary":
        sign = _value(e, "naryPr", "chr", "∫")
        return f"<munderover><mo>{html.escape(sign)}</mo>{_part(e, 'sub')}{_part(e, 'sup')}</munderover>{_part(e, 'e')}"
    if name == "d":
        inner = "<mo>|</mo>".join(f"<mrow>{_inner(k)}</mrow>" for k in e if _name(k) == "e")
        return f"<mrow><mo>{html.escape(_value(e, 'dPr', 'begChr', '('))}</mo>{inner}<mo>{html.escape(_value(e, 'dPr', 'endChr', ')'))}</mo></mrow>"
    if name == "m":
        rows = ("".join(f"<mtd>{_inner(c)}</mtd>" for c in r if _name(c) == "e") for r in e if _name(r) == "mr")
        return f"<mtable>{''.join(f'<mtr>{r}</mtr>' for r in rows)}</mtable>"
    if name == "acc":
        return f"<mover>{_part(e, 'e')}<mo>{html.escape(_value(e, 'accPr', 'chr', '^'))}</mo></mover>"
    if name == "bar":
        tag = "mover" if _value(e, "barPr", "pos", "bot") == "top" else "munder"
        return f"<{tag}>{_part(e, 'e')}<mo>¯</mo></{tag}>"
    if name == "func":
        return f"{_part(e, 'fName')}<mo>&#x2061;</mo>{_part(e, 'e')}"
    if name in ("limLow", "limUpp"):
        tag = "munder" if name == "limLow" else "mover"
        return f"<{tag}>{_part(e, 'e')}{_part(e, 'lim')}</{tag}>"
    if name.endswith("Pr"):
        return ""
    return _inner(e)


def omml_to_mathml(source: str) -> str:
    """A <math> element; for XML that is not well formed one with its bare text."""
    try:
        return f"<math>{_element(ET.fromstring(source))}</math>"
    except ET.ParseError:
        return f"<math><mtext>{html.escape(source)}</mtext></math>"


@F.pandas_udf(StringType())
def mathml(column: pd.Series) -> pd.Series:
    return column.map(lambda x: None if x is None else omml_to_mathml(x))

"""Rules over the paragraphs of documents, their issues and a score.

paragraphs: doc_id, paragraph_index, text. Issues: doc_id, rule_id, category, severity, paragraph_index, char_start,
char_end, detail. Positions are characters from 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WEIGHTS = {"error": 10, "warning": 3, "suggestion": 1}
ISSUE = ("doc_id", "rule_id", "category", "severity", "paragraph_index", "char_start", "char_end", "detail")
#: The presets' rules, their severities and parameters.
PRESETS = {
    "technical": {
        "numbering_continuity": ("error", {}),
        "table_caption": ("warning", {"labels": ("표", "Table")}),
        "figure_caption": ("warning", {"labels": ("그림", "Figure")}),
        "forbidden_terms": ("warning", {"terms": {"비행기": "항공기", "체크": "점검"}}),
        "inconsistent_terms": ("warning", {"groups": [["항공기", "비행기", "비행체"], ["시험", "테스트"]]}),
        "sentence_length": ("suggestion", {"max_chars": 80}),
    },
    "general": {"forbidden_terms": ("suggestion", {"terms": {}}), "inconsistent_terms": ("suggestion", {"groups": []}), "sentence_length": ("suggestion", {"max_chars": 100})},
}


def paragraphs_of(documents: DataFrame) -> DataFrame:
    """The lines of a text as paragraphs."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph_index", "text"))


def _issues(found: DataFrame, rule: str, category: str, severity: str, start: Column, end: Column, detail: Column) -> DataFrame:
    return found.select("doc_id", F.lit(rule).alias("rule_id"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.col("paragraph_index").cast("bigint").alias("paragraph_index"), start.cast("bigint").alias("char_start"), end.cast("bigint").alias("char_end"), detail.alias("detail"))


def numbering_continuity(paragraphs: DataFrame, severity: str) -> DataFrame:
    """A number that does not follow the one before it of the same depth and parent."""
    number = T.section_number(F.col("text"))
    found = paragraphs.where(number.isNotNull()).select("doc_id", "paragraph_index", number.alias("number"), T.number_level(number).alias("level"))
    before = F.lag(F.struct("number", "level")).over(Window.partitionBy("doc_id", F.size("level")).orderBy("paragraph_index"))
    parent = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    last = lambda c: F.element_at(c, -1)
    pairs = found.withColumn("before", before).where(F.col("before").isNotNull())
    broken = pairs.where((parent(F.col("level")) == parent(F.col("before.level"))) & (last(F.col("level")) != last(F.col("before.level")) + 1))
    return _issues(broken, "numbering_continuity", "structure", severity, F.lit(0), F.length("number") + 1, F.concat(F.col("before.number"), F.lit(" > "), F.col("number")))


def split_positions(text: Column, term: Column) -> Column:
    """Where a term begins in a text, from 0, without overlaps."""
    parts = F.split(text, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), -1)
    ends = F.aggregate(
        F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("found")),
        lambda a, p: F.struct((a["at"] + F.length(p) + F.length(term)).alias("at"), F.concat(a["found"], F.array(a["at"] + F.length(p))).alias("found")),
    )
    return ends["found"]


def term_hits(paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """Each time that a term of the document's list (doc_id, term) or of all (term) stands in a paragraph."""
    listed = terms.agg(F.collect_set("term").alias("terms")).first()["terms"] if "doc_id" not in terms.columns else None
    if listed is not None:
        each = paragraphs.select("*", F.explode(T.literal_array(sorted(listed))).alias("term")).where(F.contains("text", "term"))
    else:
        each = paragraphs.join(terms, "doc_id").where(F.contains("text", "term"))
    return each.select("*", F.explode(split_positions(F.col("text"), F.col("term"))).alias("pos"))


def caption_issues(paragraphs: DataFrame, rule: str, labels: tuple[str, str], severity: str) -> DataFrame:
    """Gaps in the numbers of captions (reported where the later number stands first) and captions that nothing refers to."""
    pattern = f"(?i)(?:{'|'.join(map(re.escape, labels))})\\s*(\\d+)"
    marks = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    each = paragraphs.select("doc_id", "paragraph_index", "text", F.posexplode(marks).alias("nth", "mark"))
    numbered = each.withColumn("number", F.regexp_extract("mark", r"(\d+)", 1).cast("bigint"))
    # a mark begins after the marks before it and what stands between them
    between = F.split("text", pattern, -1)
    start = F.aggregate(F.slice(between, F.lit(1), F.col("nth") + 1), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(marks, F.lit(1), F.col("nth")), F.lit(0), lambda a, p: a + F.length(p))
    placed = numbered.withColumn("start", start).withColumn("end", F.col("start") + F.length("mark"))
    numbers = placed.groupBy("doc_id", "number").agg(F.count("*").alias("mentions"), F.min(F.struct("paragraph_index", "start", "end")).alias("one"))
    before = F.lag("number").over(Window.partitionBy("doc_id").orderBy("number"))
    gaps = numbers.withColumn("before", before).where(F.col("number") != F.col("before") + 1).select("doc_id", "one.*", (F.col("before") + 1).alias("missing"))
    missing = _issues(gaps, rule, "structure", severity, F.col("start"), F.col("end"), F.concat(F.lit(f"{labels[1]} missing: "), F.col("missing").cast("string")))
    lone = placed.join(numbers.where("mentions <= 1").select("doc_id", "number"), ["doc_id", "number"])
    alone = _issues(lone, rule, "structure", severity, F.col("start"), F.col("end"), F.concat(F.lit(f"{labels[1]} without reference: "), F.col("number").cast("string")))
    return missing.unionByName(alone)


def forbidden_terms(paragraphs: DataFrame, severity: str, terms: dict[str, str]) -> DataFrame:
    spark = paragraphs.sparkSession
    listed = spark.createDataFrame([(t, r) for t, r in terms.items() if t], "term string, replacement string")
    hits = term_hits(paragraphs, listed).join(F.broadcast(listed), "term")  # the rule's own list
    return _issues(hits, "forbidden_terms", "terminology", severity, F.col("pos"), F.col("pos") + F.length("term"), F.concat("term", F.lit(" > "), "replacement"))


def preferred_terms(paragraphs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """doc_id, grp, preferred and others of the groups of which a document uses two terms or more: the most frequent is
    preferred, ties to the one listed first."""
    spark = paragraphs.sparkSession
    listed = spark.createDataFrame([(g, i, t) for g, group in enumerate(groups) if len(group) > 1 for i, t in enumerate(group)], "grp int, place int, term string")
    hits = term_hits(paragraphs, listed).groupBy("doc_id", "term").agg(F.count("*").alias("n")).join(F.broadcast(listed), "term")
    used = hits.groupBy("doc_id", "grp").agg(F.max_by("term", F.struct("n", -F.col("place"))).alias("preferred"), F.collect_list("term").alias("terms"))
    return used.where(F.size("terms") > 1).select("doc_id", "grp", "preferred", F.array_remove("terms", F.col("preferred")).alias("others"))


def inconsistent_terms(paragraphs: DataFrame, severity: str, groups: list[list[str]]) -> DataFrame:
    others = preferred_terms(paragraphs, groups).select("doc_id", "preferred", F.explode("others").alias("term"))
    hits = term_hits(paragraphs, others)
    return _issues(hits, "inconsistent_terms", "terminology", severity, F.col("pos"), F.col("pos") + F.length("term"), F.concat("term", F.lit(" > "), "preferred"))


def sentence_length(paragraphs: DataFrame, severity: str, max_chars: int) -> DataFrame:
    """Sentences longer than max_chars without the white space around them. A sentence stands at its first place behind
    the characters of the sentences before it."""
    split = paragraphs.select("doc_id", "paragraph_index", "text", T.sentences(F.col("text")).alias("parts"))
    each = split.select("doc_id", "paragraph_index", "text", "parts", F.posexplode("parts").alias("nth", "sentence")).withColumn("sentence", F.trim("sentence"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("nth")), F.lit(0), lambda n, x: n + F.length(x))
    long = each.where(F.length("sentence") > max_chars).withColumn("before", before)
    start = F.instr(F.substring(F.col("text"), F.col("before") + 1, F.length("text")), F.col("sentence")) - 1 + F.col("before")
    return _issues(long, "sentence_length", "readability", severity, start, start + F.length("sentence"), F.length("sentence").cast("string"))


RULES: dict[str, Callable] = {
    "numbering_continuity": lambda p, severity, **_: numbering_continuity(p, severity),
    "table_caption": lambda p, severity, labels: caption_issues(p, "table_caption", labels, severity),
    "figure_caption": lambda p, severity, labels: caption_issues(p, "figure_caption", labels, severity),
    "forbidden_terms": lambda p, severity, terms: forbidden_terms(p, severity, terms),
    "inconsistent_terms": lambda p, severity, groups: inconsistent_terms(p, severity, groups),
    "sentence_length": lambda p, severity, max_chars: sentence_length(p, severity, max_chars),
}


def validate(paragraphs: DataFrame, preset: str | dict = "technical") -> DataFrame:
    """All issues by the rules of a preset; an unknown preset has none."""
    rules = PRESETS.get(preset, {}) if isinstance(preset, str) else preset
    out = paragraphs.sparkSession.createDataFrame([], "doc_id bigint, rule_id string, category string, severity string, paragraph_index bigint, char_start bigint, char_end bigint, detail string")
    for rule, (severity, options) in rules.items():
        out = out.unionByName(RULES[rule](paragraphs, severity, **options).select(*ISSUE))
    return out


def scores(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """doc_id, the number of issues of each severity, and 100 less their weights, 0 at least."""
    counts = issues.groupBy("doc_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in WEIGHTS])
    filled = documents.select("doc_id").join(counts, "doc_id", "left").fillna(0)
    lost = sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0))
    return filled.select("doc_id", *WEIGHTS, F.greatest(F.lit(0), 100 - lost).alias("score"))

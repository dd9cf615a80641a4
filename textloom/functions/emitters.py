"""Table functions for SQL: one row in, many out. `register(spark)` makes them known to a session.

    SELECT d.doc_id, h.term, h.char_start FROM documents d, LATERAL term_hits(d.text, array('one', 'two')) h
    SELECT * FROM numbering_gaps(TABLE(headings))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf(returnType="term string, char_start int, char_end int")
class TermHits:
    """Each time that a term stands in a text, in order, without overlaps of one term with itself. Null texts, null and
    empty terms give nothing."""

    def eval(self, text: str, terms: list) -> Iterator[tuple]:
        for term in terms or []:
            at = text.find(term) if text and term else -1
            while at >= 0:
                yield term, at, at + len(term)
                at = text.find(term, at + len(term))


@udtf(returnType="nth int, line string, char_start int")
class Lines:
    """The lines of a text with their places; an empty text has one empty line, a null one none."""

    def eval(self, text: str) -> Iterator[tuple]:
        at = 0
        for nth, line in enumerate(text.split("\n") if text is not None else []):
            yield nth, line, at
            at += len(line) + 1


@udtf
class NumberingGaps:
    """Of a table of doc_id, pos and number (`1.2.3`): the numbers that are of the same parent as the one before of their
    depth but don't follow it, with that one.

    The table is split by doc_id and ordered by pos, whatever the call says; a document's state is a number for each depth.
    Texts that are no numbers are passed by."""

    def __init__(self):
        self.last: dict[int, tuple[list[int], str]] = {}

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        kind = lambda name: table.dataType[name].dataType
        schema = StructType().add("doc_id", kind("doc_id")).add("pos", kind("pos")).add("number", StringType()).add("before", StringType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("pos")])

    def eval(self, row: Row) -> Iterator[tuple]:
        parts = (row["number"] or "").strip(".").split(".")
        if not all(p.isdecimal() for p in parts):
            return
        now = [int(p) for p in parts]
        before, text = self.last.get(len(now), (None, None))
        self.last[len(now)] = now, row["number"]
        if before is not None and before[:-1] == now[:-1] and now[-1] != before[-1] + 1:
            yield row["doc_id"], row["pos"], row["number"], text


def register(spark: SparkSession) -> None:
    for name, function in (("term_hits", TermHits), ("text_lines", Lines), ("numbering_gaps", NumberingGaps)):
        spark.udtf.register(name, function)

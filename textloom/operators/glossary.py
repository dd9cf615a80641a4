"""Glossaries: import, lookup, and terms found in texts. A glossary has pos, abbr, en and ko."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABBREVIATION = r"(?<![A-Za-z0-9_])([A-Z][A-Z0-9]+)(?![A-Za-z0-9_])"


def distinct_first(terms: DataFrame) -> DataFrame:
    """Of terms with equal abbr and en the first; those without an abbr go."""
    same = Window.partitionBy("abbr", "en").orderBy("pos")
    kept = terms.withColumn("abbr", F.trim("abbr")).where(F.coalesce("abbr", F.lit("")) != "")
    return kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def in_order(terms: DataFrame) -> DataFrame:
    return terms.orderBy(F.upper("abbr"), F.upper("en"), "pos")


def initial(abbr: Column) -> Column:
    """A to Z, or # for others."""
    first = F.upper(F.substring(abbr, 1, 1))
    return F.when(F.regexp_like(first, F.lit("^[A-Z]$")), first).otherwise("#")


def letter_histogram(terms: DataFrame, preview: int = 3) -> DataFrame:
    """letter, how many terms, and the first few of them."""
    lettered = terms.select(initial(F.col("abbr")).alias("letter"), "abbr", "pos")
    first = lettered.withColumn("n", F.row_number().over(Window.partitionBy("letter").orderBy("pos"))).where(F.col("n") <= preview)
    shown = first.groupBy("letter").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "abbr"))), lambda x: x["abbr"]), ", ").alias("preview"))
    return lettered.groupBy("letter").agg(F.count("*").alias("terms")).join(shown, "letter")


def multimap(terms: DataFrame, least: int = 2) -> DataFrame:
    """abbr and all its meanings in order, for abbreviations of `least` characters or more."""
    long = terms.where(F.length("abbr") >= least)
    return long.groupBy(F.upper("abbr").alias("abbr")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "en"))), lambda x: x["en"]).alias("meanings"))


def matches(terms: DataFrame, query: str) -> DataFrame:
    """abbr and en without regard to case, ko with it."""
    q = query.strip().lower()
    return terms.where(F.contains(F.lower("abbr"), F.lit(q)) | F.contains(F.lower("en"), F.lit(q)) | F.contains("ko", F.lit(query.strip())))


def lookup(terms: DataFrame, query: str, shown: int = 3) -> DataFrame:
    """The first matches, an exact abbr before others, each with the number of all."""
    exact = F.when(F.lower("abbr") == query.strip().lower(), 0).otherwise(1)
    found = matches(terms, query)
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    return found.withColumn("_exact", exact).orderBy("_exact", "pos").limit(shown).drop("_exact").join(total)


def in_texts(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, abbr, n and en for each abbreviation of a text that the glossary knows, one row for each meaning."""
    found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ABBREVIATION), F.lit(1))).alias("abbr"))
    counted = found.groupBy("doc_id", "abbr").agg(F.count("*").alias("n"))
    known = terms.where(F.length("abbr") >= 2).select(F.upper("abbr").alias("abbr"), "en")
    return counted.join(known, "abbr")

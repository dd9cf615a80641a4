"""Files as tables: HTML folders, glossaries, vectors, feedback, and what is known about files themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GLOSSARY = T.StructType([T.StructField(c, T.StringType()) for c in ("abbr", "en", "ko")])


def html_pages(spark: SparkSession, root: str) -> DataFrame:
    """page_id (a hash of the url), url (the path below root) and html of every .html file under root."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    path = F.col("_metadata.file_path")
    url = F.regexp_extract(path, f"{pattern_of(root)}/?(.*)$", 1)
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def pattern_of(root: str) -> str:
    """A folder's path as a pattern, without its scheme."""
    import re

    return re.escape(root.split(":", 1)[-1].rstrip("/").lstrip("/"))


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """pos, abbr, en and ko of a CSV file with a header, with or without a byte-order mark; order is that of the file."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)
    clean = raw.toDF(*[c.lstrip("﻿").strip().lower() for c in raw.columns])
    missing = {"abbr", "en"} - set(clean.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    ko = F.col("ko") if "ko" in clean.columns else F.lit(None).cast("string")
    return clean.select(F.monotonically_increasing_id().alias("pos"), "abbr", "en", ko.alias("ko"))


def index_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of index items; an empty table if there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.json(path, schema=schema, multiLine=True)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Add vectors with their metadata in one table, so that no order ties two files together."""
    vectors.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows but for those that new ones replace, and the new ones. Keys may be null."""
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).distinct().alias("n"), same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def append_feedback(feedback: DataFrame, path: str) -> None:
    from ..operators.usage import truncate_preview

    truncate_preview(feedback).write.mode("append").parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    """Overwrite a table with none of its rows."""
    df.limit(0).write.mode("overwrite").parquet(path)


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, name, size and time of files under root, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", "modificationTime")


def backups(files: DataFrame, name: str) -> DataFrame:
    """The backups of a file, newest first."""
    stem = name.rsplit(".", 1)[0]
    return files.where(F.startswith("name", F.lit(stem)) & F.endswith("name", F.lit(".bak"))).orderBy(F.desc("modificationTime"), F.desc("name"))


def is_fresh(index: DataFrame, content: DataFrame) -> DataFrame:
    """One row: whether the newest file of an index is no older than the newest of its content."""
    newest = index.agg(F.max("modificationTime").alias("i")).select("i", F.lit(1).alias("k")).join(content.agg(F.max("modificationTime").alias("c")).select("c", F.lit(1).alias("k")), "k")
    return newest.select(F.coalesce(F.col("i") >= F.col("c"), F.col("i").isNotNull()).alias("fresh"))


def content_name(content: Column, extension: Column) -> Column:
    """A file name from what the file holds."""
    return F.concat(F.substring(F.md5(content), 1, 12), F.lit("."), extension)


def outline_levels(rows: DataFrame) -> DataFrame:
    """row_no, level, label and url of a sheet whose columns are levels and whose last is a url (cells: array<string>):
    the leftmost cell that is not blank sets the level; blank rows go."""
    levels = F.slice("cells", F.lit(1), F.size("cells") - 1)
    filled = F.transform(levels, lambda c: F.coalesce(F.trim(c), F.lit("")))
    at = F.array_position(F.transform(filled, lambda c: c != ""), True)
    last = F.trim(F.element_at("cells", -1))
    found = rows.select("row_no", at.cast("int").alias("level"), filled.alias("filled"), F.nullif(last, F.lit("")).alias("url"))
    return found.where(F.col("level") > 0).select("row_no", "level", F.get("filled", F.col("level") - 1).alias("label"), "url")


def paragraphs_from_files(spark: SparkSession, root: str, glob: str, reader) -> DataFrame:
    """path, paragraph_index and text of documents in a format that `reader` (bytes to a list of texts) knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, c in zip(batch.path, batch.content, strict=True) for i, t in enumerate(x for x in reader(bytes(c)) if x.strip())]
            yield pd.DataFrame(rows, columns=["path", "paragraph_index", "text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "content").mapInPandas(run, "path string, paragraph_index int, text string")


def docx_paragraphs(content: bytes) -> list[str]:
    """Texts of the paragraphs of a DOCX file, from its XML."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p")]


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def demo_events(spark: SparkSession, users: int, days: int, seed: int, per_user_day: int = 4) -> DataFrame:
    """Random usage, fewer events at weekends; equal seeds give equal rows."""
    kinds = F.array(*[F.lit(k) for k in ("visit", "page_view", "search", "chat")])
    base = spark.range(users * days * per_user_day).select(F.col("id").alias("event_id"), F.floor(F.col("id") / (days * per_user_day)).alias("user_id"), (F.floor(F.col("id") / per_user_day) % days).cast("int").alias("day"))
    rnd = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "event_id"), F.lit(1_000_000)) / 1_000_000
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days="day", secs=F.floor(rnd(1) * 86400).cast("decimal(18,6)"))
    dated = base.withColumn("ts", ts).withColumn("event_type", F.get(kinds, F.floor(rnd(2) * 4).cast("int"))).withColumn("props", F.concat(F.lit('{"k": '), F.floor(rnd(3) * 20).cast("string"), F.lit("}")))
    weekend = F.dayofweek("ts").isin(1, 7)
    return dated.where(~weekend | (rnd(4) < 0.3)).drop("day")

"""Document sources: text files, CSV, uploads, by folder and pattern; any file system that Spark reads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grafloom.functions import text as T


def _groups(pattern: str) -> list[str]:
    return list(re.compile(pattern).groupindex)


def _java(pattern: str) -> str:
    """A Python pattern with named groups in Java's spelling."""
    return pattern.replace("(?P<", "(?<")


def _matched(df: DataFrame, path: Column, pattern: str, where: dict[str, str] | None) -> DataFrame:
    """Rows whose path matches from its start, with the pattern's named groups as columns; ``where`` restricts groups by patterns."""
    out = df.filter(path.rlike("^(?:" + _java(pattern) + ")"))
    for i, name in enumerate(_groups(pattern), 1):
        out = out.withColumn(name, F.regexp_extract(path, _java(pattern), re.compile(pattern).groupindex[name]))
    for name, p in (where or {}).items():
        out = out.filter(F.col(name).rlike("^(?:" + _java(p) + ")"))
    return out


def read_text(spark: SparkSession, folder: str, pattern: str = r".*\.txt$", where: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """(named groups, text, id, title): a row per file; unreadable files are skipped, no match is an error.

    Patterns match the path below the folder. ``limit`` takes so many files, by path.
    """
    rows = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(folder, wholetext=True).select(F.col("value").alias("text"), "_metadata.file_path")
    below = F.regexp_replace(F.col("file_path"), ".*?" + re.escape(folder.rstrip("/").split("/")[-1]) + "/", "")
    found = _matched(rows, below, pattern, where)
    if limit is not None:
        found = found.orderBy("file_path").limit(limit)
    names = _groups(pattern)
    out = found.select(*names, "text", T.row_hash(*names, "text").alias("id"), F.element_at(F.split("file_path", "/"), -1).alias("title"))
    if out.isEmpty():
        raise ValueError(f"no file of {folder} matches {pattern}")
    return out


def read_csv(spark: SparkSession, folder: str, source: str | None = None, text: str | None = None, title: str | None = None, timestamp: str | None = None, timestamp_format: str | None = None, encoding: str = "ISO-8859-1") -> DataFrame:
    """CSV files with their columns by name; id is a hash of the row where it is missing; source, text and title may be copies of columns; date parts come from a timestamp column."""
    df = spark.read.csv(folder, header=True, encoding=encoding, recursiveFileLookup=True, multiLine=True, escape='"')
    if "id" not in df.columns:
        df = df.withColumn("id", T.row_hash(*df.columns))
    for name, of in (("source", source), ("text", text), ("title", title)):
        if of and name not in df.columns:
            df = df.withColumn(name, F.col(of))
    if timestamp:
        if not timestamp_format:
            raise ValueError("a timestamp column needs its format")
        ts = F.to_timestamp(F.col(timestamp), timestamp_format)
        df = df.withColumns({k: c for k, c in {"timestamp": ts, **T.date_parts(ts)}.items() if k == "timestamp" or k not in df.columns})
    return df


def read_uploads(spark: SparkSession, folder: str, most: int = 10_000_000) -> DataFrame:
    """(title, text) of .txt and .md files within a size that are valid UTF-8."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ok = F.col("path").rlike(r"\.(txt|md)$") & (F.col("length") <= most) & F.is_valid_utf8(F.col("content").cast("string"))
    return rows.filter(ok).select(F.element_at(F.split("path", "/"), -1).alias("title"), F.decode("content", "utf-8").alias("text"))


def read_documents(spark: SparkSession, folder: str, file_type: str = "text", **options) -> DataFrame:
    readers = {"text": read_text, "csv": read_csv}
    if file_type not in readers:
        raise ValueError(f"unknown file type: {file_type}")
    return readers[file_type](spark, folder, **options)

"""Access and error logs: which file is what, and its lines as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import loglines
from webtrail.sources import files as file_source


@dataclass
class LogFiles:
    access: list[str]
    error: list[str]
    sorted_files: DataFrame  # path, length, mtime, first_line, kind


def sort_out(heads: DataFrame) -> DataFrame:
    """Every file with its kind: access, error, binary or unreadable. One predicate
    decides what an error log is, for both readers."""
    binary = ~F.col("compressed") & (F.instr(F.decode("head", "ISO-8859-1"), "\0") > 0)
    error = F.coalesce(F.col("first_line").rlike(fixed.ERROR_LOG_HEAD)
                       & (F.col("first_line").rlike(fixed.APACHE_ERROR_LINE) | F.col("first_line").rlike(fixed.NGINX_ERROR_LINE)),
                       F.lit(False))
    return heads.select(
        "path", "length", "mtime", "first_line", "error",
        F.when(F.col("error").isNotNull(), "unreadable").when(binary, "binary").when(error, "error").otherwise("access").alias("kind"))


def skipped(sorted_files: DataFrame) -> DataFrame:
    reason = F.when(F.col("kind") == "binary", fixed.BINARY_SKIP_REASON).when(
        F.col("kind") == "error", fixed.ERROR_LOG_SKIP_REASON).otherwise(F.col("error"))
    return sorted_files.filter(F.col("kind") != "access").select(F.lit("logs").alias("source"), "path", reason.alias("reason"))


def find(spark: SparkSession, targets: list[str]) -> LogFiles:
    """Sorts the files below the targets. The driver holds file names only, as the scan
    that follows does anyway; no line passes through it."""
    sorted_files = sort_out(file_source.heads(file_source.listing(spark, targets)))
    access, error = [], []
    for row in sorted_files.select("path", "kind").filter(F.col("kind").isin("access", "error")).toLocalIterator():
        (access if row.kind == "access" else error).append(row.path)
    return LogFiles(sorted(access), sorted(error), sorted_files)


def access_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, pos, value, record (NULL where the line does not parse)."""
    rows = file_source.lines(spark, paths)
    return parsed(rows.select(F.col("path").alias("source"), "pos", "value"))


def parsed(lines: DataFrame) -> DataFrame:
    """Adds the record of each line; each pattern runs once per line."""
    return loglines.with_record(lines)


def requests(lines: DataFrame) -> DataFrame:
    """The parsed lines as requests."""
    return lines.filter(F.col("record").isNotNull()).select(
        *loglines.request_columns(F.col("record")), "source", "pos")


def error_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return file_source.lines(spark, paths).select(F.col("path").alias("source"), "pos", "value")


def sources_table(sorted_files: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per log file: size, mtime, parsed and unparsed lines."""
    return sorted_files.filter(F.col("kind") == "access").select(F.col("path").alias("source"), "length", "mtime").join(
        counts, "source", "left").withColumns({"lines": F.coalesce("lines", F.lit(0)), "unparsed": F.coalesce("unparsed", F.lit(0))})


def index_status(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """What changed since the index was built: files added, gone, or changed (both).
    Rows are (path, length, mtime)."""
    cols = ["path", "length", "mtime"]
    added = present.select(*cols).exceptAll(indexed.select(*cols)).withColumn("change", F.lit("added"))
    gone = indexed.select(*cols).exceptAll(present.select(*cols)).withColumn("change", F.lit("gone"))
    return added.unionByName(gone)

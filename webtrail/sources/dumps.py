"""Database exports as lines with their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.operators import dumps as ops
from webtrail.sources import files as file_source


def dump_files(listing: DataFrame) -> DataFrame:
    return listing.filter(F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in fixed.DUMP_SUFFIXES) + ")$"))


def dump_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return file_source.lines(spark, paths).withColumnRenamed("path", "dump")


def head_lines(heads: DataFrame) -> DataFrame:
    """dump, line_no, value of the comment head, from file heads."""
    lines = F.slice(F.split(F.make_valid_utf8(F.col("head").cast("string")), "\n"), 1, fixed.DUMP_HEAD_LINES)
    return heads.select(F.col("path").alias("dump"), F.posexplode(lines).alias("line_no", "value"))


def read_rows(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statements, rows, created columns) of whole exports."""
    statements = ops.statements(dump_lines(spark, paths))
    created = ops.created_columns(statements)
    return statements, ops.insert_rows(statements), created

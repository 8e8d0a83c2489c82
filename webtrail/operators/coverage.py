"""Gaps: what the logs do not show.

The order over the whole timeline never runs in one task. Gaps are measured inside
each day, the borders between days are stitched with one row per day, and the median
comes from the distinct gap lengths with their counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed


def stamps(requests: DataFrame) -> DataFrame:
    """Distinct seconds that hold a request, with their day (at most 86,400 per day)."""
    return (
        requests.filter(F.col("epoch") > 0).select("epoch").distinct()
        .withColumn("day", F.floor(F.col("epoch") / 86400).cast("long"))
    )


def gaps(requests: DataFrame) -> DataFrame:
    """Every pair of neighbouring stamps: (from, to, seconds)."""
    seconds = stamps(requests)
    inside = seconds.withColumn("before", F.lag("epoch").over(Window.partitionBy("day").orderBy("epoch")))
    borders = seconds.groupBy("day").agg(F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    # One row per day of the log's life: thousands of rows after a century.
    chain = Window.partitionBy(F.lit(0)).orderBy("day")
    across = borders.select(F.lag("last").over(chain).alias("from"), F.col("first").alias("to"))
    both = inside.select(F.col("before").alias("from"), F.col("epoch").alias("to")).unionByName(across)
    return both.filter(F.col("from").isNotNull()).withColumn("seconds", F.col("to") - F.col("from"))


def rhythm(requests: DataFrame) -> DataFrame:
    """One row: stamps, median gap and the threshold above which silence is a hole.

    Distinct gap lengths are few (their sum is the log's span), so the exact median is
    taken over (length, count) rows."""
    lengths = gaps(requests).groupBy("seconds").agg(F.count(F.lit(1)).alias("n"))
    row = lengths.agg(
        (F.coalesce(F.sum("n"), F.lit(0)) + 1).alias("stamps"),
        F.coalesce(F.expr("percentile(seconds, 0.5, n)"), F.lit(1.0)).alias("median"))
    return row.select(
        "stamps", "median", (F.col("stamps") >= fixed.QUIET_MIN_STAMPS).alias("checked"),
        F.greatest(F.lit(float(fixed.QUIET_MIN_SECONDS)), F.col("median") * fixed.QUIET_FACTOR).alias("threshold"))


def quiet_windows(requests: DataFrame) -> DataFrame:
    """Every hole, measured against the log's own rhythm. Too few stamps: none."""
    measured = rhythm(requests).filter("checked")
    threshold = measured.select(F.max("threshold")).scalar()
    return gaps(requests).withColumn("threshold", threshold).filter(F.col("seconds") >= F.col("threshold"))


def shown_windows(windows: DataFrame, limit: int = fixed.QUIET_SHOWN) -> DataFrame:
    return windows.orderBy(F.desc("seconds"), "from").limit(limit)


def truncated_heads(first_lines: DataFrame) -> DataFrame:
    """Files whose first non-empty line does not parse. ``first_lines``: path, first_line,
    record; a file without any line says nothing."""
    return first_lines.filter(F.col("first_line").isNotNull() & F.col("record").isNull()).select("path")


def stale_files(requests: DataFrame, listing: DataFrame) -> DataFrame:
    """Files last written more than a minute before their own newest entry."""
    newest = requests.filter(F.col("epoch") > 0).groupBy(F.col("source").alias("path")).agg(
        F.max("epoch").alias("last_epoch"))
    return listing.join(newest, "path").filter(
        (F.col("mtime") > 0) & (F.col("mtime") + 60 < F.col("last_epoch"))).select("path", "mtime", "last_epoch")


def note_count(windows: DataFrame, truncated: DataFrame, stale: DataFrame) -> DataFrame:
    """How many gaps were measured, not how many are shown."""
    parts = [windows.select(F.lit("quiet").alias("kind")), truncated.select(F.lit("truncated").alias("kind")),
             stale.select(F.lit("stale").alias("kind"))]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return both.agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("kind") == "quiet").alias("quiet"),
                    F.count_if(F.col("kind") == "truncated").alias("truncated"),
                    F.count_if(F.col("kind") == "stale").alias("stale"))

"""The index over log files, of which only changed ones are read again.

A build writes the lines of new and changed files under its own number, by source; then a new
version of the table of sources says which build holds each source. That last write is what makes
a build valid: one that dies before it leaves the index as it was, and is repeated under the same
number. Rows of files that changed or went are left behind by the join with the sources, which
prunes their folders, until `vacuum` deletes them.

A source is known by path, size and time of change, skipped files included. A line that no format
fits is kept as a row without a request, so that what was not understood is counted in the same pass.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.functions import loglines, times
from webtrail.operators import actors as actor_ops, alerts as alert_ops
from webtrail.sources import files as file_source, logs

SOURCES = "path string, length long, mtime long, kind string, reason string, lines long, unparsed long, src string, build int"
_KNOWN = ["path", "length", "mtime"]


def _latest(spark: SparkSession, folder: str) -> int:
    """The number of the last complete build, 0 for none."""
    try:
        return spark.read.parquet(f"{folder}/sources").agg(F.coalesce(F.max("build_no"), F.lit(0)).alias("n")).first().n
    except AnalysisException:  # no folder, or nothing complete in it
        return 0


def sources(spark: SparkSession, folder: str) -> DataFrame:
    """The log files that the index stands on."""
    build = _latest(spark, folder)
    return spark.read.schema(SOURCES).parquet(f"{folder}/sources/build_no={build:06d}") if build else spark.createDataFrame([], SOURCES)


def changes(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """(path, change): files that were added, are gone, or have another size or time."""
    old, new = indexed.select("path", F.struct("length", "mtime").alias("old")), present.select("path", F.struct("length", "mtime").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "gone").when(F.col("old") != F.col("new"), "changed")
    return old.join(new, "path", "full_outer").select("path", change.alias("change")).filter("change IS NOT NULL")


def status(spark: SparkSession, folder: str, present: DataFrame) -> DataFrame:
    """One row: whether there is an index, whether it is fresh, and how many files differ how."""
    met = changes(sources(spark, folder), present)
    row = met.agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "gone", "changed")])
    exists = F.lit(_latest(spark, folder) > 0)
    return row.select(exists.alias("exists"), (exists & (F.col("added") + F.col("gone") + F.col("changed") == 0)).alias("fresh"), "added", "gone", "changed")


def _src(path: str) -> Column:
    """The folder of a source's rows; it begins with a letter, so no reader takes it for a number."""
    return F.concat(F.lit("s"), F.substring(F.sha2(path, 256), 1, 16))


def _indexed_lines(lines: DataFrame) -> DataFrame:
    """Every line that is not blank: a request with its flags, or none where no format fits."""
    rows = lines.filter(F.col("record").isNotNull() | (F.trim("value") != "")).select(*loglines.request_columns(F.col("record")), "source", "pos", F.col("record").isNull().alias("unparsed"))
    return actor_ops.flagged(rows).withColumn("day", times.local_day(F.col("epoch"), F.col("tz"))).withColumn("src", _src("source"))


def update(spark: SparkSession, present: DataFrame, folder: str) -> int:
    """Brings the index up to the files of a listing (path, length, mtime); the number of the build.
    Without a change nothing is written."""
    before = _latest(spark, folder)
    known = sources(spark, folder)
    if before and changes(known, present).isEmpty():
        return before
    build = before + 1
    kept = known.join(present.select(*_KNOWN), _KNOWN, "left_semi")
    new = present.join(known.select(*_KNOWN), _KNOWN, "left_anti")
    sorted_path = f"{folder}/sorted/build={build:06d}"
    logs.sort_out(file_source.heads(new)).write.mode("overwrite").parquet(sorted_path)
    sorted_files = spark.read.parquet(sorted_path)
    # Names of new files come to the driver, as the scan that follows takes them.
    paths = [r.path for r in sorted_files.filter("kind = 'access'").select("path").toLocalIterator()]
    counts = spark.createDataFrame([], "path string, lines long, unparsed long")
    if paths:
        rows = f"{folder}/requests/build={build:06d}"
        lines = _indexed_lines(logs.access_lines(spark, paths))
        lines.hint("rebalance", "src").sortWithinPartitions("src", "day", "ip", "epoch").write.mode("overwrite").option(
            "parquet.bloom.filter.enabled#ip", "true").option("parquet.bloom.filter.expected.ndv#ip", "20000").partitionBy("src").parquet(rows)
        counts = spark.read.parquet(rows).groupBy(F.col("source").alias("path")).agg(F.count_if(~F.col("unparsed")).alias("lines"), F.count_if("unparsed").alias("unparsed"))
    reasons = logs.skipped(sorted_files).select("path", "reason")
    fresh = sorted_files.select(*_KNOWN, "kind").join(reasons, "path", "left").join(counts, "path", "left").select(
        *_KNOWN, "kind", "reason", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("unparsed", F.lit(0)).alias("unparsed"),
        _src("path").alias("src"), F.lit(build).alias("build"))
    kept.unionByName(fresh).write.mode("overwrite").parquet(f"{folder}/sources/build_no={build:06d}")
    return build


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """The requests of the sources as they are now."""
    return _rows(spark, folder).filter("NOT unparsed").drop("unparsed", "build", "src")


def unparsed(spark: SparkSession, folder: str) -> DataFrame:
    """(source, pos) of the lines that no format fits."""
    return _rows(spark, folder).filter("unparsed").select("source", "pos")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    here = sources(spark, folder).filter("kind = 'access' AND lines + unparsed > 0").select("build", "src")
    return spark.read.parquet(f"{folder}/requests").join(here, ["build", "src"], "left_semi")


def derive(spark: SparkSession, folder: str) -> dict[str, str]:
    """Clients, hours, days, alerts and totals of the last build, beside those of earlier ones."""
    build = _latest(spark, folder)
    rows = requests(spark, folder)
    paths = {n: f"{folder}/{n}/build={build:06d}" for n in ("actors", "actor_hours", "days", "alerts", "totals")}
    actor_ops.actor_table(rows).write.mode("overwrite").parquet(paths["actors"])
    clients = spark.read.parquet(paths["actors"])
    for name, table in (("actor_hours", actor_ops.actor_hours(rows)), ("days", actor_ops.days(rows, clients)), ("alerts", alert_ops.alerts(rows, clients)), ("totals", actor_ops.index_totals(rows))):
        table.write.mode("overwrite").parquet(paths[name])
    return paths


def vacuum(spark: SparkSession, folder: str) -> int:
    """Deletes the rows of sources that changed or went; the number of folders deleted."""
    here = sources(spark, folder).select("build", "src")
    there = spark.read.parquet(f"{folder}/requests").select("build", "src").distinct()
    gone = there.join(here, ["build", "src"], "left_anti").collect()  # a row per source and build
    for row in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/requests/build={row.build:06d}/src={row.src}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(gone)

"""Evidence proposals: which directory is a web root, holds logs, or is an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import loglines, uris
from webtrail.functions.text import any_of


def directories(listing: DataFrame) -> DataFrame:
    """Every directory a file lies in or below."""
    return listing.select(F.explode(F.filter(uris.prefixes(F.regexp_replace("path", "/[^/]*$", "")), lambda p: p != "")).alias("dir")).distinct()


def web_roots(spark: SparkSession, listing: DataFrame, minimum: int = fixed.EVIDENCE_MIN_SCORE) -> DataFrame:
    """(dir, cms, score): directories that hold enough of a CMS' markers.

    Every path is written out as (ancestor, rest) for the few depths a marker can have,
    and meets the marker table on the rest: an equality, whatever the tree's size."""
    markers = spark.createDataFrame(list(fixed.EVIDENCE_MARKERS), "cms string, marker string, kind string, weight int").withColumn(
        "marker", F.lower("marker"))
    depth = max(m.count("/") + 1 for _, m, _, _ in fixed.EVIDENCE_MARKERS)
    things = listing.select("path", F.lit("file").alias("kind")).unionAll(directories(listing).select(F.col("dir"), F.lit("dir")))
    part = F.split("path", "/")
    cuts = things.select("kind", part.alias("part")).select("kind", "part", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(depth), F.greatest(F.size("part") - 1, F.lit(1))))).alias("n"))
    placed = cuts.select(
        "kind", F.array_join(F.slice("part", F.lit(1), F.size("part") - F.col("n")), "/").alias("dir"),
        F.lower(F.array_join(F.slice("part", F.size("part") - F.col("n") + 1, F.col("n")), "/")).alias("marker"))
    hits = placed.join(markers, ["marker", "kind"]).select("dir", "cms", "marker", "weight").distinct()
    scored = hits.groupBy("dir", "cms").agg(F.sum("weight").alias("score"))
    best = scored.groupBy("dir").agg(F.max(F.struct("score", "cms")).alias("b")).select("dir", "b.cms", "b.score").filter(
        F.col("score") >= minimum)
    # A root inside another root is part of it.
    inner = best.select("dir", F.explode(F.filter(uris.prefixes(F.col("dir")), lambda p: p != "")).alias("above")).filter("above <> dir")
    nested = inner.join(best.select(F.col("dir").alias("above")), "above", "left_semi").select("dir").distinct()
    return best.join(nested, "dir", "left_anti")


def log_directories(heads: DataFrame, root: str) -> DataFrame:
    """(dir, files, parsed, score): directories whose sample lines are access-log lines,
    from the first few files and lines of each; nested ones fold into the topmost
    directory that holds nothing but logs."""
    name = F.lower(uris.basename(F.col("path")))
    is_log = any_of([name.endswith(s) for s in fixed.LOG_SUFFIXES]) | name.contains(".log")
    logs = heads.filter(is_log & (F.col("length") > 0)).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "length", "first_lines")
    counts = logs.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("size"))
    place = F.row_number().over(Window.partitionBy("dir").orderBy("path"))
    sample = logs.withColumn("n", place).filter(F.col("n") <= fixed.SNIFF_FILES)
    lines = sample.select("dir", F.explode("first_lines").alias("value"))
    parsed = loglines.with_record(lines).filter(F.col("record").isNotNull()).groupBy("dir").agg(F.count(F.lit(1)).alias("parsed"))
    found = counts.join(parsed, "dir").select("dir", "files", "size", "parsed")
    # The topmost ancestor all of whose files lie in log directories.
    folder = F.regexp_replace("path", "/[^/]*$", "")
    inside = F.filter(uris.prefixes(folder), lambda p: p.startswith(root.rstrip("/")))
    every = heads.select(folder.alias("dir"), F.explode(inside).alias("above"))
    mixed = every.join(found.select("dir"), "dir", "left_anti").select("above").distinct()
    pure = every.select("above", "dir").distinct().join(mixed, "above", "left_anti")
    tops = pure.groupBy("dir").agg(F.min_by("above", F.length("above")).alias("top"))
    return (found.join(tops, "dir", "left").groupBy(F.coalesce("top", "dir").alias("dir")).agg(
        F.sum("files").alias("files"), F.sum("size").alias("size"), F.sum("parsed").alias("parsed"))
        .withColumn("score", F.col("parsed") * 10 + F.col("files")))


def dump_candidates(heads: DataFrame) -> DataFrame:
    """(path, size, markers): files that end like an export and begin like one."""
    name = F.lower(uris.basename(F.col("path")))
    ending = any_of([name.endswith(s) for s in fixed.DUMP_SUFFIXES])
    text = F.lower(F.decode("head", "ISO-8859-1"))
    markers = F.array_compact(F.array(*[F.when(text.contains(m.lower()), m) for m in fixed.DUMP_MARKERS]))
    return heads.filter(ending).select("path", F.col("length").alias("size"), markers.alias("markers")).filter(F.size("markers") > 0)

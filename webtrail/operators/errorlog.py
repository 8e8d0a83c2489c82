"""Error logs: which files of the web root the interpreter says it ran."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import loglines, predicates as is_, uris
from webtrail.functions.text import fingerprint

EVIDENCE_CAP = 300


def named_paths(lines: DataFrame) -> DataFrame:
    """(logged path, message, time, ...) per PHP file an interesting message names.
    ``lines``: source, pos, value."""
    # Most lines name no PHP file: a plain substring test comes before any pattern.
    worth = lines.filter(F.lower("value").contains(".ph") | F.lower("value").contains(".inc"))
    parsed = loglines.with_error_record(worth)
    message = F.col("message")
    return parsed.filter(is_.interesting_error(message)).select(
        "source", "pos", F.col("epoch_naive").alias("at"), "client", "message", is_.hard_error(message).alias("hard"),
        F.explode(loglines.php_paths(message)).alias("p")).select(
        "source", "pos", "at", "client", "message", "hard", F.col("p.path").alias("logged"), F.col("p.line").alias("line"))


def resolve(paths: DataFrame, webroot: DataFrame) -> DataFrame:
    """Logged path -> file of the copy with the longest shared tail, case-insensitive.

    Each distinct logged path is written out once per tail and joins on equality.
    ``webroot``: path, rel, root_rank (order of the registered roots)."""
    logged = paths.select("logged").distinct()
    tails = logged.select(
        "logged", F.explode(uris.suffixes(F.lower(uris.forward_slashes(F.col("logged"))))).alias("tail"))
    files = webroot.select(F.lower("rel").alias("tail"), F.col("path").alias("artifact"), "root_rank")
    best = F.min_by("artifact", F.struct("root_rank", (-F.length("tail")).alias("longest"), "artifact"))
    found = tails.join(files, "tail").groupBy("logged").agg(best.alias("artifact"))
    return logged.join(found, "logged", "left")


def per_file(paths: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per file: mentions, first line number, first and last time, any hard error, and
    an example (a hard message where there is one)."""
    place = F.struct("source", "pos")
    hits = paths.join(resolved.filter("artifact is not null"), "logged")
    example = F.min_by("message", F.struct((~F.col("hard")).alias("soft"), "source", "pos", "message"))
    return hits.groupBy("artifact").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("line", F.when(F.col("line").isNotNull(), F.struct("source", "pos", "line"))).alias("line"),
        F.min("at").alias("first"), F.max("at").alias("last"), F.bool_or("hard").alias("hard"),
        F.substring(F.trim(example), 1, EVIDENCE_CAP).alias("example"),
        F.min_by("logged", F.struct(place, "logged")).alias("logged"))


def unresolved(paths: DataFrame, resolved: DataFrame) -> DataFrame:
    """How many mentions could not be placed: counted, not dropped."""
    missing = resolved.filter("artifact is null").select("logged")
    return paths.join(missing, "logged", "left_semi").agg(F.count(F.lit(1)).alias("unresolved"))


def findings(files: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    (hard_id, hard_sev, hard_text), (soft_id, soft_sev, soft_text) = fixed.ERROR_RULES
    rows = files.select(
        F.lit("errorlog").alias("source"), F.when(F.col("hard"), hard_sev).otherwise(soft_sev).alias("severity"),
        F.when(F.col("hard"), hard_text).otherwise(soft_text).alias("rule"),
        F.when(F.col("hard"), hard_id).otherwise(soft_id).alias("rule_id"),
        F.lit("file").alias("artifact_kind"), "artifact", F.col("line").cast("long").alias("line"),
        F.substring(F.concat(F.col("n").cast("string"), F.lit("× in the error log as "), F.col("logged"),
                             F.lit(" · "), F.col("example")), 1, 400).alias("evidence"),
        F.lit("errorlog").alias("engine"))
    rows = rows.filter(is_.rule_enabled(F.col("rule_id"), disabled or []))
    return rows.withColumn("fingerprint", fingerprint(F.col("source"), F.col("rule"), F.col("artifact"), F.col("line")))

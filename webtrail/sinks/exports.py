"""Exports and stored tables. Everything is written by the tasks that computed it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import indicators as ind, times
from webtrail.functions.text import spreadsheet_safe
from webtrail.operators import accounts as account_ops, actors as actor_ops, alerts as alert_ops, iocs as ioc_ops

# --- the index ------------------------------------------------------------------


def write_index(requests: DataFrame, folder: str) -> dict[str, str]:
    """Requests with their flags, clients, hours, days and alerts as Parquet.

    The requests are written first and everything else reads them back, so the lines
    are parsed once and a lost executor only repeats its own part. Files are ordered by
    (ip, epoch) within a local day, so a trace prunes by folder and by row-group range.
    """
    spark = requests.sparkSession
    paths = {n: f"{folder}/{n}" for n in ("requests", "actors", "actor_hours", "days", "alerts", "totals")}
    day = times.local_day(F.col("epoch"), F.col("tz"))
    flagged = actor_ops.flagged(requests).withColumn("day", day)
    # Rebalancing by day lets the runtime cut a busy day into files of an even size and put
    # quiet days together: no client and no day decides how large a task is.
    flagged.hint("rebalance", "day").sortWithinPartitions("day", "ip", "epoch").write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#ip", "true").option("parquet.bloom.filter.expected.ndv#ip", "20000").option(
        "parquet.bloom.filter.enabled#leaf", "true").option("parquet.bloom.filter.expected.ndv#leaf", "20000").partitionBy(
        "day").parquet(paths["requests"])
    stored = spark.read.parquet(paths["requests"])
    actor_ops.actor_table(stored).write.mode("overwrite").parquet(paths["actors"])
    actors = spark.read.parquet(paths["actors"])
    actor_ops.actor_hours(stored).write.mode("overwrite").parquet(paths["actor_hours"])
    actor_ops.days(stored, actors).write.mode("overwrite").parquet(paths["days"])
    alert_ops.alerts(stored, actors).write.mode("overwrite").parquet(paths["alerts"])
    actor_ops.index_totals(stored).write.mode("overwrite").parquet(paths["totals"])
    return paths


def write_version(table: DataFrame, folder: str, version: int) -> str:
    """A new version of a table beside the old one: what reads the old one still can,
    and a job that dies leaves it untouched."""
    path = f"{folder}/v={version:06d}"
    table.write.mode("errorifexists").parquet(path)
    return path


def append_skipped(rows: DataFrame, folder: str) -> None:
    """What was not examined, kept as rows: source, path, reason."""
    rows.select("source", "path", "reason").write.mode("append").parquet(folder)


# --- traces ---------------------------------------------------------------------


def trace_cells(rows: DataFrame) -> DataFrame:
    """The columns of a trace export; every cell that came off the wire is guarded."""
    stamp = F.coalesce(F.date_format(F.timestamp_seconds(times.local_seconds(F.col("epoch"), F.col("tz"))),
                                     "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return rows.select(
        spreadsheet_safe(F.col("client")).alias("Client"), stamp.alias("Time"),
        spreadsheet_safe(F.col("method")).alias("Method"), spreadsheet_safe(F.col("uri")).alias("URI"),
        F.col("status").alias("Status"), F.coalesce(F.col("size").cast("string"), F.lit("")).alias("Size"),
        spreadsheet_safe(F.col("referrer")).alias("Referrer"), spreadsheet_safe(F.col("agent")).alias("User-Agent"),
        spreadsheet_safe(F.col("source")).alias("Source"))


def content_digest(cells: DataFrame) -> DataFrame:
    """Rows and a digest of the content that does not depend on how it was split: each
    row's SHA-256, folded over 256 buckets in order. No task sees all rows."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in cells.columns]), 256)
    # Per bucket: the sum of four 48-bit slices of the row digests, which is the same in
    # any order and counts equal rows as often as they occur.
    slices = [F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    buckets = cells.select(row.alias("h")).groupBy(F.substring("h", 1, 2).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(slices)])
    text = F.concat_ws(":", "b", F.col("n").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return buckets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("sha256"))


def trace_manifest(cells: DataFrame, query: dict[str, str], total: int | None = None) -> DataFrame:
    """What was asked, how much came out, and the digest by which it can be checked."""
    asked = "; ".join(f"{k}: {v}" for k, v in query.items() if v)
    row = content_digest(cells)
    whole = F.col("rows") if total is None else F.lit(total).cast("long")
    return row.select(F.lit(asked).alias("query"), "rows", whole.alias("total"), (whole > F.col("rows")).alias("truncated"), "sha256")


def write_trace(cells: DataFrame, folder: str, query: dict[str, str]) -> None:
    cells.write.mode("overwrite").option("header", True).csv(f"{folder}/trace")
    written = cells.sparkSession.read.option("header", True).schema(
        ", ".join(f"`{c}` string" for c in cells.columns)).csv(f"{folder}/trace")
    trace_manifest(written, query).write.mode("overwrite").json(f"{folder}/manifest")


# --- indicators -----------------------------------------------------------------


def related_words(readings: DataFrame) -> DataFrame:
    """Relations of an indicator in words, in text order, all of them: a cell is as long as
    its indicator has relations."""
    words = readings.select("value", F.concat_ws(" ", "relation", "other").alias("w")).distinct()
    return words.groupBy("value").agg(F.array_join(F.array_sort(F.collect_list("w")), "; ").alias("related"))


def ioc_csv(stored: DataFrame, edge_rows: DataFrame, spans: DataFrame) -> DataFrame:
    dated = ioc_ops.with_spans(stored, spans)
    related = related_words(ioc_ops.readings(edge_rows))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return dated.join(related, "value", "left").select(
        spreadsheet_safe(F.col("value"), also_control=True).alias("Value"), F.col("type").alias("Type"),
        F.array_join("tags", " ").alias("Tags"), blank("note").alias("Note"), blank("origin").alias("Origin"),
        F.col("added").alias("Added"), blank("first_seen").alias("First seen (log date)"),
        blank("last_seen").alias("Last seen (log date)"), blank("related").alias("Related"))


def ioc_json(stored: DataFrame, edge_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One JSON object per indicator; relations are rows of their own kind beside it, so
    no indicator grows with its edges."""
    entries = ioc_ops.with_spans(stored, spans).select(F.lit("indicator").alias("object"), F.to_json(F.struct(
        "value", "type", "tags", "note", "origin", "added", F.col("first_seen").cast("string").alias("first_seen"),
        F.col("last_seen").cast("string").alias("last_seen"))).alias("json"))
    relations = ioc_ops.readings(edge_rows).select(F.lit("relation").alias("object"), F.to_json(
        F.struct("value", "relation", "other", "other_type", "note")).alias("json"))
    return entries.unionAll(relations)


def chain_json(events: DataFrame) -> DataFrame:
    """The chronology's events as JSON objects of the same export."""
    return events.select(F.lit("event").alias("object"), F.to_json(F.struct(*events.columns)).alias("json"))


def frame_note(mode: str, offsets: Column) -> Column:
    """In which frame the exported times are: UTC, one offset, or several."""
    known = F.array_join(F.transform(offsets, times.offset_label), ", ")
    if mode == "utc":
        text = F.lit(fixed.FRAME_TEXT["utc"])
    else:
        one = F.format_string(fixed.FRAME_TEXT["one"], F.when(known == "", "UTC").otherwise(known))
        text = F.when(F.size(offsets) > 1, F.format_string(fixed.FRAME_TEXT["several"], known)).otherwise(one)
    return F.concat(text, F.lit(fixed.FRAME_END))


def _stix_id(kind: str, *parts: Column) -> Column:
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    return F.concat(F.lit(kind + "--"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"),
                    F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def stix_indicators(stored: DataFrame, spans: DataFrame) -> DataFrame:
    """STIX 2.1 indicator columns; ids follow from the content, so a second export of
    the same box is the same bundle."""
    dated = ioc_ops.with_spans(stored, spans).withColumn("pattern", ind.stix_pattern(F.col("value"), F.col("type"))).filter(
        "pattern is not null")
    text = F.when(F.coalesce("note", F.lit("")) != "", F.col("note")).otherwise(F.coalesce("origin", F.lit("")))
    active = F.concat(F.lit("Active in the case's logs "), F.col("first_seen").cast("string"), F.lit(" to "),
                      F.coalesce("last_seen", "first_seen").cast("string"), F.lit(" (log-local dates)."))
    return dated.select(
        _stix_id("indicator", F.col("type"), F.col("value")).alias("id"), "value",
        F.concat_ws(": ", "type", "value").alias("name"),
        F.trim(F.when(F.col("first_seen").isNotNull(), F.concat_ws(" ", text, active)).otherwise(text)).alias("description"),
        F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("indicator"))).alias("labels"), "pattern")


def stix_relationships(edge_rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """One relationship per edge both of whose ends are in the bundle."""
    ids = indicators.select("value", "id")
    label = F.col("kind")
    for kind, forward, _ in fixed.LINK_LABELS:
        label = F.when(F.col("kind") == kind, forward).otherwise(label)
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit(" ("), "note", F.lit(")"))).otherwise("")
    return (
        edge_rows.join(ids.select(F.col("value").alias("src"), F.col("id").alias("source_ref")), "src")
        .join(ids.select(F.col("value").alias("dst"), F.col("id").alias("target_ref")), "dst")
        .select(_stix_id("relationship", F.col("kind"), F.col("src"), F.col("dst")).alias("id"), "source_ref", "target_ref",
                F.concat(F.col("kind"), F.lit(" — "), F.col("src"), F.lit(" "), label, F.lit(" "), F.col("dst"), note).alias("description"))
    )


def stix_objects(indicators: DataFrame, relationships: DataFrame, created: str) -> DataFrame:
    """The objects of a bundle, one JSON text per row."""
    common = [F.lit("2.1").alias("spec_version")]
    stamps = [F.lit(created).alias("created"), F.lit(created).alias("modified")]
    one = indicators.select(F.to_json(F.struct(
        F.lit("indicator").alias("type"), *common, "id", *stamps, "name", "description", "labels", "pattern",
        F.lit("stix").alias("pattern_type"), F.lit(created).alias("valid_from"))).alias("json"))
    two = relationships.select(F.to_json(F.struct(
        F.lit("relationship").alias("type"), *common, "id", *stamps, F.lit("related-to").alias("relationship_type"),
        "description", "source_ref", "target_ref")).alias("json"))
    return one.unionAll(two)


# --- accounts -------------------------------------------------------------------


def account_cells(found: DataFrame, admins_only: bool = False) -> DataFrame:
    """The reset list after an incident; password hashes are not in it."""
    rows = found.filter("admin") if admins_only else found
    return rows.orderBy(*account_ops.account_order()).select(
        spreadsheet_safe(F.col("login")).alias("Login"), F.col("email").alias("E-mail"),
        F.when(F.col("admin"), "administrator").otherwise("user").alias("Role"), F.col("cms").alias("CMS"),
        F.col("table").alias("Table"), F.col("registered").alias("Registered"), F.col("last_login").alias("Last login"),
        F.col("hash_type").alias("Hash scheme"), F.when(F.col("blocked") > 0, "yes").otherwise("no").alias("Blocked"),
        F.array_join("signals", ", ").alias("Conspicuous"))

"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

REQUESTS = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("epoch", T.LongType()),      # seconds UTC, NULL = undated
    T.StructField("tz", T.IntegerType()),      # offset seconds of that line
    T.StructField("method", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("leaf", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("size", T.LongType()),       # NULL = not recorded
    T.StructField("referrer", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("source", T.StringType()),   # the file's full path, never its name
    T.StructField("pos", T.LongType()),        # order inside the source
])

FINDINGS = T.StructType([
    T.StructField("fingerprint", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("severity", T.IntegerType()),
    T.StructField("rule", T.StringType()),
    T.StructField("rule_id", T.StringType()),
    T.StructField("artifact_kind", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("line", T.LongType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("created", T.LongType()),
    T.StructField("last_seen", T.LongType()),
    T.StructField("triage", T.StringType()),
    T.StructField("triage_note", T.StringType()),
    T.StructField("triaged_at", T.LongType()),
    T.StructField("engine", T.StringType()),
    T.StructField("seen_run", T.LongType()),
])

IOCS = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("note", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("origin", T.StringType()),
    T.StructField("added", T.LongType()),
])

IOC_LINKS = T.StructType([
    T.StructField("src", T.StringType()),      # the indicator's value is its key
    T.StructField("dst", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("note", T.StringType()),
])

IOC_SOURCES = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("artifact", T.StringType()),
    T.StructField("role", T.StringType()),
    T.StructField("active", T.BooleanType()),
])

PATTERNS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("patterns", T.ArrayType(T.StringType())),
    T.StructField("match", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("cve", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("origin", T.StringType()),
])

SKIPPED = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("reason", T.StringType()),
])

DUMP_ROWS = T.StructType([
    T.StructField("dump", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("row_no", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("values", T.ArrayType(T.StringType())),
])

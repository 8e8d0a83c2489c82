"""Report sections as data: decisions, indicators, with the examiner's paths removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail.functions import uris


def redact(text: Column, roots: list[str]) -> Column:
    """Evidence roots, longest first and in both slash spellings, become a placeholder."""
    spellings = set()
    for root in roots:
        base = root.rstrip("/\\")
        if base:
            spellings |= {base, base.replace("\\", "/"), base.replace("/", "\\")}
    out = F.coalesce(text, F.lit(""))
    for spelling in sorted(spellings, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(spelling), F.lit("[evidence]"))
    return out


def decisions(findings: DataFrame, roots: list[str]) -> DataFrame:
    """Confirmed artifacts with their worst severity, rules and notes.

    Rules are a closed list and a note belongs to a decision, so the sets per artifact
    stay small however many findings it has."""
    rule = F.when(F.coalesce("rule_id", F.lit("")) != "", F.concat("rule", F.lit(" ["), "rule_id", F.lit("]"))).otherwise(F.col("rule"))
    distinct = findings.filter(F.col("triage") == "confirmed").groupBy(
        "artifact_kind", "artifact", redact(rule, roots).alias("rule"), redact(F.col("triage_note"), roots).alias("note")).agg(
        F.min("severity").alias("severity"), F.max("triaged_at").alias("triaged_at"))
    shown = F.when(F.col("artifact_kind") == "file", uris.web_path(F.col("artifact"), roots)).otherwise(F.col("artifact"))
    return distinct.groupBy("artifact_kind", "artifact").agg(
        F.min("severity").alias("severity"), F.array_sort(F.collect_set("rule")).alias("rules"),
        F.array_sort(F.collect_set(F.when(F.col("note") != "", F.col("note")))).alias("notes"),
        F.max("triaged_at").alias("triaged_at")).withColumn("artifact", redact(shown, roots))


def indicators(stored: DataFrame, readings: DataFrame, roots: list[str], related: int = 50) -> DataFrame:
    """Indicators with their relations in words. A relation list is for reading: the
    count is exact, the list ends after the first few in text order."""
    from pyspark.sql import Window

    words = readings.select("value", F.concat_ws(" ", "relation", redact(F.col("other"), roots)).alias("words"))
    place = F.row_number().over(Window.partitionBy("value").orderBy("words"))
    totals = words.groupBy("value").agg(F.count(F.lit(1)).alias("relations"))
    listed = words.withColumn("n", place).filter(F.col("n") <= related).groupBy("value").agg(
        F.array_sort(F.collect_list("words")).alias("related"))
    value = F.when(F.col("type") == "path", uris.evidence_path(F.col("value"), roots)).otherwise(F.col("value"))
    return (
        stored.join(totals, "value", "left").join(listed, "value", "left")
        .select(redact(value, roots).alias("value"), "type", "tags", redact(F.col("note"), roots).alias("note"),
                redact(F.col("origin"), roots).alias("origin"),
                F.coalesce("relations", F.lit(0)).alias("relations"),
                F.coalesce("related", F.array().cast("array<string>")).alias("related"))
    )

"""Rule data: pattern libraries and declarative log rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed, schemas
from webtrail.operators import sigma

# Current and older names of a library entry's fields.
_LEGACY = {"name": "label", "cve": "note", "description": "about"}
_ENTRY = ("id string, patterns array<string>, pattern string, match string, name string, label string, cve string,"
          " note string, description string, about string")


def bundled_patterns(spark: SparkSession) -> DataFrame:
    rows = [(i, list(p), m, n, c, "", "bundled") for i, p, m, n, c in fixed.BUNDLED_PATTERNS]
    return spark.createDataFrame(rows, schemas.PATTERNS)


def _normal(entries: DataFrame) -> DataFrame:
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    paths = F.filter(F.transform(F.coalesce("patterns", F.array("pattern")), lambda p: F.trim(p)), lambda p: p != "")
    named = {new: F.when(text(new) != "", text(new)).otherwise(text(old)) for new, old in _LEGACY.items()}
    mode = F.lower(text("match"))
    return entries.withColumns({
        "patterns": paths, **named, "match": F.when(mode.isin("any", "all"), mode).otherwise("any"),
        "origin": F.lit("own")}).filter(F.size("patterns") > 0).withColumn("id", F.coalesce(
            "id", F.substring(F.sha2(F.concat_ws("|", "match", F.array_join("patterns", "|")), 256), 1, 12))).select(
        *[f.name for f in schemas.PATTERNS])


def json_patterns(spark: SparkSession, path: str) -> DataFrame:
    """A library file: a list of entries, or an object with ``patterns``; older field
    names are read as well. A file that cannot be read gives no entry."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_struct()}>>")
    inside = F.from_json("value", f"struct<patterns:array<struct<{_struct()}>>>")["patterns"]
    bare = F.ltrim("value").startswith("[")
    return _normal(raw.select(F.inline(F.when(bare, listed).otherwise(inside))))


def _struct() -> str:
    return ", ".join(f"{part.split(' ')[0]}:{part.split(' ')[1]}" for part in (p.strip() for p in _ENTRY.split(",")))


def line_patterns(lines: DataFrame) -> DataFrame:
    """``pattern | name | advisory`` lines with ``#`` comments. ``lines``: value."""
    text = F.trim("value")
    part = F.split(text, r"\|", 3)
    rows = lines.filter((text != "") & ~text.startswith("#")).select(
        F.lit(None).cast("string").alias("id"), F.array(part[0]).alias("patterns"), F.lit(None).cast("string").alias("pattern"),
        F.lit("any").alias("match"), F.get(part, F.lit(1)).alias("name"), F.lit("").alias("label"),
        F.get(part, F.lit(2)).alias("cve"), F.lit("").alias("note"), F.lit("").alias("description"), F.lit("").alias("about"))
    return _normal(rows)


def load_sigma(texts: dict[str, str], disabled: list[str] | None = None) -> tuple[list[dict], list[tuple[str, str, str]]]:
    """(usable rules, skipped rows) from rule files by name. Rules are configuration of a
    few files, read on the driver; a file that cannot be used is reported."""
    import yaml

    usable, broken = [], []
    for name, text in sorted(texts.items()):
        try:
            rule = sigma.compile_rule(yaml.safe_load(text))
        except (sigma.UnsupportedRule, yaml.YAMLError) as problem:
            broken.append(("sigma", name, f"rule not usable: {problem}"))
            continue
        if rule["id"] not in (disabled or []):
            usable.append({**rule, "file": name})
    return usable, broken

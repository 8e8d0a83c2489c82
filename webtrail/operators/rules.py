"""The catalogue of every built-in rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webtrail import fixed_values as fixed

ENGINES = ("webshell", "sqldb", "logs", "errorlog")
_SCHEMA = "id string, engine string, severity int, name string, format string, pattern string"


def rule_rows() -> list[tuple]:
    rows = [(i, s, n, "builtin", "") for i, s, n in fixed.STRUCTURAL_RULES]
    rows += [(i, s, n, "regex", p) for i, s, n, p in fixed.CONTENT_RULES]
    rows += [(*fixed.NO_PHP_RULE, "regex", "<html and no <?")]
    rows += [(*fixed.HTACCESS_HANDLER, "regex", " | ".join(fixed.HTACCESS_HANDLER_PATTERNS)),
             (*fixed.HTACCESS_PREPEND, "regex", fixed.HTACCESS_PREPEND_PATTERN)]
    rows += [(i, s, n, "regex", p) for i, s, n, p in fixed.VALUE_RULES]
    rows += [(f"logs.{k}", s, n, "builtin", "") for k, s, n in fixed.ALERT_RULES]
    rows += [(i, s, n, "builtin", "") for i, s, n in fixed.ERROR_RULES]
    out = [(i, i.split(".", 1)[0], s, n, f, p) for i, s, n, f, p in rows]
    return sorted(out, key=lambda r: (ENGINES.index(r[1]), r[2], r[0]))


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), _SCHEMA)


def switched(rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """The enabled rules; an id nobody knows in the off-list switches nothing off."""
    return rules.join(disabled.select("id").distinct(), "id", "left_anti")

"""Declarative log rules (SIGMA mappings) as Columns.

A rule is a mapping of selections and a condition over their names. A selection
becomes one boolean Column. The condition keeps SQL's own words, so after ``1 of`` and
``all of`` are written out it is handed to Spark's expression parser.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import predicates as is_, uris
from webtrail.functions.text import fingerprint, like_text


class UnsupportedRule(ValueError):
    """A rule that cannot be answered. It is reported, never matched to nothing."""


def fields() -> dict[str, Column]:
    return {
        "c-uri": F.col("uri"), "c-uri-query": uris.uri_query(F.col("uri")),
        "cs-uri-stem": uris.uri_stem(F.col("uri")), "c-useragent": F.col("agent"),
        "cs-method": F.col("method"), "sc-status": F.col("status"), "sc-bytes": F.col("size"),
        "c-ip": F.col("ip"), "src_ip": F.col("ip"),
    }


def wildcard_like(value) -> str:
    """``*`` and ``?`` become LIKE wildcards, ``\\*``, ``\\?`` and ``\\\\`` themselves."""
    def piece(match):
        token = match.group(0)
        if len(token) == 2:
            return like_text(token[1])
        return {"*": "%", "?": "_"}.get(token) or like_text(token)

    return re.sub(r"\\[*?\\]|.", piece, str(value), flags=re.DOTALL)


def has_wildcard(value: str) -> bool:
    return re.search(r"(?<!\\)[*?]", value) is not None


def _value_test(column: Column, value, modifier: str) -> Column:
    text = column.cast("string")
    if value is None:
        return column.isNull() | (text == "")
    if modifier:
        inside = wildcard_like(value)
        shape = {"contains": f"%{inside}%", "startswith": f"{inside}%", "endswith": f"%{inside}"}[modifier]
        return text.ilike(shape)
    if isinstance(value, bool):
        raise UnsupportedRule("a boolean is not a value a log line can be compared with")
    if isinstance(value, str):
        return text.ilike(wildcard_like(value)) if has_wildcard(value) else text == value
    return column == value


def selection(name: str, spec) -> Column:
    """Entries are ANDed; the values of one entry are ORed, or ANDed with ``all``."""
    if not isinstance(spec, dict):
        raise UnsupportedRule(f"selection '{name}' is not a mapping")
    if not spec:
        raise UnsupportedRule(f"selection '{name}' is empty")
    tests, known = [], fields()
    for key, raw in spec.items():
        field, *modifiers = str(key).split("|")
        modifiers = [m for m in modifiers if m]
        unknown = sorted(set(modifiers) - set(fixed.SIGMA_MODIFIERS))
        if unknown:
            raise UnsupportedRule(f"modifier(s) {unknown} on '{field}'")
        if field not in known:
            raise UnsupportedRule(f"field '{field}' is not in the log index")
        modifier = next((m for m in modifiers if m != "all"), "")
        values = raw if isinstance(raw, list) else [raw]
        join = Column.__and__ if "all" in modifiers else Column.__or__
        tests.append(reduce(join, [_value_test(known[field], v, modifier) for v in values]))
    return reduce(Column.__and__, tests)


_WORDS = {"and", "or", "not"}


def condition_text(condition, names: list[str]) -> str:
    """The condition as a Spark SQL expression over columns ``s_<selection>``."""
    text = str(condition or "").strip().lower()
    if not text:
        raise UnsupportedRule("the rule has no condition")

    def quantified(match):
        how, pattern = match.group(1), match.group(2)
        chosen = names if pattern == "them" else [
            n for n in names if re.fullmatch(pattern.replace("*", ".*"), n)]
        if not chosen:
            raise UnsupportedRule(f"'{pattern}' matches no selection")
        return "(" + (" and " if how == "all" else " or ").join(f"`s_{n}`" for n in chosen) + ")"

    done = []
    rest = re.sub(r"\b(1|all) of ([\w*]+)", lambda m: done.append(quantified(m)) or f"@{len(done) - 1}@", text)

    def name(match):
        token = match.group(0)
        if token in _WORDS:
            return token
        if token not in names:
            raise UnsupportedRule(f"the condition names '{token}', which is no selection of this rule")
        return f"`s_{token}`"

    if not re.fullmatch(r"[\w\s()@]*", rest):
        raise UnsupportedRule(f"could not read the whole condition: {condition!r}")
    named = re.sub(r"(?<!@)\b[a-z_]\w*\b", name, rest)
    return re.sub(r"@(\d+)@", lambda m: done[int(m.group(1))], named)


def compile_rule(doc) -> dict:
    """A rule mapping as {id, title, severity, level, selections, condition}."""
    if not isinstance(doc, dict):
        raise UnsupportedRule("a rule is a mapping")
    detection = doc.get("detection")
    if not isinstance(detection, dict):
        raise UnsupportedRule("the rule has no detection block")
    if "timeframe" in detection:
        raise UnsupportedRule("timeframe needs an aggregation")
    condition = detection.get("condition")
    if isinstance(condition, str) and "|" in condition:
        raise UnsupportedRule("aggregation in a condition is not supported")
    parts = {str(k).lower(): selection(str(k), v) for k, v in detection.items() if k != "condition"}
    expression = condition_text(condition, list(parts))
    rule = {key: str(doc.get(key) or "").strip() for key in ("id", "title", "description", "level")}
    for key in ("id", "title"):
        if not rule[key]:
            raise UnsupportedRule(f"the rule has no {key}")
    rule["severity"] = fixed.SIGMA_LEVELS.get(rule["level"].lower(), fixed.MEDIUM)
    return {**rule, "selections": parts, "condition": expression}


def matched_rules(requests: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_id, request) rows: every rule of the list in one pass over the logs."""
    columns = {f"s_{n}__{i}": c for i, r in enumerate(rules) for n, c in r["selections"].items()}
    flags = []
    for i, rule in enumerate(rules):
        text = re.sub(r"`(s_\w+)`", lambda m, i=i: f"`{m.group(1)}__{i}`", rule["condition"])
        flags.append(F.when(F.expr(text), F.lit(rule["id"])))
    marked = requests.withColumns(columns).withColumn("rule_ids", F.array_compact(F.array(*flags)))
    return (marked.filter(F.size("rule_ids") > 0)
            .select("ip", "epoch", "uri", "status", F.explode("rule_ids").alias("rule_id")))


def matching_clients(requests: DataFrame, rules: list[dict]) -> DataFrame:
    """Per rule and client: hits, 2xx hits, first, last and one example target."""
    return matched_rules(requests, rules).groupBy("rule_id", "ip").agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok_hits"),
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
        F.min(F.struct(F.coalesce("epoch", F.lit(2**62)).alias("at"), F.col("uri")))["uri"].alias("example"))


def findings(clients: DataFrame, rules: list[dict]) -> DataFrame:
    """Findings per (rule, client). Without a 2xx the severity can only get milder."""
    title, severity = F.lit(""), F.lit(fixed.MEDIUM)
    for rule in rules:
        here = F.col("rule_id") == rule["id"]
        title = F.when(here, rule["title"]).otherwise(title)
        severity = F.when(here, rule["severity"]).otherwise(severity)
    rows = clients.select(
        F.lit("logs").alias("source"),
        F.when(F.col("ok_hits") > 0, severity).otherwise(F.greatest(severity, F.lit(fixed.LOW))).alias("severity"),
        title.alias("rule"), "rule_id", F.lit("client").alias("artifact_kind"), F.col("ip").alias("artifact"),
        F.lit(None).cast("long").alias("line"),
        F.substring(F.concat(
            F.col("hits").cast("string"), F.lit("x matched, of those "), F.col("ok_hits").cast("string"),
            F.lit("x 2xx - SIGMA rule "), F.col("rule_id"),
            F.when(F.col("example") != "", F.concat(F.lit(" - e.g. "), F.col("example"))).otherwise("")),
            1, 400).alias("evidence"),
        F.lit("sigmascan").alias("engine"))
    return rows.withColumn("fingerprint", fingerprint(
        F.col("source"), F.col("rule"), F.col("artifact"), F.col("line")))

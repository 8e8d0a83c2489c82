"""Outcome-gated alerts: what the counters of a client amount to.

A probe is an alert only when at least one such request was answered 2xx. A refused
wave stays visible as a counter on the client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import times
from webtrail.functions.text import fingerprint, grouped_number
from webtrail.operators import actors as actor_ops

_SEVERITY = {kind: severity for kind, severity, _ in fixed.ALERT_RULES}
ALERT_SCHEMA = "ip string, kind string, severity int, detail string, example string"


def answer_span(kind: str) -> Column:
    """What the 2xx answers carried: the size span and how many logged none."""
    text = fixed.ANSWER_TEXT
    sized, unsized = F.col(f"{kind}_sized"), F.col(f"{kind}_unsized")
    ends = F.array_distinct(F.array(f"{kind}_size_min", f"{kind}_size_max"))
    shown = F.format_string(text["sizes"], F.array_join(F.transform(ends, grouped_number), "-"))
    return F.array_join(F.array_compact(F.array(
        F.when(sized > 0, shown),
        F.when((sized > 0) & (unsized > 0), F.format_string(text["more"], unsized)),
        F.when((sized == 0) & (unsized > 0), F.lit(text["none"])))), "")


def status_breakdown(statuses: Column) -> Column:
    entries = F.array_sort(F.map_entries(statuses))
    return F.array_join(F.transform(
        entries, lambda e: F.concat(e["key"].cast("string"), F.lit(" ×"), e["value"].cast("string"))), ", ")


def login_success() -> Column:
    """A flood, a burst of it inside 24 hours, and a page only a session is served."""
    return ((F.col("login_posts") >= fixed.LOGIN_THRESHOLD)
            & (F.col("login_burst") >= fixed.LOGIN_THRESHOLD) & (F.col("admin_ok") > 0))


def _alert(kind: str, gate: Column, detail: Column, example: Column | None = None) -> Column:
    return F.when(gate, F.struct(
        F.lit(kind).alias("kind"), F.lit(_SEVERITY[kind]).alias("severity"),
        detail.alias("detail"), (F.lit("") if example is None else example).alias("example")))


def counter_alerts(actors: DataFrame) -> DataFrame:
    """Every alert that follows from the counters, unpivoted from one actor row."""
    flood = F.col("login_posts") >= fixed.LOGIN_THRESHOLD
    flood_text = F.concat(
        F.col("login_posts").cast("string"), F.lit(" POSTs against login endpoints "),
        times.login_rate(F.col("login_posts"), F.col("login_first"), F.col("login_last")),
        F.lit("(status: "), status_breakdown(F.col("login_statuses")), F.lit(")"))
    success_text = F.format_string(
        "%d login POSTs, %d of them inside 24 h, then %d request(s) to the admin backend answered 2xx "
        "— a page an unauthenticated session does not get. Verify!",
        "login_posts", "login_burst", "admin_ok")

    def probe(kind, text, tail=""):
        return _alert(
            kind, F.col(f"{kind}_ok") > 0,
            F.concat(F.format_string("%d of %d " + text, f"{kind}_ok", f"{kind}_attempts"),
                     answer_span(kind), F.lit(tail)),
            F.col(f"{kind}_example"))

    found = F.array_compact(F.array(
        _alert("login_flood", flood, flood_text),
        _alert("login_success", login_success(), success_text),
        probe("upload_php", "request(s) for PHP in upload/cache directories were answered 2xx",
              " — access to a dropped shell?"),
        probe("cms_dir_php", "request(s) for a PHP file lying directly in templates/, modules/, "
              "plugins/ or components/ were answered 2xx", " — the CMS ships nothing at that depth"),
        probe("sqli", "SQL injection patterns in URIs were answered 2xx"),
        probe("traversal", "path traversal patterns were answered 2xx"),
    ))
    return actors.select("ip", F.inline(found))


def scanner_alerts(agents: DataFrame) -> DataFrame:
    """One informational alert per distinct scanner agent of a client."""
    return agents.select(
        "ip", F.lit("scanner_ua").alias("kind"), F.lit(_SEVERITY["scanner_ua"]).alias("severity"),
        F.concat(F.lit("UA: "), F.col("agent")).alias("detail"), F.lit("").alias("example"))


def alerts(requests: DataFrame, actors: DataFrame | None = None) -> DataFrame:
    marked = actor_ops.flagged(requests)
    table = actor_ops.actor_table(marked) if actors is None else actors
    return counter_alerts(table).unionByName(scanner_alerts(actor_ops.scanner_agents(marked)))


def severity_by_kind(alerts_df: DataFrame) -> DataFrame:
    """The kind decides the severity, also of alerts an older index stored."""
    known = F.col("kind").isin(*fixed.INFO_ALERT_KINDS)
    return alerts_df.withColumn("severity", F.when(known, fixed.INFO).otherwise(F.col("severity")))


def findings_from_alerts(alerts_df: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Alerts restated as findings on the client."""
    rule, severity = F.col("kind"), F.lit(fixed.MEDIUM + 1)
    for kind, sev, text in fixed.ALERT_RULES:
        rule = F.when(F.col("kind") == kind, text).otherwise(rule)
        severity = F.when(F.col("kind") == kind, sev).otherwise(severity)
    rows = alerts_df.select(
        F.lit("logs").alias("source"), severity.alias("severity"), rule.alias("rule"),
        F.concat(F.lit("logs."), F.col("kind")).alias("rule_id"),
        F.lit("client").alias("artifact_kind"), F.col("ip").alias("artifact"),
        F.lit(None).cast("long").alias("line"), F.col("detail").alias("evidence"),
        F.lit("logindex").alias("engine"))
    if disabled:
        rows = rows.filter(~F.col("rule_id").isin(*disabled))
    return rows.withColumn("fingerprint", fingerprint(
        F.col("source"), F.col("rule"), F.col("artifact"), F.col("line")))


def alerts_of_actors(actors: DataFrame, alerts_df: DataFrame) -> DataFrame:
    """Client rows with their alerts attached, worst first.

    The list per client is bounded by the kinds; the scanner agents, which are not,
    travel as a count and a short sample beside it."""
    severe = severity_by_kind(alerts_df)
    listed = (
        severe.filter(~F.col("kind").isin(*fixed.INFO_ALERT_KINDS)).groupBy("ip")
        .agg(F.array_sort(F.collect_list(F.struct("severity", "kind", "detail", "example"))).alias("alerts"))
    )
    info = (severe.filter(F.col("kind").isin(*fixed.INFO_ALERT_KINDS))
            .groupBy("ip").agg(F.count(F.lit(1)).alias("info_alerts")))
    empty = F.array().cast("array<struct<severity:int,kind:string,detail:string,example:string>>")
    return (
        actors.join(listed, "ip", "left").join(info, "ip", "left")
        .withColumns({"alerts": F.coalesce("alerts", empty),
                      "info_alerts": F.coalesce("info_alerts", F.lit(0))})
    )


def overview(requests: DataFrame, alerts_df: DataFrame) -> DataFrame:
    """Headline numbers of the logs in one row."""
    serious = alerts_df.filter(~F.col("kind").isin(*fixed.INFO_ALERT_KINDS))
    alerted = serious.select(F.count_distinct("ip")).scalar()
    return actor_ops.index_totals(requests).withColumn("alerted_clients", alerted)


def badges() -> Column:
    """What stands out about a client, by name, in display order."""
    c = F.col
    flood = c("login_posts") >= fixed.LOGIN_THRESHOLD
    return F.array_compact(F.array(
        F.when(login_success(), "loginSuccess"),
        F.when(c("cms_dir_php_ok") > 0, "cmsDirPhp"),
        F.when(c("upload_php_ok") > 0, "shellAccess"),
        F.when(flood, "bruteForce"),
        F.when(F.size("scanner_uas") > 0, "scanner"),
        F.when(c("sqli_ok") > 0, "sqliOk").when(c("sqli_attempts") > 0, "sqliAttempts"),
        F.when(c("traversal_ok") > 0, "traversal"),
    ))


def actor_tags() -> Column:
    """The tags a client carries into the indicator box."""
    flood = F.col("login_posts") >= fixed.LOGIN_THRESHOLD
    return F.array_compact(F.array(
        F.lit("actor"),
        F.when(F.size("scanner_uas") > 0, "scanner"),
        F.when(flood, "brute-force"),
        F.when(login_success(), "successful"),
    ))

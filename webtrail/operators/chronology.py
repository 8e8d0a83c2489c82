"""The measured chronology of a case: six kinds of events, each with its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import times, uris

EVENT_COLUMNS = ("at", "kind", "title", "detail", "source", "artifact", "artifact_kind", "ip", "severity")


def alert_times(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts with the first time their client asked for the target that raised them.

    Alerts are few, so the requests are reduced to their (client, target) pairs before
    they are grouped."""
    named = alerts.filter("example <> ''").select("ip", F.col("example").alias("uri")).distinct()
    met = requests.join(named, ["ip", "uri"], "left_semi").groupBy("ip", "uri").agg(F.min("epoch").alias("epoch"))
    return alerts.join(met.withColumnRenamed("uri", "example"), ["ip", "example"], "left").select(
        "ip", "kind", "severity", "detail", "example", "epoch")


def file_facts(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(leaf, target, client): first and last request, first and last 2xx answer, hits."""
    from webtrail.functions import predicates as is_

    ok = is_.answered_ok(F.col("status"))
    wanted = names.select(uris.leaf(F.col("name")).alias("leaf")).filter("leaf <> ''").distinct()
    return requests.join(wanted, "leaf", "left_semi").groupBy("leaf", "uri", "ip").agg(
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.max("tz").alias("tz"),
        F.count(F.lit(1)).alias("hits"), F.count_if(ok).alias("ok_hits"),
        F.min(F.when(ok, F.col("epoch"))).alias("first_ok"), F.max(F.when(ok, F.col("epoch"))).alias("last_ok"))


def file_offsets(touched: DataFrame) -> DataFrame:
    """One offset per file: the one of largest magnitude among its requests."""
    return touched.groupBy("artifact").agg(F.coalesce(F.max_by("tz", F.struct(F.abs("tz"), "tz")), F.lit(0)).alias("tz"))


def _event(at: Column, kind: str, title: Column, detail: Column, source: str, artifact: Column, artifact_kind: str,
           ip: Column, severity: Column) -> Column:
    return F.when(at.isNotNull(), F.struct(
        at.cast("long").alias("at"), F.lit(kind).alias("kind"), title.alias("title"), detail.alias("detail"),
        F.lit(source).alias("source"), artifact.alias("artifact"), F.lit(artifact_kind).alias("artifact_kind"),
        ip.alias("ip"), severity.cast("int").alias("severity")))


def file_events(confirmed: DataFrame, touched: DataFrame, roots: list[str], mode: str = "log",
                clock: int = 0) -> DataFrame:
    """First 2xx answer, or the first attempt when there was none, and the last access."""
    files = confirmed.filter(F.col("artifact_kind") == "file").select("artifact", "worst")
    first_who = F.min_by("ip", F.struct("first_epoch", "ip"))
    facts = (
        touched.join(files.select("artifact"), "artifact", "left_semi").filter("first_epoch is not null")
        .groupBy("artifact").agg(
            F.min("first_epoch").alias("first_any"), F.max("last_epoch").alias("last_any"),
            F.min("first_ok").alias("first_ok"), F.sum("hits").alias("n"), F.sum("ok_hits").alias("ok"),
            first_who.alias("who"), F.coalesce(F.max_by("tz", F.struct(F.abs("tz"), "tz")), F.lit(0)).alias("tz"))
        .join(files, "artifact")
        .withColumn("name", uris.basename(uris.web_path(F.col("artifact"), roots)))
    )
    tz, art, sev = F.col("tz"), F.col("artifact"), F.col("worst")

    def at(name):
        return times.log_reading(F.col(name), tz, mode, clock)

    probe = F.when(F.col("first_any") < F.col("first_ok"), F.concat(
        F.lit(" It was asked for in vain before, first by "), F.col("who"), F.lit(" at "),
        times.render(at("first_any"), tz, mode), F.lit("."))).otherwise("")
    success = _event(at("first_ok"), "success", F.concat(F.col("name"), F.lit(" answered 2xx for the first time")),
                     F.concat(F.lit("From this moment the file was there."), probe), "log", art, "file", F.lit(""), sev)
    attempt = F.when(F.col("first_ok").isNull(), _event(
        at("first_any"), "attempt", F.concat(F.col("name"), F.lit(" requested for the first time")),
        F.format_string("%d request(s), none answered 2xx", "n"), "log", art, "file", F.lit(""), sev))
    shown = F.coalesce("first_ok", "first_any")
    last = F.when(F.col("last_any") != shown, _event(
        at("last_any"), "last_access", F.concat(F.col("name"), F.lit(" requested for the last time")),
        F.format_string("%d request(s), %d answered 2xx", "n", "ok"), "log", art, "file", F.lit(""), sev))
    return facts.select(F.inline(F.array_compact(F.array(success, attempt, last))))


def client_events(confirmed: DataFrame, actors: DataFrame, timed_alerts: DataFrame, mode: str = "log",
                  clock: int = 0) -> DataFrame:
    """First contact, alerts that are not merely informational, last access."""
    clients = confirmed.filter(F.col("artifact_kind") == "client").select(F.col("artifact").alias("ip"), "worst")
    known = clients.join(actors.select("ip", "requests", "first_epoch", "last_epoch", "tz"), "ip")
    tz, ip, sev = F.col("tz"), F.col("ip"), F.col("worst")

    def at(name):
        return times.log_reading(F.col(name), tz, mode, clock)

    contact = _event(at("first_epoch"), "first_contact", F.concat(F.lit("First request of "), ip),
                     F.format_string("%d request(s) in all", "requests"), "log", ip, "client", ip, sev)
    gone = _event(at("last_epoch"), "last_access", F.concat(F.lit("Last request of "), ip), F.lit(""), "log", ip,
                  "client", ip, sev)
    serious = timed_alerts.filter((F.col("severity") < fixed.INFO) & F.col("epoch").isNotNull())
    alarm = _event(at("epoch"), "alert", F.col("detail"), F.concat(F.lit("Raised by "), F.col("example")), "log", ip,
                   "client", ip, F.col("severity"))
    alarms = serious.join(known.select("ip", "tz"), "ip").select(F.inline(F.array_compact(F.array(alarm))))
    return known.select(F.inline(F.array_compact(F.array(contact, gone)))).unionByName(alarms)


def case_offset(requests: DataFrame) -> Column:
    """The offset of the whole log where it has exactly one, else 0 (a scalar)."""
    one = requests.filter("tz is not null").select(F.when(F.min("tz") == F.max("tz"), F.min("tz")).otherwise(0))
    return one.scalar()


def account_events(accounts: DataFrame, span: DataFrame, clock_logs: int = 0, clock_dump: int = 0) -> DataFrame:
    """Accounts registered inside the logs' window.

    The window is wall clock and does not move with the displayed zone. ``span``: one
    row first_epoch, last_epoch, tz (of the whole log)."""
    low = span.select(F.col("first_epoch") + F.col("tz") + clock_logs).scalar()
    high = span.select(F.col("last_epoch") + F.col("tz") + clock_logs).scalar()
    stamped = accounts.select(
        "login", "admin", "table", (times.naive_seconds(F.col("registered")) + clock_dump).alias("at"),
        (times.naive_seconds(F.col("last_login")) + clock_dump).alias("last")).withColumns({"low": low, "high": high})
    inside = stamped.filter(F.col("at").between(F.col("low"), F.col("high")))
    later = F.when(F.col("last").between(F.col("low"), F.col("high")),
                   F.concat(F.lit("; last login "), F.date_format(F.timestamp_seconds("last"), "yyyy-MM-dd HH:mm:ss"))).otherwise("")
    event = _event(
        F.col("at"), "account",
        F.concat(F.lit("Account "), F.col("login"), F.lit(" registered"), F.when(F.col("admin"), " (administrator)").otherwise("")),
        F.concat(F.lit("from "), F.col("table"), later), "dump", F.lit(""), "", F.lit(""),
        F.when(F.col("admin"), fixed.HIGH).otherwise(fixed.MEDIUM))
    return inside.select(F.inline(F.array_compact(F.array(event))))


def event_order() -> list[Column]:
    return [F.asc("at"), F.asc("kind"), F.asc("artifact"), F.asc("title"), F.asc("detail")]


def capped(events: DataFrame, cap: int | None = None) -> DataFrame:
    """The first events of the story (a top-k), or with no cap the whole sequence."""
    return events if cap is None else events.orderBy(*event_order()).limit(cap)


def missing_from_story(confirmed: DataFrame, events: DataFrame, cap: int | None = None) -> DataFrame:
    """Confirmed artifacts the story does not show, and why: nothing dates them, or
    their events lie beyond the cap."""
    shown = capped(events, cap).select("artifact").distinct()
    dated = events.select("artifact").distinct().withColumn("dated", F.lit(True))
    kind = F.when(F.col("artifact_kind").isin("table", "dump", "file", "client"), F.col("artifact_kind")).otherwise("other")
    return (
        confirmed.select("artifact", "artifact_kind").join(shown, "artifact", "left_anti").join(dated, "artifact", "left")
        .select("artifact", "artifact_kind", F.when(F.col("dated"), "beyond_cap").otherwise(
            F.concat(F.lit("undated."), kind)).alias("why"))
    )


def gap_statements(confirmed: DataFrame, events: DataFrame, span_first: DataFrame, cap: int | None = None,
                   clock_logs: int = 0, clock_dump: int = 0) -> DataFrame:
    """What the story cannot say, as flags in one row. ``span_first``: one value, the
    displayed time of the log's first request."""
    facts = confirmed.agg(F.count(F.lit(1)).alias("confirmed"), F.count_if(F.col("artifact_kind") == "file").alias("files"))
    with_events = facts.withColumns({
        "events": events.select(F.count(F.lit(1))).scalar(),
        "first_at": events.select(F.min("at")).scalar(),
        "successes": events.select(F.count_if(F.col("kind") == "success")).scalar(),
        "log_start": span_first.scalar(),
    })
    return with_events.select(
        (F.col("confirmed") == 0).alias("none_confirmed"),
        ((F.col("confirmed") > 0) & (F.col("events") == 0)).alias("no_times"),
        F.coalesce(F.col("first_at") - F.col("log_start") < 60, F.lit(False)).alias("at_log_start"),
        ((F.col("files") > 0) & (F.col("successes") == 0)).alias("only_attempts"),
        (F.lit(False) if cap is None else F.col("events") > cap).alias("truncated"),
        F.lit(clock_logs != 0).alias("logs_clock_set"), F.lit(clock_dump != 0).alias("dump_clock_set"),
        F.col("events").alias("total_events"))


def milestones(events: DataFrame) -> DataFrame:
    """First event, first success, first account, first alert and last event; one event
    in two roles keeps the first."""
    row = F.struct("at", "kind", "artifact", "title")
    one = events.agg(
        F.min(row).alias("first"), F.min(F.when(F.col("kind") == "success", row)).alias("first_success"),
        F.min(F.when(F.col("kind") == "account", row)).alias("account"),
        F.min(F.when(F.col("kind") == "alert", row)).alias("first_alert"), F.max(row).alias("last"))
    roles = ("first", "first_success", "account", "first_alert", "last")
    listed = one.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(r).alias("role"), F.col(r).alias("e")) for i, r in enumerate(roles)])).alias("m"))
    flat = listed.filter("m.e is not null").select("m.rank", "m.role", "m.e.*")
    # Five rows at most.
    keep = F.row_number().over(Window.partitionBy("at", "kind", "artifact", "title").orderBy("rank"))
    return flat.withColumn("n", keep).filter("n = 1").select("role", "at", "kind", "title", "artifact")

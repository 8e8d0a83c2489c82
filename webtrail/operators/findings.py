"""Findings: upsert, retirement, the fold per artifact, and the work list.

A finding is identified by source, rule text, artifact and line. Decisions belong to
artifacts. A completed run retires what it did not reproduce; nothing is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions.text import holds

_REFRESHED = ("severity", "evidence", "rule_id", "engine")


def upsert(stored: DataFrame, found: DataFrame, run: int, now: int) -> DataFrame:
    """Merge a run's findings into the stored ones.

    Known rows get the new severity, evidence, rule id, engine and run; their birth,
    decision and note stay. One full outer join on the fingerprint; the result is a new
    version of the table, never an edit in place.
    """
    # The same finding twice in one run: one row wins, whole, in a fixed order.
    names = [c for c in found.columns if c not in ("fingerprint", "evidence")]
    row = F.max(F.struct("evidence", *names))
    fresh = found.groupBy("fingerprint").agg(row.alias("r")).select(
        "fingerprint", *[F.col("r")[c].alias(f"n_{c}") for c in ["evidence", *names]])
    both = stored.join(fresh, "fingerprint", "full_outer")
    seen = F.col("n_source").isNotNull()

    def keep(name):
        return F.coalesce(F.col(name), F.col(f"n_{name}")).alias(name)

    def renew(name):
        return F.when(seen, F.col(f"n_{name}")).otherwise(F.col(name)).alias(name)

    return both.select(
        "fingerprint", keep("source"), renew("severity"), keep("rule"), renew("rule_id"),
        keep("artifact_kind"), keep("artifact"), keep("line"), renew("evidence"),
        F.coalesce("created", F.lit(now)).cast("long").alias("created"),
        F.when(seen, F.lit(now)).otherwise(F.col("last_seen")).cast("long").alias("last_seen"),
        F.coalesce("triage", F.lit("new")).alias("triage"),
        F.coalesce("triage_note", F.lit("")).alias("triage_note"), "triaged_at", renew("engine"),
        F.when(seen, F.lit(run)).otherwise(F.col("seen_run")).cast("long").alias("seen_run"))


def empty_findings(spark) -> DataFrame:
    from webtrail import schemas

    return spark.createDataFrame([], schemas.FINDINGS)


def completed_runs(runs: DataFrame) -> DataFrame:
    """Last completed run per engine; a cancelled run completes nothing. ``runs``:
    engine, run, completed."""
    return runs.filter("completed").groupBy("engine").agg(F.max("run").alias("done_run"))


def with_live(findings: DataFrame, done: DataFrame) -> DataFrame:
    """Mark what the engine's last completed run still reports. Engines are a handful,
    and a row without a managed engine is always live."""
    return (
        findings.join(F.broadcast(done), "engine", "left")
        .withColumn("live", F.col("done_run").isNull() | (F.col("seen_run") >= F.col("done_run")))
        .drop("done_run")
    )


def folded_triage() -> Column:
    """Decision of an artifact from the counts of its rows: live rows decide; only when
    none is live do the retired ones."""
    live = F.col("findings")
    return (
        F.when(F.col("live_confirmed") > 0, "confirmed")
        .when((live > 0) & (F.col("live_dismissed") == live), "dismissed")
        .when(F.col("live_reviewed") > 0, "reviewed")
        .when(live > 0, "new")
        .when(F.col("any_confirmed") > 0, "confirmed")
        .when(F.col("any_dismissed") == F.col("rows"), "dismissed")
        .when(F.col("any_reviewed") > 0, "reviewed")
        .otherwise("new")
    )


def artifacts(findings: DataFrame, done: DataFrame, muted: list[str] | None = None) -> DataFrame:
    """One row per artifact. All counters are conditional sums, so a hot artifact is
    combined before the shuffle."""
    live = F.col("live")
    heard = live & ((F.col("rule_id") == "") | ~F.col("rule_id").isin(*muted)) if muted else live
    counts = {f"live_{s}": F.count_if(live & (F.col("triage") == s)) for s in fixed.TRIAGE_STATES[1:]}
    counts |= {f"any_{s}": F.count_if(F.col("triage") == s) for s in fixed.TRIAGE_STATES[1:]}
    folded = with_live(findings, done).groupBy("artifact").agg(
        F.min("artifact_kind").alias("artifact_kind"),
        F.coalesce(F.min(F.when(live, F.col("severity"))), F.min("severity")).alias("worst"),
        F.min("source").alias("source"),
        F.count_if(live).alias("findings"), F.count_if(~live).alias("retired"), F.count_if(heard).alias("active"),
        F.max("triaged_at").alias("triaged_at"), F.max("triage_note").alias("triage_note"),
        F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("rows"),
        *[c.alias(n) for n, c in counts.items()])
    return folded.withColumn("triage", folded_triage()).drop("rows", *counts)


def facet_counts(arts: DataFrame, findings: DataFrame) -> DataFrame:
    """Artifacts per severity, decision and source; an artifact counts for every source
    it carries."""
    by_source = findings.select("source", "artifact").distinct().groupBy(
        F.lit("source").alias("facet"), F.col("source").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    own = arts.select(F.explode(F.array(
        F.struct(F.lit("severity").alias("facet"), F.col("worst").cast("string").alias("value")),
        F.struct(F.lit("triage").alias("facet"), F.col("triage").alias("value")))).alias("x"))
    return own.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n")).unionByName(by_source)


def heard_or_decided(show_retired: bool = False) -> Column:
    """A muted artifact leaves the list only while nobody has decided about it."""
    clause = (F.col("active") > 0) | (F.col("triage") != "new")
    return (clause | ((F.col("findings") == 0) & (F.col("retired") > 0))) if show_retired else clause


def filtered(arts: DataFrame, findings: DataFrame, hide_severity=(), hide_triage=(), hide_source=(),
             sources=None, kind: str = "", search: str = "") -> DataFrame:
    """The work list's filters. Whoever is shown is shown whole: source and search look
    at any finding of the artifact."""
    out = arts
    if hide_severity:
        out = out.filter(~F.col("worst").isin(*hide_severity))
    if hide_triage:
        out = out.filter(~F.col("triage").isin(*hide_triage))
    if hide_source:
        out = out.filter(~F.col("source").isin(*hide_source))
    if sources is not None:
        out = out.join(findings.filter(F.col("source").isin(*sources)).select("artifact").distinct(),
                       "artifact", "left_semi")
    if kind:
        out = out.filter(F.col("artifact_kind") == kind)
    if search:
        hit = holds(F.col("rule"), search) | holds(F.col("artifact"), search) | holds(F.col("evidence"), search)
        out = out.join(findings.filter(hit).select("artifact").distinct(), "artifact", "left_semi")
    return out


def work_list(arts: DataFrame, findings: DataFrame, show_retired: bool = False, **filters) -> DataFrame:
    return filtered(arts, findings, **filters).filter(heard_or_decided(show_retired))


def hidden_counts(arts: DataFrame, findings: DataFrame, show_retired: bool = False, **filters) -> DataFrame:
    """Shown, hidden because muted, hidden because retired: one pass, three counters."""
    base = filtered(arts, findings, **filters)
    shown = heard_or_decided(show_retired)
    gone = ~heard_or_decided() & (F.col("findings") == 0) & (F.col("retired") > 0)
    row = base.agg(F.count_if(shown).alias("total"), F.count_if(~shown).alias("hidden"),
                   F.count_if(gone).alias("retired_hidden"))
    return row.select("total", "retired_hidden", (
        F.col("hidden") - (F.lit(0) if show_retired else F.col("retired_hidden"))).alias("muted_hidden"))


# --- decisions ----------------------------------------------------------------


def artifacts_of(findings: DataFrame, names: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The artifacts a decision touches; a fingerprint points at its artifact."""
    by_print = findings.join(fingerprints, "fingerprint", "left_semi").select("artifact")
    return names.select("artifact").unionAll(by_print).distinct()


def decide(findings: DataFrame, decisions: DataFrame, now: int) -> DataFrame:
    """Set the state on every finding of the decided artifacts. ``decisions``: artifact,
    state, note (NULL keeps the note that is there)."""
    d = decisions.select("artifact", F.col("state").alias("d_state"), F.col("note").alias("d_note"))
    hit = F.col("d_state").isNotNull()
    return findings.join(d, "artifact", "left").withColumns({
        "triage": F.coalesce("d_state", "triage"),
        "triage_note": F.coalesce("d_note", "triage_note"),
        "triaged_at": F.when(hit, F.lit(now)).otherwise(F.col("triaged_at")).cast("long"),
    }).drop("d_state", "d_note")


def decision_events(arts: DataFrame, decisions: DataFrame, now: int, propagated: bool = False) -> DataFrame:
    """One event per artifact whose state really changes."""
    return (
        arts.join(decisions, "artifact").filter(F.col("triage") != F.col("state"))
        .select("artifact", "artifact_kind", F.col("triage").alias("from_state"), F.col("state").alias("to_state"),
                F.coalesce("note", F.lit("")).alias("note"), F.lit(propagated).alias("propagated"),
                F.lit(now).cast("long").alias("at"))
    )


# --- dashboard ----------------------------------------------------------------


def dashboard(arts: DataFrame) -> DataFrame:
    """Counts by (measure, value): open severity, decisions, confirmed kind and severity."""
    def fact(when, measure, value):
        return F.when(when, F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value")))

    confirmed = F.col("triage") == "confirmed"
    facts = F.array_compact(F.array(
        fact(F.col("triage") != "dismissed", "severity", F.col("worst")),
        fact(F.lit(True), "triage", F.col("triage")),
        fact(confirmed, "confirmed_kind", F.col("artifact_kind")),
        fact(confirmed, "confirmed_severity", F.col("worst"))))
    return arts.select(F.inline(facts)).groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n"))


def balanced_preview(arts: DataFrame, limit: int = 6) -> DataFrame:
    """A few confirmed artifacts, taken in turn from every kind.

    No kind can contribute more than the limit, so each is cut before the sort."""
    rank = F.row_number().over(Window.partitionBy("artifact_kind").orderBy("worst", F.lower("artifact"), "artifact"))
    kind = F.when(F.col("artifact_kind") == "file", 0).when(F.col("artifact_kind") == "table", 1).when(
        F.col("artifact_kind") == "dump", 2).otherwise(3)
    return (
        arts.filter(F.col("triage") == "confirmed").withColumn("kind_rank", rank)
        .filter(F.col("kind_rank") <= limit)
        .orderBy("kind_rank", kind, "worst", F.lower("artifact"), "artifact").limit(limit)
        .select("artifact", "artifact_kind", "worst", "kind_rank")
    )


def case_summary(findings: DataFrame, iocs: DataFrame, evidence: DataFrame) -> DataFrame:
    """What a case found, in one row. Counts are in artifacts; retirement is ignored."""
    per_artifact = findings.groupBy("artifact").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("triage") != "dismissed", F.col("severity"))).alias("worst"),
        F.max((F.col("triage") == "confirmed").cast("int")).alias("confirmed"),
        F.max((F.col("triage") == "dismissed").cast("int")).alias("dismissed"))
    row = per_artifact.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.count(F.lit(1)).alias("artifacts"),
        F.coalesce(F.sum("confirmed"), F.lit(0)).alias("confirmed"),
        F.coalesce(F.sum("dismissed"), F.lit(0)).alias("dismissed"),
        *[F.count_if(F.col("worst") == s).alias(f"severity_{s}") for s in range(4)])
    return row.withColumns({
        "iocs": iocs.select(F.count(F.lit(1))).scalar(),
        "evidence": evidence.select(F.array_join(F.array_sort(F.collect_list(
            F.concat_ws(":", "kind", "path"))), ", ")).scalar()})

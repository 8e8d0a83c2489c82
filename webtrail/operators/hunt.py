"""URL pattern hunts: plain text with ``*`` wildcards, combined over clients.

A pattern library is rule data of a few hundred entries, so a request carries the
paths it matches as an array built from literal LIKE tests. Nothing is joined, a
request that matches nothing leaves before the first shuffle, and nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import predicates as is_, times
from webtrail.functions.text import fingerprint, like_text
from webtrail.operators.actors import dated

FINDING_ENGINE = ""  # a hunt is never retired by a later scan


def like_pattern(path: str) -> str:
    """Substring, ``*`` is a wildcard, everything else literal."""
    return "%" + like_text(path).replace("*", "%") + "%"


def matches(uri: Column, path: str) -> Column:
    return uri.ilike(like_pattern(path))


def check_paths(paths) -> list[str]:
    """The paths of one pattern: substantial, no duplicates; any number of them."""
    kept: dict[str, str] = {}
    for raw in [paths] if isinstance(paths, str) else (paths or []):
        path = str(raw or "").strip()
        if len(path.replace("*", "")) < fixed.MIN_PATTERN_LENGTH:
            raise ValueError(f"pattern {path!r} needs {fixed.MIN_PATTERN_LENGTH} characters besides wildcards")
        kept.setdefault(path.lower(), path)
    if not kept:
        raise ValueError("a pattern needs at least one path")
    return list(kept.values())


def usable_paths(library: DataFrame) -> DataFrame:
    """The same check over a library table: entries that fail it leave."""
    trimmed = F.filter(F.transform("patterns", lambda p: F.trim(p)), lambda p: p != "")
    first_spelling = F.filter(
        trimmed, lambda p, i: ~F.exists(F.slice(trimmed, F.lit(1), i), lambda q: F.lower(q) == F.lower(p)))
    return (
        library.withColumn("patterns", first_spelling)
        .filter(F.size("patterns") >= 1)
        .filter(F.forall("patterns", lambda p: F.length(F.replace(p, F.lit("*"), F.lit(""))) >= fixed.MIN_PATTERN_LENGTH))
    )


def skipped_entries(library: DataFrame) -> DataFrame:
    """The library entries that `usable_paths` leaves out, each with a reason."""
    trimmed = F.filter(F.transform("patterns", lambda p: F.trim(p)), lambda p: p != "")
    short = F.exists(trimmed, lambda p: F.length(F.replace(p, F.lit("*"), F.lit(""))) < fixed.MIN_PATTERN_LENGTH)
    reason = F.when(F.coalesce(F.size(trimmed), F.lit(0)) < 1, "no path").when(
        short, f"a path has fewer than {fixed.MIN_PATTERN_LENGTH} characters besides wildcards")
    return library.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def path_hits(requests: DataFrame, paths: list[str]) -> DataFrame:
    """One row per (request, matching path); a request may match several."""
    tests = F.array_compact(F.array(*[F.when(matches(F.col("uri"), p), F.lit(i)) for i, p in enumerate(paths)]))
    reached = requests.select("ip", "epoch", "tz", "uri", "status", tests.alias("paths"))
    return reached.filter(F.size("paths") > 0).withColumn("path_id", F.explode("paths")).drop("paths")


def _outcome() -> list[Column]:
    return [F.count(F.lit(1)).alias("hits"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok_hits"),
            F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"), F.max("tz").alias("tz")]


def hunt_clients(requests: DataFrame, paths: list[str], mode: str = "any") -> DataFrame:
    """Clients that hit any path, or every one of them. A request counts once per path
    it matches, so ``hits`` is the sum over the paths."""
    per_path = path_hits(requests, paths).groupBy("ip", "path_id").agg(*_outcome())
    merged = per_path.groupBy("ip").agg(
        F.sum("hits").alias("hits"), F.sum("ok_hits").alias("ok_hits"),
        F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"),
        F.max("tz").alias("tz"), F.count(F.lit(1)).alias("paths_hit"))
    needed = len(paths) if mode == "all" else 1
    return merged.filter(F.col("paths_hit") >= needed)


def hunt_requests(requests: DataFrame, paths: list[str], survivors: DataFrame | None = None) -> DataFrame:
    """The matching requests, each once, of the surviving clients."""
    hit = is_any(F.col("uri"), paths)
    out = requests.filter(hit)
    return out if survivors is None else out.join(survivors.select("ip"), "ip", "left_semi")


def is_any(uri: Column, paths: list[str]) -> Column:
    test = F.lit(False)
    for path in paths:
        test = test | matches(uri, path)
    return test


def hunt_uris(requests: DataFrame, paths: list[str], survivors: DataFrame | None = None) -> DataFrame:
    """Targets a hunt reached, each request counted once."""
    return (
        hunt_requests(requests, paths, survivors).groupBy("uri")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok_hits"))
    )


def hunt_totals(clients: DataFrame, uris: DataFrame) -> DataFrame:
    """Key figures of a hunt in one row."""
    return clients.agg(
        F.count(F.lit(1)).alias("clients"), F.count_if(F.col("ok_hits") > 0).alias("ok_clients"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("ok_hits"), F.lit(0)).alias("ok_hits"),
        F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"),
        F.coalesce(F.max("tz"), F.lit(0)).alias("tz"),
    ).withColumn("uris", uris.select(F.count(F.lit(1))).scalar())


def hunt_timeline(requests: DataFrame, paths: list[str], survivors: DataFrame | None = None) -> DataFrame:
    """Daily outcomes and distinct clients of a hunt. Distinct clients come from a
    second grouping, so a hot client is combined before the shuffle."""

    day = times.local_day(F.col("epoch"), F.col("tz")).alias("day")
    per_client = (
        dated(hunt_requests(requests, paths, survivors)).groupBy(day, "ip")
        .agg(F.count(F.lit(1)).alias("requests"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok"),
             F.count_if(F.col("status") >= 400).alias("errors"))
    )
    return per_client.groupBy("day").agg(
        F.sum("requests").alias("requests"), F.sum("ok").alias("ok"), F.sum("errors").alias("errors"),
        F.count(F.lit(1)).alias("clients"))


def library_hunt(requests: DataFrame, library: list[dict]) -> DataFrame:
    """Every pattern of a library over the logs in one pass: (pattern_id, client) rows.

    ``library`` entries have id, patterns and match."""
    ids = [(entry["id"], i, path) for entry in library for i, path in enumerate(entry["patterns"])]
    tests = F.array_compact(F.array(*[
        F.when(matches(F.col("uri"), path), F.struct(F.lit(pid).alias("pattern_id"), F.lit(i).alias("path_id")))
        for pid, i, path in ids]))
    needed = F.lit(1)
    for entry in library:
        if entry.get("match") == "all":
            needed = F.when(F.col("pattern_id") == entry["id"], len(entry["patterns"])).otherwise(needed)
    reached = requests.select("ip", "epoch", "tz", "uri", "status", tests.alias("m")).filter(F.size("m") > 0)
    per_path = (reached.select("ip", "epoch", "tz", "uri", "status", F.inline("m"))
                .groupBy("pattern_id", "ip", "path_id").agg(*_outcome(), F.min("uri").alias("example")))
    return (
        per_path.groupBy("pattern_id", "ip").agg(
            F.sum("hits").alias("hits"), F.sum("ok_hits").alias("ok_hits"),
            F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"),
            F.max("tz").alias("tz"), F.count(F.lit(1)).alias("paths_hit"), F.min("example").alias("example"))
        .filter(F.col("paths_hit") >= needed)
    )


def joined_pattern(entry: dict) -> str:
    return (" AND " if entry.get("match") == "all" else " OR ").join(entry["patterns"])


def hunt_findings(hits: DataFrame, library: list[dict]) -> DataFrame:
    """One finding per (pattern, client): HIGH if any request was answered 2xx."""
    name, pattern, origin = F.lit(""), F.lit(""), F.lit("")
    for entry in library:
        here = F.col("pattern_id") == entry["id"]
        name = F.when(here, entry.get("name") or joined_pattern(entry)).otherwise(name)
        pattern = F.when(here, joined_pattern(entry)).otherwise(pattern)
        own = entry.get("origin") != "bundled"
        origin = F.when(here, "analyst's own pattern" if own else "shipped with the library").otherwise(origin)
    ok = F.col("ok_hits") > 0
    rows = hits.select(
        F.lit("logs").alias("source"), F.when(ok, fixed.HIGH).otherwise(fixed.LOW).alias("severity"),
        F.concat(F.lit("Request matching a stored pattern ("), name, F.lit(") — "),
                 F.when(ok, "answered 2xx").otherwise("attempts only")).alias("rule"),
        F.lit("").alias("rule_id"), F.lit("client").alias("artifact_kind"), F.col("ip").alias("artifact"),
        F.lit(None).cast("long").alias("line"),
        F.substring(F.concat(
            F.col("hits").cast("string"), F.lit("× requested, of those "), F.col("ok_hits").cast("string"),
            F.lit("× 2xx · pattern: "), pattern, F.lit(" ("), origin, F.lit(") · e.g. "),
            F.col("example")), 1, 400).alias("evidence"),
        F.lit(FINDING_ENGINE).alias("engine"))
    return rows.withColumn("fingerprint", fingerprint(
        F.col("source"), F.col("rule"), F.col("artifact"), F.col("line")))


def hunt_runs(requests: DataFrame, library: DataFrame, entries: list[dict]) -> DataFrame:
    """The record of a run per pattern; a pattern without a hit keeps its row."""
    per_pattern = library_hunt(requests, entries).groupBy("pattern_id").agg(
        F.sum("hits").alias("hits"), F.sum("ok_hits").alias("ok_hits"), F.count(F.lit(1)).alias("clients"),
        F.count_if(F.col("ok_hits") > 0).alias("ok_clients"),
        F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("hits", "ok_hits", "clients", "ok_clients")}
    return (library.select(F.col("id").alias("pattern_id"), "name")
            .join(per_pattern, "pattern_id", "left").withColumns(counts))


def correlate(clients: DataFrame, decisions: DataFrame, iocs: DataFrame) -> DataFrame:
    """Hunt clients with what the case already knows: decision, findings, indicator."""
    state = decisions.filter(F.col("artifact_kind") == "client").select(
        F.col("artifact").alias("ip"), "triage", F.col("findings").alias("finding_count"))
    box = iocs.filter(F.col("type") == "ip").select(F.col("value").alias("ip")).distinct().withColumn("in_box", F.lit(True))
    return (
        clients.join(state, "ip", "left").join(box, "ip", "left")
        .withColumns({"triage": F.coalesce("triage", F.lit("")),
                      "finding_count": F.coalesce("finding_count", F.lit(0)),
                      "in_box": F.coalesce("in_box", F.lit(False))})
    )


def signature(library: DataFrame) -> DataFrame:
    """What makes two entries the same rule: the same paths, combined the same way."""
    return library.withColumn("signature", F.concat_ws(
        "\u001f", F.col("match"), F.array_join(F.array_sort(F.transform("patterns", lambda p: F.lower(p))), "\u001f")))


def library_union(bundled: DataFrame, own: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Enabled bundled patterns, then the analyst's own; one entry per signature, the
    bundled one winning."""
    kept = bundled.filter(~F.col("id").isin(*disabled)) if disabled else bundled
    both = kept.withColumn("rank", F.lit(0)).unionByName(own.withColumn("rank", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("signature").orderBy("rank", "id"))
    return signature(both).withColumn("n", first).filter("n = 1").drop("n", "rank", "signature")



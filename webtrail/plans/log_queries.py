"""Queries over the access log: parsing, clients, alerts, traces, hunts, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import indicators, loglines, predicates as is_, times, uris
from webtrail.functions.text import computed_once, spreadsheet_safe
from webtrail.operators import actors, alerts, coverage, hunt, sigma, trace
from webtrail.plans import bindings as b
from webtrail.plans.registry import query
from webtrail.session import shared_dir
from webtrail.sinks import index
from webtrail.sources import files, logs

# --- parsing ------------------------------------------------------------------

_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def log_lines(spark, sf):
    """The derived requests written out as text log lines, one of four shapes each:
    combined, with a vhost token and a trailer, common, and one nobody can parse."""
    r = computed_once(b.requests(spark, sf))
    tz = F.coalesce("tz", F.lit(0))
    local = F.col("epoch") + tz
    month = F.element_at(F.array(*[F.lit(m) for m in _MONTHS]),
                         F.month(F.timestamp_seconds(local)))
    at = F.date_format(F.timestamp_seconds(local), "dd/'MON'/yyyy:HH:mm:ss")
    zone = F.format_string("%s%02d%02d", F.when(tz < 0, "-").otherwise("+"),
                           F.floor(F.abs(tz) / 3600).cast("int"), F.floor(F.abs(tz) / 60 % 60).cast("int"))
    stamp = F.when(F.col("epoch").isNull(), "06/Xxx/2026:08:00:00 +0000").otherwise(
        F.concat_ws(" ", F.replace(at, F.lit("MON"), month), zone))
    request = F.when(F.col("method") == "-", F.lit('""')).otherwise(
        F.concat(F.lit('"'), "method", F.lit(" "), "uri", F.lit(' HTTP/1.1"')))
    size = F.coalesce(F.col("size").cast("string"), F.lit("-"))
    head = F.concat(F.col("ip"), F.lit(" - - ["), stamp, F.lit("] "), request, F.lit(" "),
                    F.col("status").cast("string"), F.lit(" "), size)
    tail = F.concat(F.lit(' "'), "referrer", F.lit('" "'), "agent", F.lit('"'))
    shape = F.col("pos") % 5
    cut = ((shape == 4) & (F.col("pos") % 3 == 0)) | (F.col("pos") == 2)
    line = (F.when(cut, F.concat(F.lit("cut "), F.substr(head, F.lit(30))))
            .when(shape == 1, F.concat(F.lit("www.example.test "), head, tail, F.lit(" 0.012 extra")))
            .when((shape == 2) & (F.col("method") != "-"), head)
            .when(shape == 3, F.concat(head, F.lit(" panel"), tail))
            .otherwise(F.concat(head, tail)))
    return computed_once(r.select("source", "pos", line.alias("value")))


_PARSED = b.sql("""SELECT source, pos, ip, epoch, tz, method, uri, status, size,
  CASE WHEN pos % 5 = 2 AND method <> '-' THEN '' ELSE referrer END AS referrer,
  CASE WHEN pos % 5 = 2 AND method <> '-' THEN '' ELSE agent END AS agent, leaf
 FROM req WHERE NOT ((pos % 5 = 4 AND pos % 3 = 0) OR pos = 2)""")


@query("parsed_log_lines", "S3 P1 P2 P3 P4 P5", _PARSED)
def parsed_log_lines(spark, sf):
    return logs.requests(logs.parsed(log_lines(spark, sf)))


# --- the index over files ----------------------------------------------------------

_LOGS = {"a": "/logs/a/access.log", "b": "/logs/b/access.log", "other": "/logs/b/other.log"}


def _log_folders(spark, sf):
    """The derived logs as text files, a folder for each source."""
    base = "/".join([shared_dir(spark), "webtrail", spark.sparkContext.applicationId, sf.strip("/").replace("/", "_").replace(":", "_")])
    names = {path: name for name, path in _LOGS.items()}
    folder = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("source")]
    # One pass over the lines writes all folders.
    log_lines(spark, sf).select("value", folder.alias("log")).write.mode("overwrite").partitionBy("log").text(f"{base}/text")
    return base, {name: f"{base}/text/log={name}" for name in _LOGS}


def _present(spark, folders):
    return files.listing(spark, folders).filter(F.col("path").rlike(r"/part-[^/]*$") & (F.col("length") > 0))


def _two_builds(spark, sf):
    """An index over two logs, then over the first and a third: what the second build found, and where
    its index lies."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BUILT:
        base, folder = _log_folders(spark, sf)
        place = f"{base}/file-index"
        index.update(spark, _present(spark, [folder["a"], folder["b"]]), place)
        now = _present(spark, [folder["a"], folder["other"]])
        met = [tuple(r) for r in index.changes(index.sources(spark, place), now).select(_folder_name("path"), "change").distinct().collect()]  # a row per folder
        index.update(spark, now, place)
        _BUILT[key] = (place, met)
    return _BUILT[key]


_BUILT: dict[tuple[str, str], tuple[str, list]] = {}


def _folder_name(column):
    return F.regexp_extract(column, "/text/log=([a-z]+)/", 1).alias("name")


@query("index_status", "K1 U4", b.sql("""SELECT DISTINCT 'other' AS name, 'added' AS change FROM req WHERE source = '/logs/b/other.log'
 UNION ALL SELECT DISTINCT 'b', 'gone' FROM req WHERE source = '/logs/b/access.log'"""))
def index_status(spark, sf):
    """What differs between an index and the files that there are now."""
    return spark.createDataFrame(_two_builds(spark, sf)[1], "name string, change string")


_CUT = "((pos % 5 = 4 AND pos % 3 = 0) OR pos = 2)"


@query("index_sources", "K1 U4 S3", b.sql(f"""SELECT CASE source WHEN '/logs/a/access.log' THEN 'a' ELSE 'other' END AS name, CASE source WHEN '/logs/a/access.log' THEN 1 ELSE 2 END AS build,
 count(*) FILTER (WHERE NOT {_CUT}) AS lines, count(*) FILTER (WHERE {_CUT}) AS unparsed, count(DISTINCT ip) FILTER (WHERE NOT {_CUT}) AS clients
 FROM req WHERE source <> '/logs/b/access.log' GROUP BY 1, 2"""))
def index_sources(spark, sf):
    """The sources after the second build: the log that did not change keeps its first build."""
    place, _ = _two_builds(spark, sf)
    rows = index.sources(spark, place).groupBy(_folder_name("path"), "build").agg(F.sum("lines").alias("lines"), F.sum("unparsed").alias("unparsed"))
    clients = index.requests(spark, place).groupBy(_folder_name("source")).agg(F.countDistinct("ip").alias("clients"))
    return rows.join(clients, "name")


@query("log_source_counts", "A11 S3", b.sql("""SELECT source, count(*) FILTER (WHERE NOT ((pos % 5 = 4 AND pos % 3 = 0) OR pos = 2)) AS lines,
 count(*) FILTER (WHERE (pos % 5 = 4 AND pos % 3 = 0) OR pos = 2) AS unparsed FROM req GROUP BY source"""))
def log_source_counts(spark, sf):
    return actors.source_counts(logs.parsed(log_lines(spark, sf)))


@query("uri_parts", "P5 P6 P7", b.sql("""SELECT DISTINCT uri, leaf,
 lower(trim(split_part(split_part(uri, '?', 1), '#', 1))) AS path, split_part(uri, '?', 1) AS stem,
 CASE WHEN contains(uri, '?') THEN substr(uri, instr(uri, '?') + 1) ELSE '' END AS query FROM req"""))
def uri_parts(spark, sf):
    u = F.col("uri")
    return b.requests(spark, sf).select(
        "uri", "leaf", uris.uri_path(u).alias("path"), uris.uri_stem(u).alias("stem"),
        uris.uri_query(u).alias("query")).distinct()


@query("local_times", "P11 P12 P13 P14", b.sql("""SELECT pos,
 CAST(DATE '1970-01-01' + CAST(dayno AS INT) AS VARCHAR) AS day, CAST(floor((epoch + tz) / 3600.0) AS BIGINT) AS hour,
 CASE coalesce(tz, 0) WHEN 0 THEN 'UTC' WHEN 7200 THEN 'UTC+02:00' WHEN -18000 THEN 'UTC-05:00' ELSE 'UTC+05:30' END AS zone,
 CASE WHEN epoch IS NULL THEN '—' ELSE strftime(make_timestamp((epoch + tz + 3600) * 1000000), '%Y-%m-%d %H:%M:%S') || ' ' ||
  CASE tz WHEN 0 THEN 'UTC' WHEN 7200 THEN 'UTC+02:00' WHEN -18000 THEN 'UTC-05:00' ELSE 'UTC+05:30' END END AS shown,
 CASE WHEN epoch IS NULL THEN '—' ELSE strftime(make_timestamp((epoch + 3600) * 1000000), '%Y-%m-%d %H:%M:%S') || ' UTC' END AS shown_utc
 FROM req"""))
def local_times(spark, sf):
    e, tz = F.col("epoch"), F.col("tz")
    return b.requests(spark, sf).select(
        "pos", times.local_day(e, tz).cast("string").alias("day"), times.local_hour(e, tz).alias("hour"),
        times.offset_label(tz).alias("zone"),
        times.render(times.log_reading(e, tz, "log", 3600), tz, "log").alias("shown"),
        times.render(times.log_reading(e, tz, "utc", 3600), tz, "utc").alias("shown_utc"))


@query("span_words", "P17", b.sql(f"""SELECT ip, requests, {b._words('(last_epoch - first_epoch)')} AS span,
 {b._words('((last_epoch - first_epoch) // 40)')} AS short_span FROM actors WHERE first_epoch IS NOT NULL""", "actors"))
def span_words(spark, sf):
    span = F.col("last_epoch") - F.col("first_epoch")
    return actors.actor_counts(b.requests(spark, sf)).filter("first_epoch is not null").select(
        "ip", "requests", times.span_words(span).alias("span"),
        times.span_words(F.floor(span / 40)).alias("short_span"))


@query("login_rates", "P19", b.sql(f"SELECT ip, login_posts, {b._LOGIN_RATE} AS rate FROM actors", "actors"))
def login_rates(spark, sf):
    return actors.actor_counts(b.requests(spark, sf)).select(
        "ip", "login_posts",
        times.login_rate(F.col("login_posts"), F.col("login_first"), F.col("login_last")).alias("rate"))


@query("answer_sizes", "A7 P20", b.sql(
    "SELECT ip, " + ", ".join(f"{b._span(k)} AS {k}" for k in b._KINDS) + " FROM actors", "actors"))
def answer_sizes(spark, sf):
    return actors.actor_counts(b.requests(spark, sf)).select(
        "ip", *[alerts.answer_span(k).alias(k) for k in actors.PROBES])


@query("spreadsheet_safe_cells", "P30", b.sql("""SELECT uri, count(*) AS n,
 CASE WHEN substr(uri, 1, 1) IN ('=', '+', '-', '@') THEN '''' || uri ELSE uri END AS cell,
 CASE WHEN substr(referrer, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || referrer ELSE referrer END AS other
 FROM req GROUP BY ALL"""))
def spreadsheet_safe_cells(spark, sf):
    return (b.requests(spark, sf)
            .groupBy("uri", spreadsheet_safe(F.col("uri")).alias("cell"),
                     spreadsheet_safe(F.col("referrer"), also_control=True).alias("other"))
            .agg(F.count(F.lit(1)).alias("n")))


# --- predicates ---------------------------------------------------------------

_FLAG_NAMES = ("f_login", "f_sqli", "f_traversal", "f_upload_php", "f_cms_dir_php", "f_scanner")


@query("request_flags", "F1 F2 F3 F4 F5 F6 F7 F8", b.sql(
    "SELECT pos, uri, agent, f_admin AS f_admin_area, " + ", ".join(_FLAG_NAMES) + " FROM flagged", "flagged"))
def request_flags(spark, sf):
    return actors.flagged(b.requests(spark, sf)).select("pos", "uri", "agent", "f_admin_area", *_FLAG_NAMES)


@query("status_classes", "F9", b.sql("""SELECT CAST(status // 100 AS VARCHAR) || 'xx' AS class, count(*) AS n FROM req
 GROUP BY 1 UNION ALL SELECT 'err', count(*) FROM req WHERE status BETWEEN 400 AND 599"""))
def status_classes(spark, sf):
    classes = F.array_compact(F.array(*[
        F.when(is_.status_class(F.col("status"), name), F.lit(name)) for name in is_.STATUS_CLASSES]))
    return (b.requests(spark, sf).select(F.explode(classes).alias("class"))
            .groupBy("class").agg(F.count(F.lit(1)).alias("n")))


@query("source_lookup", "J1", b.sql("""SELECT r.pos, r.ip, r.uri, r.agent, r.referrer, s.n AS source_lines
 FROM req r LEFT JOIN (SELECT source, count(*) AS n FROM req GROUP BY source) s ON s.source = r.source"""))
def source_lookup(spark, sf):
    r = b.requests(spark, sf)
    sources = r.groupBy("source").agg(F.count(F.lit(1)).alias("source_lines"))
    return r.join(sources, "source", "left").select("pos", "ip", "uri", "agent", "referrer", "source_lines")


# --- clients ------------------------------------------------------------------

_COUNTERS = ["ip", "requests", "first_epoch", "last_epoch", "tz", "err4", "err5", "bytes", "bytes_unknown",
             "posts", "login_posts", "login_redirects", "admin_ok", "login_first", "login_last", "login_burst",
             "agents"] + [f"{k}_{c}" for k in actors.PROBES for c in ("attempts", "ok")]


@query("actor_table", "A1 A2 A3 A4 A5 A8 W3", b.sql(
    f"SELECT {', '.join(_COUNTERS)}, coalesce(breakdown, '') AS login_statuses, scanner_uas FROM actors", "actors"))
def actor_table(spark, sf):
    return actors.actor_table(b.requests(spark, sf)).select(
        *_COUNTERS,
        F.coalesce(alerts.status_breakdown(F.col("login_statuses")), F.lit("")).alias("login_statuses"),
        F.array_join("scanner_uas", "|").alias("scanner_uas"))


@query("probe_examples", "A6", b.sql(
    "SELECT ip, " + ", ".join(f"nullif({k}_example, '') AS {k}_example" for k in b._KINDS)
    + " FROM actors WHERE sqli_attempts + traversal_attempts + upload_php_attempts + cms_dir_php_attempts > 0", "actors"))
def probe_examples(spark, sf):
    return actors.probe_examples(b.requests(spark, sf))


@query("login_bursts", "A8 W3", b.sql("SELECT * FROM bursts", "actors"))
def login_bursts(spark, sf):
    return actors.login_burst(b.requests(spark, sf))


@query("actor_hours", "A9", b.sql("""SELECT ip, CAST(floor((epoch + tz) / 3600.0) AS BIGINT) AS hour, count(*) AS n
 FROM req WHERE epoch IS NOT NULL GROUP BY 1, 2"""))
def actor_hours(spark, sf):
    return actors.actor_hours(b.requests(spark, sf))


_DAYS = """SELECT CAST(DATE '1970-01-01' + CAST(dayno AS INT) AS VARCHAR) AS day, count(*) AS requests,
 count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE status >= 400) AS errors FROM req
 WHERE epoch IS NOT NULL GROUP BY dayno"""


@query("day_series", "A10 A15 P11", b.sql(f"""SELECT d.*, coalesce(n.n, 0) AS new_clients FROM ({_DAYS}) d LEFT JOIN (
 SELECT CAST(DATE '1970-01-01' + CAST(floor((first_epoch + tz) / 86400.0) AS INT) AS VARCHAR) AS day, count(*) AS n
 FROM actors WHERE first_epoch IS NOT NULL GROUP BY 1) n ON n.day = d.day""", "actors"))
def day_series(spark, sf):
    r = b.requests(spark, sf)
    return actors.days(r, actors.actor_counts(r)).withColumn("day", F.col("day").cast("string"))


@query("timeline_of_scanners", "A15 J2", b.sql(
    _DAYS.replace("WHERE epoch", "WHERE ip IN (SELECT ip FROM scan_uas) AND epoch"), "actors"))
def timeline_of_scanners(spark, sf):
    r = b.requests(spark, sf)
    return actors.timeline_for(r, actors.scanner_agents(r)).withColumn("day", F.col("day").cast("string"))


@query("index_totals", "A11", b.sql("""SELECT count(*) AS lines, count(DISTINCT ip) AS clients,
 count(*) FILTER (WHERE epoch IS NULL) AS undated, min(epoch) AS first_epoch, max(epoch) AS last_epoch,
 (SELECT string_agg(CAST(tz AS VARCHAR), ',' ORDER BY tz) FROM (SELECT DISTINCT tz FROM req WHERE tz IS NOT NULL)) AS tz_offsets
 FROM req"""))
def index_totals(spark, sf):
    return actors.index_totals(b.requests(spark, sf)).withColumn(
        "tz_offsets", F.array_join(F.transform("tz_offsets", lambda x: x.cast("string")), ","))


@query("log_overview", "A12", b.sql("""SELECT (SELECT count(*) FROM req) AS lines, count(*) AS clients,
 min(first_epoch) AS first_epoch, max(last_epoch) AS last_epoch,
 (SELECT count(DISTINCT ip) FROM alerts WHERE kind <> 'scanner_ua') AS alerted_clients FROM actors""", "alerts"))
def log_overview(spark, sf):
    r = b.requests(spark, sf)
    return alerts.overview(r, alerts.alerts(r)).select(
        "lines", "clients", "first_epoch", "last_epoch", "alerted_clients")


@query("profile_top_uris", "A13", b.sql("""SELECT uri, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM req
 WHERE ip = '10.0.0.0' GROUP BY uri ORDER BY n DESC, uri LIMIT 12"""))
def profile_top_uris(spark, sf):
    return actors.top_uris(b.requests(spark, sf), "10.0.0.0")


@query("profile_top_agents", "A13", b.sql("""SELECT agent, count(*) AS n FROM req WHERE ip = '203.0.113.7'
 GROUP BY agent ORDER BY n DESC, agent LIMIT 5"""))
def profile_top_agents(spark, sf):
    return actors.top_agents(b.requests(spark, sf), "203.0.113.7")


@query("sparklines", "A14", b.sql("""SELECT ip, string_agg(CAST(n AS VARCHAR), ',' ORDER BY bucket) AS series FROM (
 SELECT i.ip, i.bucket, coalesce(sum(h.n), 0)::BIGINT AS n FROM (SELECT ip, unnest(range(48)) AS bucket FROM (SELECT DISTINCT ip FROM hrs)) i
 LEFT JOIN (SELECT ip, n, least(47, (hour - lo) * 48 // greatest(1, hi - lo + 1)) AS bucket FROM hrs,
   (SELECT min(hour) AS lo, max(hour) AS hi FROM hrs)) h ON h.ip = i.ip AND h.bucket = i.bucket GROUP BY 1, 2) GROUP BY ip""",
    "req", """hrs AS (SELECT ip, CAST(floor((epoch + tz) / 3600.0) AS BIGINT) AS hour, count(*) AS n FROM req
 WHERE epoch IS NOT NULL GROUP BY 1, 2)"""))
def sparklines(spark, sf):
    lines = actors.sparklines(actors.actor_hours(b.requests(spark, sf)))
    return lines.select("ip", F.array_join(F.transform("series", lambda x: x.cast("string")), ",").alias("series"))


_NAMES = ["/srv/copy/wp-content/uploads/2026/01/KB-Media.php", "Evil.php", "shell.php", "index.php?x=1"]
_LEAVES = "('kb-media.php', 'evil.php', 'shell.php', 'index.php')"


def _names(spark):
    return spark.createDataFrame([(n,) for n in _NAMES], "name string")


@query("who_requested", "A16", b.sql(f"""SELECT ip, leaf, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits FROM req
 WHERE leaf IN {_LEAVES} GROUP BY ip, leaf"""))
def who_requested(spark, sf):
    return actors.who_requested(b.requests(spark, sf), _names(spark))


@query("requests_for_names", "A17", b.sql(f"""SELECT ip, uri, leaf, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits FROM req
 WHERE leaf IN {_LEAVES} GROUP BY ip, uri, leaf"""))
def requests_for_names(spark, sf):
    return actors.requests_for_names(b.requests(spark, sf), _names(spark))


@query("actor_spans", "J18", b.sql("""SELECT ip,
 CAST(DATE '1970-01-01' + CAST(floor((first_epoch + tz) / 86400.0) AS INT) AS VARCHAR) AS first_seen,
 CAST(DATE '1970-01-01' + CAST(floor((last_epoch + tz) / 86400.0) AS INT) AS VARCHAR) AS last_seen
 FROM actors WHERE first_epoch IS NOT NULL""", "actors"))
def actor_spans(spark, sf):
    spans = actors.actor_spans(actors.actor_counts(b.requests(spark, sf)))
    return spans.select("ip", F.col("first_seen").cast("string").alias("first_seen"),
                        F.col("last_seen").cast("string").alias("last_seen"))


_CLASS_SQL = {
    "alerted": "ip IN (SELECT ip FROM alerts WHERE kind <> 'scanner_ua')",
    "scanner": "scanner_uas <> ''", "bruteforce": "login_posts >= 30",
    "probes": "(sqli_attempts > 0 OR traversal_attempts > 0 OR upload_php_attempts > 0)",
    "quiet": "NOT ((login_redirects > 0 AND login_posts >= 30) OR upload_php_ok > 0 OR login_posts >= 30"
             " OR scanner_uas <> '' OR sqli_ok > 0 OR sqli_attempts > 0 OR traversal_ok > 0)",
}


@query("actor_classes", "F14", b.sql(" UNION ALL ".join(
    f"SELECT '{n}' AS class, '{m}' AS mode, ip FROM actors WHERE {'NOT ' if m == 'hide' else ''}({c})"
    for n, c in _CLASS_SQL.items() for m in ("keep", "hide")), "alerts"))
def actor_classes(spark, sf):
    r = actors.flagged(b.requests(spark, sf))
    table = actors.actor_table(r)
    found = alerts.counter_alerts(table)
    parts = []
    for name in _CLASS_SQL:
        for mode in ("keep", "hide"):
            chosen = actors.actors_of_class(table, found, name if mode == "keep" else "",
                                            (name,) if mode == "hide" else ())
            parts.append(chosen.select(F.lit(name).alias("class"), F.lit(mode).alias("mode"), "ip"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


@query("actor_list_page", "T2 T3 F13 F14", b.sql("""SELECT ip, requests, err4 + err5 AS errors FROM actors
 WHERE contains(lower(ip), '.0.') AND NOT (login_posts >= 30) ORDER BY err4 + err5 DESC, ip LIMIT 20 OFFSET 5""", "actors"))
def actor_list_page(spark, sf):
    table = actors.actor_table(b.requests(spark, sf))
    chosen = actors.actors_of_class(table, alerts.counter_alerts(table), hide=("bruteforce",), search=".0.")
    return actors.page(chosen, actors.actor_order("errors"), 20, 5).select(
        "ip", "requests", (F.col("err4") + F.col("err5")).alias("errors"))


@query("actors_by_address", "J7 J2", b.sql("""SELECT ip, requests, login_posts FROM actors
 WHERE ip IN (SELECT DISTINCT ip FROM req WHERE status >= 500)""", "actors"))
def actors_by_address(spark, sf):
    r = b.requests(spark, sf)
    wanted = r.filter("status >= 500").select("ip").distinct()
    return actors.actor_counts(r).join(wanted, "ip", "left_semi").select("ip", "requests", "login_posts")


# --- alerts -------------------------------------------------------------------


@query("alerts", "D1 D2 D3 D4 D5 D6 D7", b.sql("SELECT * FROM alerts", "alerts"))
def all_alerts(spark, sf):
    return alerts.alerts(b.requests(spark, sf))


@query("alerts_normalised", "D8", b.sql("""SELECT ip, kind, CASE WHEN kind = 'scanner_ua' THEN 3 ELSE severity END AS severity
 FROM alerts""", "alerts"))
def alerts_normalised(spark, sf):
    stored = alerts.alerts(b.requests(spark, sf)).withColumn(
        "severity", F.when(F.col("kind") == "scanner_ua", 1).otherwise(F.col("severity")))
    return alerts.severity_by_kind(stored).select("ip", "kind", "severity")


ALERT_FINDINGS_SQL = """finds AS (SELECT *, substr(sha1('logs' || chr(31) || rule || chr(31) || artifact || chr(31)), 1, 16) AS fingerprint
 FROM (SELECT 'logs' AS source, severity, CASE kind
  WHEN 'login_success' THEN 'Possible successful brute-force (redirect after login flood)'
  WHEN 'upload_php' THEN 'Requested PHP in upload/cache directory answered 2xx'
  WHEN 'cms_dir_php' THEN 'Requested PHP directly in a CMS extension directory answered 2xx'
  WHEN 'login_flood' THEN 'CMS login POST flood' WHEN 'sqli' THEN 'SQL injection patterns in URIs answered 2xx'
  WHEN 'traversal' THEN 'Path traversal patterns answered 2xx' ELSE 'Scanner tool User-Agent' END AS rule,
  'logs.' || kind AS rule_id, 'client' AS artifact_kind, ip AS artifact, CAST(NULL AS BIGINT) AS line, detail AS evidence,
  'logindex' AS engine FROM alerts))"""


@query("alert_findings", "D9 F27 P32", b.sql("SELECT * FROM finds WHERE rule_id <> 'logs.traversal'", "alerts", ALERT_FINDINGS_SQL))
def alert_findings(spark, sf):
    return alerts.findings_from_alerts(alerts.alerts(b.requests(spark, sf)), ["logs.traversal", "logs.unknown"])


@query("alerts_of_actors", "J6", b.sql("""SELECT a.ip, a.requests, coalesce(n.kinds, '') AS kinds, coalesce(i.n, 0) AS info_alerts
 FROM actors a LEFT JOIN (SELECT ip, string_agg(CAST(severity AS VARCHAR) || kind, ',' ORDER BY severity, kind) AS kinds FROM alerts
 WHERE kind <> 'scanner_ua' GROUP BY ip) n ON n.ip = a.ip
 LEFT JOIN (SELECT ip, count(*) AS n FROM alerts WHERE kind = 'scanner_ua' GROUP BY ip) i ON i.ip = a.ip""", "alerts"))
def alerts_of_actors(spark, sf):
    r = actors.flagged(b.requests(spark, sf))
    table = actors.actor_table(r)
    listed = alerts.alerts_of_actors(table, alerts.alerts(r, table))
    kinds = F.array_join(F.transform("alerts", lambda a: F.concat(a["severity"].cast("string"), a["kind"])), ",")
    return listed.select("ip", "requests", kinds.alias("kinds"), "info_alerts")


@query("actor_badges", "D12", b.sql(f"""SELECT ip, array_to_string(list_filter([
 CASE WHEN {b._SUCCESS} THEN 'loginSuccess' END, CASE WHEN cms_dir_php_ok > 0 THEN 'cmsDirPhp' END,
 CASE WHEN upload_php_ok > 0 THEN 'shellAccess' END, CASE WHEN login_posts >= 30 THEN 'bruteForce' END,
 CASE WHEN scanner_uas <> '' THEN 'scanner' END,
 CASE WHEN sqli_ok > 0 THEN 'sqliOk' WHEN sqli_attempts > 0 THEN 'sqliAttempts' END,
 CASE WHEN traversal_ok > 0 THEN 'traversal' END], lambda x: x IS NOT NULL), ',') AS badges,
 array_to_string(list_filter(['actor', CASE WHEN scanner_uas <> '' THEN 'scanner' END,
 CASE WHEN login_posts >= 30 THEN 'brute-force' END, CASE WHEN {b._SUCCESS} THEN 'successful' END],
 lambda x: x IS NOT NULL), ',') AS tags FROM actors""", "actors"))
def actor_badges(spark, sf):
    table = actors.actor_table(b.requests(spark, sf))
    return table.select("ip", F.array_join(alerts.badges(), ",").alias("badges"),
                        F.array_join(alerts.actor_tags(), ",").alias("tags"))


# --- traces -------------------------------------------------------------------

_TRACED = ["203.0.113.7", "10.0.0.0", "172.16.0.46", "192.168.0.8"]
_TRACED_SQL = "ip IN ('203.0.113.7', '10.0.0.0', '172.16.0.46', '192.168.0.8')"
_TRACE_COLUMNS = ("ip AS client, epoch, tz, method, uri, status, size, referrer, agent,"
                  " split_part(source, '/', -1) AS source, pos")


@query("trace_all", "T1 J2", b.sql(f"SELECT {_TRACE_COLUMNS} FROM req WHERE {_TRACED_SQL}"))
def trace_all(spark, sf):
    return trace.trace_columns(trace.trace(b.requests(spark, sf), _TRACED))


@query("trace_filtered", "F9 F10 F11 F12", b.sql(f"""SELECT {_TRACE_COLUMNS} FROM req WHERE epoch BETWEEN {b.T0} AND {b.T0 + 2000000}
 AND status BETWEEN 200 AND 299 AND method = 'POST' AND (contains(lower(uri), 'php') OR contains(lower(agent), 'php'))"""))
def trace_filtered(spark, sf):
    r = b.requests(spark, sf)
    rows = trace.trace(r, r.select("ip"), b.T0, b.T0 + 2000000, search="PHP", status="2xx", method="post")
    return trace.trace_columns(rows)


@query("trace_page_by_size", "T1 T3", b.sql(f"""SELECT {_TRACE_COLUMNS} FROM (SELECT * FROM req WHERE {_TRACED_SQL}
 ORDER BY size DESC NULLS LAST, epoch NULLS FIRST, source, pos LIMIT 25 OFFSET 10)"""))
def trace_page_by_size(spark, sf):
    rows = trace.trace(b.requests(spark, sf), _TRACED)
    return trace.trace_columns(actors.page(rows, trace.trace_order("size"), 25, 10))


@query("trace_methods", "T4", b.sql(f"SELECT DISTINCT method FROM req WHERE {_TRACED_SQL}"))
def trace_methods(spark, sf):
    return trace.methods(b.requests(spark, sf), _TRACED)


# --- hunts --------------------------------------------------------------------

_PATHS = ["*option=com_jce*", "*task=profiles.import*"]
_HIT = ["uri ILIKE '%option=com\\_jce%' ESCAPE '\\'", "uri ILIKE '%task=profiles.import%'"]
_HUNT = ("hits AS (SELECT 0 AS path_id, * FROM req WHERE " + _HIT[0] + " UNION ALL SELECT 1, * FROM req WHERE " + _HIT[1] + "),\n"
         "clients AS (SELECT ip, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits, min(epoch) AS first_epoch,"
         " max(epoch) AS last_epoch, max(tz) AS tz, count(DISTINCT path_id) AS paths_hit FROM hits GROUP BY ip)")


@query("hunt_any_clients", "A18 U1 P21 P22", b.sql("SELECT * FROM clients", "req", _HUNT))
def hunt_any_clients(spark, sf):
    return hunt.hunt_clients(b.requests(spark, sf), _PATHS, "any")


@query("hunt_all_clients", "U1", b.sql("SELECT * FROM clients WHERE paths_hit = 2", "req", _HUNT))
def hunt_all_clients(spark, sf):
    return hunt.hunt_clients(b.requests(spark, sf), _PATHS, "all")


_SURVIVING = f"FROM req WHERE ({_HIT[0]} OR {_HIT[1]}) AND ip IN (SELECT ip FROM clients WHERE paths_hit = 2)"


@query("hunt_uris", "A19 U2", b.sql(
    f"SELECT uri, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits {_SURVIVING} GROUP BY uri", "req", _HUNT))
def hunt_uris(spark, sf):
    r = b.requests(spark, sf)
    return hunt.hunt_uris(r, _PATHS, hunt.hunt_clients(r, _PATHS, "all"))


@query("hunt_totals", "A20 A19 T5", b.sql(f"""SELECT count(*) AS clients, count(*) FILTER (WHERE ok_hits > 0) AS ok_clients,
 sum(hits)::BIGINT AS hits, sum(ok_hits)::BIGINT AS ok_hits, min(first_epoch) AS first_epoch, max(last_epoch) AS last_epoch,
 coalesce(max(tz), 0) AS tz, (SELECT count(DISTINCT uri) {_SURVIVING}) AS uris,
 count(*) > 40 AS clients_truncated FROM clients WHERE paths_hit = 2""", "req", _HUNT))
def hunt_totals(spark, sf):
    r = b.requests(spark, sf)
    clients = hunt.hunt_clients(r, _PATHS, "all")
    totals = hunt.hunt_totals(clients, hunt.hunt_uris(r, _PATHS, clients))
    return totals.withColumn("clients_truncated", F.col("clients") > 40)


@query("hunt_timeline", "A21 U2", b.sql(f"""SELECT CAST(DATE '1970-01-01' + CAST(dayno AS INT) AS VARCHAR) AS day, count(*) AS requests,
 count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE status >= 400) AS errors, count(DISTINCT ip) AS clients
 {_SURVIVING} AND epoch IS NOT NULL GROUP BY dayno""", "req", _HUNT))
def hunt_timeline(spark, sf):
    r = b.requests(spark, sf)
    days = hunt.hunt_timeline(r, _PATHS, hunt.hunt_clients(r, _PATHS, "all"))
    return days.withColumn("day", F.col("day").cast("string"))


ENTRIES = [{"id": i, "patterns": list(p), "match": m, "name": n, "cve": c, "origin": "bundled"}
           for i, p, m, n, c in fixed.BUNDLED_PATTERNS]
ENTRIES += [{"id": "own-1", "patterns": ["kb-media*.php"], "match": "any", "name": "", "cve": "", "origin": "own"},
            {"id": "own-2", "patterns": ["/no/such/path"], "match": "any", "name": "nothing", "cve": "", "origin": "own"}]
_LIBRARY = ("marks AS (SELECT 'joomla-jce-rce' AS pattern_id, 0 AS path_id, * FROM req WHERE " + _HIT[0]
            + " UNION ALL SELECT 'joomla-jce-rce', 1, * FROM req WHERE " + _HIT[1]
            + " UNION ALL SELECT 'joomla-helix3-comajax', 0, * FROM req WHERE uri ILIKE '%plugin=helix3%'"
            " UNION ALL SELECT 'own-1', 0, * FROM req WHERE uri ILIKE '%kb-media%.php%'),\n"
            "lib AS (SELECT pattern_id, ip, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits, min(epoch) AS first_epoch,"
            " max(epoch) AS last_epoch, max(tz) AS tz, count(DISTINCT path_id) AS paths_hit, min(uri) AS example FROM marks"
            " GROUP BY pattern_id, ip HAVING count(DISTINCT path_id) >= CASE pattern_id WHEN 'joomla-jce-rce' THEN 2 ELSE 1 END)")


@query("library_hunt", "A18 U1 S13", b.sql("SELECT * FROM lib", "req", _LIBRARY))
def library_hunt(spark, sf):
    return hunt.library_hunt(b.requests(spark, sf), ENTRIES)


HUNT_FINDINGS_SQL = _LIBRARY + """,
hfinds AS (SELECT *, substr(sha1('logs' || chr(31) || rule || chr(31) || artifact || chr(31)), 1, 16) AS fingerprint FROM (
 SELECT 'logs' AS source, CASE WHEN ok_hits > 0 THEN 0 ELSE 2 END AS severity, 'Request matching a stored pattern (' ||
 CASE pattern_id WHEN 'joomla-jce-rce' THEN 'Joomla JCE editor RCE' WHEN 'own-1' THEN 'kb-media*.php'
  ELSE 'Joomla Helix3 unauthenticated ajax handler' END || ') — ' ||
 CASE WHEN ok_hits > 0 THEN 'answered 2xx' ELSE 'attempts only' END AS rule, '' AS rule_id, 'client' AS artifact_kind, ip AS artifact,
 CAST(NULL AS BIGINT) AS line, substr(CAST(hits AS VARCHAR) || '× requested, of those ' || CAST(ok_hits AS VARCHAR) || '× 2xx · pattern: ' ||
 CASE pattern_id WHEN 'joomla-jce-rce' THEN '*option=com_jce* AND *task=profiles.import* (shipped with the library)'
  WHEN 'own-1' THEN 'kb-media*.php (analyst''s own pattern)' ELSE '*plugin=helix3* (shipped with the library)' END
 || ' · e.g. ' || example, 1, 400) AS evidence, '' AS engine FROM lib))"""


@query("hunt_findings", "D10", b.sql("SELECT * FROM hfinds", "req", HUNT_FINDINGS_SQL))
def hunt_findings(spark, sf):
    return hunt.hunt_findings(hunt.library_hunt(b.requests(spark, sf), ENTRIES), ENTRIES)


@query("hunt_runs", "A31", b.sql("""SELECT l.pattern_id, l.name, coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(sum(ok_hits), 0)::BIGINT AS ok_hits,
 count(ip) AS clients, count(*) FILTER (WHERE ok_hits > 0) AS ok_clients, min(first_epoch) AS first_epoch, max(last_epoch) AS last_epoch
 FROM (VALUES ('joomla-jce-rce', 'Joomla JCE editor RCE'), ('joomla-helix3-comajax', 'Joomla Helix3 unauthenticated ajax handler'),
 ('own-1', ''), ('own-2', 'nothing')) l(pattern_id, name) LEFT JOIN lib ON lib.pattern_id = l.pattern_id GROUP BY 1, 2""", "req", _LIBRARY))
def hunt_runs(spark, sf):
    library = spark.createDataFrame([(e["id"], e["name"]) for e in ENTRIES], "id string, name string")
    return hunt.hunt_runs(b.requests(spark, sf), library, ENTRIES)


# --- declarative rules --------------------------------------------------------

SIGMA_RULES = [
    {"id": "r.scanner", "title": "Scanner and 2xx", "level": "high", "detection": {
        "Sel": {"c-useragent|contains": ["sqlmap", "NIKTO"]}, "ok": {"sc-status": 200}, "condition": "Sel and ok"}},
    {"id": "r.query", "title": "Query words", "level": "low", "detection": {
        "sel_a": {"c-uri-query|contains|all": ["option=", "task"]}, "sel_b": {"cs-uri-stem|endswith": ".php5"},
        "sel_c": {"cs-uri-stem": "/IMAGES/*.php?"}, "condition": "1 of sel_*"}},
    {"id": "r.size", "title": "Large or unknown", "level": "", "detection": {
        "none": {"sc-bytes": None}, "post": {"cs-method": ["POST", "HEAD"]}, "big": {"c-ip|startswith": "10."},
        "condition": "(none or big) and not post"}},
    {"id": "r.all", "title": "All of them", "level": "critical", "detection": {
        "one": {"c-uri|contains": "admin"}, "two": {"c-uri|contains": "%"}, "three": {"src_ip": "203.0.113.7"},
        "condition": "all of them or three"}},
]
_SIGMA = """smarks AS (
 SELECT 'r.scanner' AS rule_id, * FROM req WHERE (agent ILIKE '%sqlmap%' OR agent ILIKE '%nikto%') AND status = 200
 UNION ALL SELECT 'r.query', * FROM req WHERE (contains(uri, '?') AND substr(uri, instr(uri, '?') + 1) ILIKE '%option=%'
   AND substr(uri, instr(uri, '?') + 1) ILIKE '%task%') OR split_part(uri, '?', 1) ILIKE '%.php5' OR split_part(uri, '?', 1) ILIKE '/images/%.php_'
 UNION ALL SELECT 'r.size', * FROM req WHERE (size IS NULL OR ip LIKE '10.%') AND NOT method IN ('POST', 'HEAD')
 UNION ALL SELECT 'r.all', * FROM req WHERE (uri ILIKE '%admin%' AND contains(uri, '%') AND ip = '203.0.113.7') OR ip = '203.0.113.7'),
sclients AS (SELECT rule_id, ip, count(*) AS hits, count(*) FILTER (WHERE ok) AS ok_hits, min(epoch) AS first_epoch, max(epoch) AS last_epoch,
 first(uri ORDER BY coalesce(epoch, 9000000000000), uri) AS example FROM smarks GROUP BY rule_id, ip)"""


@query("sigma_clients", "A22 G1 G2 G3 G4 G5 P23", b.sql("SELECT * FROM sclients", "req", _SIGMA))
def sigma_clients(spark, sf):
    return sigma.matching_clients(b.requests(spark, sf), [sigma.compile_rule(r) for r in SIGMA_RULES])


@query("sigma_findings", "D11 G7", b.sql("""SELECT 'logs' AS source, CASE WHEN ok_hits > 0 THEN sev ELSE greatest(sev, 2) END AS severity, title AS rule,
 c.rule_id, 'client' AS artifact_kind, ip AS artifact, CAST(NULL AS BIGINT) AS line,
 substr(CAST(hits AS VARCHAR) || 'x matched, of those ' || CAST(ok_hits AS VARCHAR) || 'x 2xx - SIGMA rule ' || c.rule_id || ' - e.g. ' || example, 1, 400) AS evidence,
 'sigmascan' AS engine, substr(sha1('logs' || chr(31) || title || chr(31) || ip || chr(31)), 1, 16) AS fingerprint
 FROM sclients c JOIN (VALUES ('r.scanner', 'Scanner and 2xx', 0), ('r.query', 'Query words', 2), ('r.size', 'Large or unknown', 1),
 ('r.all', 'All of them', 0)) r(rule_id, title, sev) ON r.rule_id = c.rule_id""", "req", _SIGMA))
def sigma_findings(spark, sf):
    rules = [sigma.compile_rule(r) for r in SIGMA_RULES]
    return sigma.findings(sigma.matching_clients(b.requests(spark, sf), rules), rules)


# --- gaps ---------------------------------------------------------------------

_GAPS = """st AS (SELECT DISTINCT epoch FROM req WHERE epoch > 0),
gp AS (SELECT lag(epoch) OVER (ORDER BY epoch) AS "from", epoch AS "to", epoch - lag(epoch) OVER (ORDER BY epoch) AS seconds FROM st),
rh AS (SELECT count(*) AS stamps, median(seconds) AS median, greatest(1800, 60 * median(seconds)) AS threshold FROM gp)"""


@query("timeline_gaps", "W2", b.sql("SELECT * FROM gp WHERE seconds IS NOT NULL", "req", _GAPS))
def timeline_gaps(spark, sf):
    return coverage.gaps(b.requests(spark, sf))


@query("log_rhythm", "V1", b.sql("""SELECT stamps, CAST(floor(median * 2) AS BIGINT) AS median2, stamps >= 50 AS checked,
 CAST(floor(threshold) AS BIGINT) AS threshold FROM rh""", "req", _GAPS))
def log_rhythm(spark, sf):
    return coverage.rhythm(b.requests(spark, sf)).select(
        "stamps", F.floor(F.col("median") * 2).alias("median2"), "checked", F.floor("threshold").alias("threshold"))


@query("quiet_windows", "V1 W2 T9", b.sql("""SELECT "from", "to", seconds FROM gp, rh WHERE seconds >= threshold AND stamps >= 50
 ORDER BY seconds DESC, "from" LIMIT 6""", "req", _GAPS))
def quiet_windows(spark, sf):
    return coverage.shown_windows(coverage.quiet_windows(b.requests(spark, sf))).select("from", "to", "seconds")


_LISTING = "listing AS (SELECT source AS path, max(epoch) FILTER (WHERE source NOT LIKE '%other%') AS m1, min(epoch) AS m2 FROM req GROUP BY source)"


def _listing(r):
    newest = F.max(F.when(~F.col("source").contains("other"), F.col("epoch")))
    return r.groupBy(F.col("source").alias("path")).agg(F.coalesce(newest, F.min("epoch")).alias("mtime"))


@query("stale_files", "V3", b.sql("""SELECT l.path, coalesce(m1, m2) AS mtime, max(epoch) AS last_epoch FROM listing l JOIN req ON req.source = l.path
 WHERE epoch > 0 GROUP BY ALL HAVING coalesce(m1, m2) + 60 < max(epoch)""", "req", _LISTING))
def stale_files(spark, sf):
    r = b.requests(spark, sf)
    return coverage.stale_files(r, _listing(r))


def _first_lines(spark, sf):
    lines = log_lines(spark, sf).filter(F.trim("value") != "")
    first = lines.groupBy(F.col("source").alias("path")).agg(F.min_by("value", "pos").alias("first_line"))
    return loglines.with_record(first, "first_line")


@query("truncated_heads", "V2 S5", b.sql("""SELECT source AS path FROM req GROUP BY source
 HAVING arg_min(((pos % 5 = 4 AND pos % 3 = 0) OR pos = 2), pos)"""))
def truncated_heads(spark, sf):
    return coverage.truncated_heads(_first_lines(spark, sf))


@query("coverage_notes", "V4", b.sql("""SELECT q + t + s AS notes, q AS quiet, t AS truncated, s AS stale FROM (SELECT
 (SELECT count(*) FROM gp, rh WHERE seconds >= threshold AND stamps >= 50) AS q,
 (SELECT count(*) FROM (SELECT source FROM req GROUP BY source HAVING arg_min(((pos % 5 = 4 AND pos % 3 = 0) OR pos = 2), pos))) AS t,
 (SELECT count(*) FROM (SELECT l.path FROM listing l JOIN req ON req.source = l.path GROUP BY l.path, m1, m2
   HAVING coalesce(m1, m2) + 60 < max(epoch))) AS s)""", "req", _GAPS + ",\n" + _LISTING))
def coverage_notes(spark, sf):
    r = b.requests(spark, sf)
    return coverage.note_count(coverage.quiet_windows(r), coverage.truncated_heads(_first_lines(spark, sf)),
                               coverage.stale_files(r, _listing(r)))


# --- address ranges -----------------------------------------------------------


@query("address_ranges", "P44", b.sql("""SELECT DISTINCT ip, CASE WHEN ip LIKE '203.0.113.%' THEN 'documentation' WHEN ip LIKE '10.%'
 OR ip LIKE '192.168.%' OR ip LIKE '172.16.%' THEN 'private' ELSE '' END AS range FROM req"""))
def address_ranges(spark, sf):
    clients = b.requests(spark, sf).select("ip").distinct()
    return clients.select("ip", F.coalesce(indicators.ipv4_range(F.col("ip")), F.lit("")).alias("range"))

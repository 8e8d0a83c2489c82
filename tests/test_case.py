"""Findings, decisions, indicators, chronology and exports, and the registered queries."""

import itertools
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from webtrail import schemas
from webtrail.operators import actors, alerts, chronology, findings as ops, iocs, report, touches
from webtrail.plans import catalogue
from webtrail.sinks import exports


def finding(i, artifact="a", triage="new", severity=1, engine="logindex", run=1, rule="R", rule_id="logs.x", source="logs", kind="client",
            evidence="e", note=""):
    return (f"fp{i}", source, severity, rule, rule_id, kind, artifact, None, evidence, 1, 1, triage, note, None, engine, run)


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.FINDINGS)


def runs(spark, rows):
    return ops.completed_runs(spark.createDataFrame(rows, "engine string, run long, completed boolean"))


def expected_state(rows):
    """The stated precedence, over live rows first and over retired rows without any."""
    live = [t for t, alive in rows if alive]
    group = live or [t for t, _ in rows]
    if "confirmed" in group:
        return "confirmed"
    if all(t == "dismissed" for t in group):
        return "dismissed"
    return "reviewed" if "reviewed" in group else "new"


def test_fold_truth_table(spark):
    states = ["new", "reviewed", "confirmed", "dismissed"]
    cells = list(itertools.product(states, [True, False]))
    combos = list(itertools.combinations_with_replacement(cells, 1)) + list(itertools.combinations_with_replacement(cells, 2)) + list(
        itertools.combinations_with_replacement(cells, 3))
    rows, want = [], {}
    for n, combo in enumerate(combos):
        want[f"a{n}"] = expected_state(combo)
        rows += [finding(f"{n}_{k}", f"a{n}", t, run=2 if alive else 1) for k, (t, alive) in enumerate(combo)]
    arts = ops.artifacts(frame(spark, rows), runs(spark, [("logindex", 2, True)]))
    assert {r.artifact: r.triage for r in arts.collect()} == want


def test_upsert_keeps_the_decision_and_retires_by_completed_runs(spark):
    old = frame(spark, [finding(1, "a", "confirmed", note="mine"), finding(2, "b")])
    new = frame(spark, [finding(1, "a", severity=0, evidence="fresh"), finding(3, "c")]).select(
        "fingerprint", "source", "severity", "rule", "rule_id", "artifact_kind", "artifact", "line", "evidence", "engine")
    merged = ops.upsert(old, new, 2, 99)
    got = {r.fingerprint: (r.severity, r.evidence, r.triage, r.triage_note, r.created, r.last_seen, r.seen_run) for r in merged.collect()}
    assert got == {"fp1": (0, "fresh", "confirmed", "mine", 1, 99, 2), "fp2": (1, "e", "new", "", 1, 1, 1), "fp3": (1, "e", "new", "", 99, 99, 2)}
    again = ops.upsert(merged, new, 2, 99)
    assert sorted(map(tuple, again.select(*merged.columns).collect()), key=str) == sorted(map(tuple, merged.collect()), key=str)
    for done, live in (([("logindex", 2, True)], {"a", "c"}), ([("logindex", 2, False), ("logindex", 1, True)], {"a", "b", "c"}), ([], {"a", "b", "c"})):
        arts = ops.artifacts(merged, runs(spark, done))
        assert {r.artifact for r in arts.filter("findings > 0").collect()} == live
    hunts = frame(spark, [finding(9, "h", engine="")])
    assert ops.artifacts(hunts, runs(spark, [("logindex", 7, True)])).first().findings == 1


def test_muted_artifacts_leave_only_undecided(spark):
    rows = frame(spark, [finding(1, "a"), finding(2, "b", "confirmed"), finding(3, "c"), finding(4, "c", rule_id="logs.y"), finding(5, "d", run=0)])
    arts = ops.artifacts(rows, runs(spark, [("logindex", 1, True)]), ["logs.x"])
    assert {r.artifact for r in ops.work_list(arts, rows).collect()} == {"b", "c"}
    assert {r.artifact for r in ops.work_list(arts, rows, show_retired=True).collect()} == {"b", "c", "d"}
    assert tuple(ops.hidden_counts(arts, rows).first()) == (2, 1, 1)
    assert {r.artifact for r in ops.work_list(arts, rows, search="LOGS").collect()} == set()


def test_work_list_filters_keep_the_artifact_whole(spark):
    rows = frame(spark, [finding(1, "a", source="logs"), finding(2, "a", source="webshell", kind="client"), finding(3, "b", source="logs")])
    arts = ops.artifacts(rows, runs(spark, []))
    (row,) = ops.work_list(arts, rows, sources=["webshell"]).collect()
    assert (row.artifact, row.findings) == ("a", 2)
    facets = {(r.facet, r.value): r.n for r in ops.facet_counts(arts, rows).collect()}
    assert facets[("source", "logs")] == 2 and facets[("source", "webshell")] == 1 and facets[("severity", "1")] == 2


def test_decisions_write_events_only_on_change(spark):
    rows = frame(spark, [finding(1, "a"), finding(2, "b", "confirmed", note="keep")])
    decisions = spark.createDataFrame([("a", "confirmed", "n"), ("b", "confirmed", None)], "artifact string, state string, note string")
    arts = ops.artifacts(rows, runs(spark, []))
    assert [r.artifact for r in ops.decision_events(arts, decisions, 5).collect()] == ["a"]
    assert {r.artifact: (r.triage, r.triage_note) for r in ops.decide(rows, decisions, 5).collect()} == {"a": ("confirmed", "n"), "b": ("confirmed", "keep")}


def test_a_name_is_not_a_path(spark, make_requests):
    r = make_requests([("a", 1, "GET", "/index.php", 200), ("b", 2, "GET", "/shop/index.php", 200), ("c", 3, "GET", "/shop/up/x.php?q", 404),
                       ("d", 4, "GET", "/up/x.php/", 200), ("e", 5, "GET", "/UP/X.php", 200)])
    files = spark.createDataFrame([("/r/index.php", "index.php"), ("/r/up/x.php", "up/x.php")], "artifact string, rel string")
    got = {(t.artifact, t.ip) for t in touches.touches(r, files).collect()}
    assert got == {("/r/index.php", "a"), ("/r/up/x.php", "c"), ("/r/up/x.php", "e")}


def test_one_hot_name_does_not_pair_up(spark, make_requests):
    rows = [(f"10.0.{i % 7}.{i % 50}", i, "GET", f"/d{i % 40}/index.php", 200) for i in range(400)]
    files = spark.createDataFrame([(f"/r/d{i}/index.php", f"d{i}/index.php") for i in range(300)], "artifact string, rel string")
    got = touches.touches(make_requests(rows), files)
    assert got.agg(F.sum("hits")).first()[0] == 400
    want = {(f"/r/d{i % 40}/index.php", f"10.0.{i % 7}.{i % 50}") for i in range(400)}
    assert {(t.artifact, t.ip) for t in got.collect()} == want


def test_propagation_goes_one_step(spark):
    arts = spark.createDataFrame([("/r/x.php", "file", "new"), ("1.1.1.1", "client", "new"), ("2.2.2.2", "client", "reviewed"),
                                  ("3.3.3.3", "client", "dismissed"), ("/r/y.php", "file", "new")], "artifact string, artifact_kind string, triage string")
    touched = spark.createDataFrame([("/r/x.php", "1.1.1.1", 5, 2), ("/r/x.php", "2.2.2.2", 3, 0), ("/r/x.php", "3.3.3.3", 9, 9), ("/r/y.php", "1.1.1.1", 1, 1)],
                                    "artifact string, ip string, hits long, ok_hits long")
    reached = touches.propagate(arts, spark.createDataFrame([("/r/x.php",)], "artifact string"), touched)
    got = {r.artifact: (r.outcome, r.why) for r in reached.collect()}
    assert got == {"1.1.1.1": ("linked", "loaded x.php (2× 2xx)"), "2.2.2.2": ("suggested", "requested x.php, never successful (3×)")}
    assert [r.artifact for r in touches.propagated_decisions(reached).collect()] == ["1.1.1.1"]


def test_indicator_merge_edit_delete(spark):
    old = spark.createDataFrame([("1.1.1.1", "other", "mine", ["analyst"], "o", 1)], schemas.IOCS)
    new = spark.createDataFrame([("1.1.1.1", "ip", "", ["hunt"], "x", 2), ("a.test", "domain", "", [], "y", 2)], schemas.IOCS)
    merged = iocs.merge(old, new)
    got = {r.value: (r.type, r.note, r.tags, r.origin) for r in merged.collect()}
    assert got == {"1.1.1.1": ("other", "mine", ["analyst", "hunt"], "o"), "a.test": ("domain", "", [], "y")}
    links = spark.createDataFrame([("a.test", "1.1.1.1", "host-in", "")], schemas.IOC_LINKS)
    kept, edges = iocs.delete(merged, links, spark.createDataFrame([("1.1.1.1",)], "value string"))
    assert kept.count() == 1 and edges.count() == 0
    changed = iocs.edit(merged, spark.createDataFrame([("a.test", "url", None), ("1.1.1.1", "nonsense", "n")], "value string, new_type string, new_note string"))
    assert {r.value: (r.type, r.note) for r in changed.collect()} == {"a.test": ("url", ""), "1.1.1.1": ("other", "mine")}
    entries = spark.createDataFrame([(" D41D8CD98F00B204E9800998ECF8427E ", "", None), ("2001:DB8::1", "", "n"), ("", "ip", "")], "value string, type string, note string")
    assert {(r.value, r.type) for r in iocs.manual(entries, 1).collect()} == {("d41d8cd98f00b204e9800998ecf8427e", "hash"), ("2001:DB8::1", "ip")}


def test_withdrawal_spares_backed_and_manual_indicators(spark):
    box = spark.createDataFrame([("a", "ip", "", ["hunt"], "", 1), ("b", "ip", "", ["analyst"], "", 1), ("c", "ip", "", [], "", 1)], schemas.IOCS)
    prov = spark.createDataFrame([("a", "x", "direct", True), ("b", "x", "direct", True), ("c", "x", "direct", True), ("c", "y", "direct", True)], schemas.IOC_SOURCES)
    gone = spark.createDataFrame([("x",)], "artifact string")
    got = {r.value: r.removable for r in iocs.removable(box, iocs.retire(prov, gone), gone).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_cross_case_keys(spark):
    rows = [("me", "2001:0db8:0:0::1", "ip"), ("me", "A.test", "domain"), ("me", "/X", "path"), ("o1", "2001:db8::1", "ip"), ("o1", "a.TEST", "domain"), ("o2", "/x", "path")]
    df = spark.createDataFrame(rows, "case string, value string, type string")
    assert {(r["case"], r["key"]) for r in iocs.cross_case(df, "me").collect()} == {("o1", "2001:db8::1"), ("o1", "a.test")}
    assert tuple(iocs.cross_case_summary(df, "me").first()) == (2, 2, 1, 2)


def test_chronology(spark, make_requests):
    r = make_requests([("9.9.9.9", 50, "GET", "/up/x.php", 404, "m", 1, 7200), ("1.1.1.1", 100, "GET", "/up/x.php", 200, "m", 1, 7200),
                       ("1.1.1.1", 900, "GET", "/images/y.php", 200, "m", 1, 7200)])
    confirmed = spark.createDataFrame([("/r/up/x.php", "file", 0), ("1.1.1.1", "client", 1), ("wp_posts", "table", 0)], "artifact string, artifact_kind string, worst int")
    touched = touches.touches(r, touches.web_files(confirmed, ["/r"]))
    table = actors.actor_table(r)
    timed = chronology.alert_times(alerts.alerts(r, table), r)
    for mode, shift in (("log", 7200), ("utc", 0)):
        events = chronology.file_events(confirmed, touched, ["/r"], mode).unionByName(chronology.client_events(confirmed, table, timed, mode))
        got = [(e["at"] - shift, e.kind) for e in events.orderBy(*chronology.event_order()).collect()]
        assert got == [(100, "first_contact"), (100, "success"), (900, "alert"), (900, "last_access")], mode
    assert "first by 9.9.9.9 at 1970-01-01 00:00:50 UTC" in events.filter("kind = 'success'").first().detail
    assert [tuple(m) for m in chronology.missing_from_story(confirmed, events).collect()] == [("wp_posts", "table", "undated.table")]
    assert {m.why for m in chronology.missing_from_story(confirmed, events, 1).collect()} == {"undated.table", "beyond_cap"}
    flags = chronology.gap_statements(confirmed, events, r.select(F.min("epoch")), clock_logs=1).first()
    assert flags.at_log_start and flags.logs_clock_set and not flags.only_attempts
    assert [m.role for m in chronology.milestones(events).orderBy("at", "role").collect()] == ["first", "first_success", "first_alert", "last"]
    accounts = spark.createDataFrame([("eve", True, "t", "1970-01-01 00:05:00", ""), ("old", False, "t", "1969-01-01 00:00:00", "")],
                                     "login string, admin boolean, table string, registered string, last_login string")
    span = actors.index_totals(r).select("first_epoch", "last_epoch", F.lit(0).alias("tz"))
    assert [e.title for e in chronology.account_events(accounts, span).collect()] == ["Account eve registered (administrator)"]


def test_exports(spark, make_requests, tmp_path):
    r = make_requests([("a", i, "GET", "=cmd" if i % 2 else "/x", 200) for i in range(1, 30)])
    cells = exports.trace_cells(r.withColumnRenamed("ip", "client"))
    one, two = exports.content_digest(cells.repartition(3)).first(), exports.content_digest(cells.orderBy(F.desc("Time")).coalesce(1)).first()
    assert tuple(one) == tuple(two) and one.rows == 29
    assert exports.content_digest(cells.limit(28)).first().sha256 != one.sha256
    exports.write_trace(cells, str(tmp_path), {"Clients": "a"})
    manifest = spark.read.json(f"{tmp_path}/manifest").first()
    assert manifest["rows"] == 29 and not manifest.truncated
    box = spark.createDataFrame([("1.1.1.1", "ip", "", ["hunt"], "o", 1), ("it's.php", "path", "n", [], "o", 1), ("t", "other", "", [], "", 1)], schemas.IOCS)
    links = spark.createDataFrame([("1.1.1.1", "it's.php", "requested", "2×"), ("1.1.1.1", "gone", "requested", "")], schemas.IOC_LINKS)
    edges = iocs.edges(box, links)
    spans = spark.createDataFrame([("1.1.1.1", "2026-01-01", "2026-01-02")], "ip string, first_seen string, last_seen string")
    shown = exports.stix_indicators(box, spans)
    assert {x.pattern for x in shown.collect()} == {"[ipv4-addr:value = '1.1.1.1']", "[file:name = 'it\\'s.php']"}
    objects = [json.loads(x.json) for x in exports.stix_objects(shown, exports.stix_relationships(edges, shown), "2026-01-01T00:00:00.000Z").collect()]
    assert sorted(o["type"] for o in objects) == ["indicator", "indicator", "relationship"]
    rows = {x.Value: x.Related for x in exports.ioc_csv(box, edges, spans).collect()}
    assert rows == {"1.1.1.1": "requested it's.php", "it's.php": "was requested by 1.1.1.1", "t": ""}
    first = exports.write_version(box, str(tmp_path / "iocs"), 1)
    exports.append_skipped(spark.createDataFrame([("logs", "/x", "r")], schemas.SKIPPED), str(tmp_path / "skipped"))
    assert spark.read.parquet(first).count() == 3 and spark.read.parquet(str(tmp_path / "skipped")).count() == 1
    note = spark.range(1).select(exports.frame_note("log", F.array(F.lit(0), F.lit(7200))).alias("n")).first().n
    assert "UTC, UTC+02:00" in note


def test_report_hides_the_examiners_paths(spark):
    rows = frame(spark, [finding(1, "/home/me/case/site/a.php", "confirmed", kind="file", rule="in /home/me/case/site/a.php", note="see /home/me/case")])
    row = report.decisions(rows, ["/home/me/case", "/home/me/case/site"]).first()
    assert row.artifact == "a.php" and row.rules == ["in [evidence]/a.php [logs.x]"] and row.notes == ["see [evidence]"]


FAST = ["actor_table", "alerts", "day_series", "request_flags", "hunt_all_clients", "sigma_clients", "quiet_windows", "parsed_log_lines",
        "file_touches", "injected_values", "dump_rows", "accounts", "artifact_fold", "tree_diff", "error_log_paths", "cms_items", "countries"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_check(spark, sf, name):
    from tools.check_oracle import rows

    con = duckdb.connect()
    for table in ("events", "pages", "documents", "customer", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    query = catalogue.QUERIES[name]
    got = query.run(spark, sf)
    cursor = con.execute(query.check_sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, cursor.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_log_of_indicators_against_a_replay(spark):
    """Random logs, replayed event by event."""
    dice = random.Random(6)
    for _ in range(3):
        events, links, box, edges = [], [], {}, {}
        for seq in range(160):
            value = f"v{dice.randrange(6)}"
            action = dice.choice(["add", "add", "retype", "note", "delete", "link", "link"])
            if action == "link":
                other, kind = f"v{dice.randrange(6)}", dice.choice("xy")
                links.append((seq, value, other, kind, f"l{seq}"))
                if value in box and other in box and value != other:
                    edges.setdefault((value, other, kind), f"l{seq}")
                continue
            kind, note, tags = dice.choice(["ip", "domain", "bad"]), f"n{seq}", dice.sample("abc", 2)
            events.append((seq, value, action, kind, note, tags, f"o{seq}", seq))
            if action == "add" and value not in box:
                box[value] = [kind, note, set(tags), f"o{seq}", seq]
            elif action == "delete":
                box.pop(value, None)
                edges = {e: n for e, n in edges.items() if value not in e[:2]}
            elif value in box:
                if action == "add":
                    box[value][2] |= set(tags)
                elif action == "note":
                    box[value][1] = note
                elif kind != "bad":
                    box[value][0] = kind
        log = spark.createDataFrame(events, "seq long, value string, action string, type string, note string, tags array<string>, origin string, added long")
        lines = spark.createDataFrame(links, "seq long, src string, dst string, kind string, note string")
        got = {r.value: [r.type, r.note, set(r.tags), r.origin, r.added] for r in iocs.fold(log).collect()}
        assert got == box
        assert {(r.src, r.dst, r.kind): r.note for r in iocs.fold_links(log, lines).collect()} == edges


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_of_a_dump_do_not_meet_in_one_task(spark):
    """Joins with what is known of a dump, a table or an engine carry its few rows to the others."""
    from webtrail.operators import accounts, dumps

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # of sizes that nobody knows beforehand
    try:
        _low_cardinality_joins(spark, accounts, dumps)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def _low_cardinality_joins(spark, accounts, dumps):
    rows = spark.range(50).selectExpr("'/d.sql' AS dump", "'wp_users' AS `table`", "id AS row_no", "array('ID') AS columns", "array(CAST(id AS string)) AS values")
    plan = planned(accounts.accounts(rows))
    assert not [line for line in plan.split("\n") if "SortMergeJoin [dump#" in line and "user_id" not in line]
    made = spark.range(50).selectExpr("'/d.sql' AS dump", "'t' AS `table`", "id AS stmt_order", "0L AS row_in_stmt", "array('a') AS insert_columns", "array('x') AS values")
    created = spark.createDataFrame([], "dump string, table string, columns array<string>")
    lines = [line for line in planned(dumps.dump_rows(made, created)).split("\n") if "SortMergeJoin" in line and "stmt_order" not in line]
    assert not [line for line in lines if "LeftOuter" not in line and "run#" not in line]
    live = ops.with_live(frame(spark, [finding(1)]).union(frame(spark, [finding(2)])), runs(spark, [("logindex", 1, True)]))
    assert "SortMergeJoin" not in planned(live)


def test_lines_of_accounts_stand_in_many_blocks(spark, tmp_path):
    from webtrail.plans import case_queries

    keys = [(k, f"Customer#{k}", 1, "BUILDING") for k in [*range(4500), 7, None]]
    spark.createDataFrame(keys, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    assert case_queries.account_lines(spark, str(tmp_path)).groupBy("block").count().count() == 5
    rows = case_queries.dump_rows_by_line(spark, str(tmp_path))
    assert rows.filter("width = 10").groupBy().agg(F.count("*"), F.countDistinct("v1")).first()[:] == (4501, 4500)
    assert rows.count() == 4502


def test_the_derived_log_is_written_in_one_pass(spark, monkeypatch, tmp_path):
    from webtrail.functions.text import computed_once
    from webtrail.plans import log_queries

    read = spark.sparkContext.accumulator(0)

    def line(k):
        read.add(1)
        return f"line {k}"

    sources = spark.range(30).selectExpr("id AS pos", "element_at(array('/logs/a/access.log', '/logs/b/access.log', '/logs/b/other.log'), CAST(id % 3 + 1 AS int)) AS source")
    lines = computed_once(sources.withColumn("value", F.udf(line, "string")("pos")))
    monkeypatch.setattr(log_queries, "log_lines", lambda *_: lines)
    _, folders = log_queries._log_folders(spark, f"{tmp_path}/one-pass")
    assert read.value == 30
    assert sorted(r.value for r in spark.read.text(folders["other"]).collect()) == sorted(f"line {k}" for k in range(2, 30, 3))
    assert set(folders) == {"a", "b", "other"}


def test_parts_of_indicators_and_story_read_stored_rows(spark, sf):
    from webtrail.plans import bindings, case_queries

    case_queries.collected(spark, sf)
    case_queries.story(spark, sf)
    names = {name for _, folder, name in bindings._WRITTEN if folder == sf}
    assert {"finding_digests", "touched", "story"} <= names


def test_requests_of_a_table_in_one_file_have_many_tasks(spark, sf):
    from webtrail.plans import bindings

    assert bindings.requests(spark, sf).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_search_looks_at_accounts_of_every_system_and_at_indicators(spark, tmp_path):
    from tools.check_oracle import rows

    ts = "timestamp_seconds(1704067200 + 60 * id) AS ts"
    tables = {"events": spark.range(80).selectExpr("id AS event_id", ts, "id % 12 AS user_id", "IF(id % 3 = 0, 'error', 'view') AS event_type"),
              "pages": spark.range(100, 112).selectExpr("id AS page_id", "'http://a.test/' AS url", "'<p>x</p>' AS html"),
              "documents": spark.range(6).selectExpr("id AS doc_id", "'plain' AS text", "'en' AS lang", "'s' AS source"),
              "customer": spark.range(9, 11).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "1 AS c_nationkey", "'BUILDING' AS c_mktsegment")}
    con = duckdb.connect()
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    query = catalogue.QUERIES["global_search"]
    found = query.run(spark, str(tmp_path))
    got = found.collect()
    assert [r.value for r in got if r.group == "accounts"] == ["customer.10"] * 3
    assert ("images/f104.php", "path") in {(r.value, r.extra) for r in got if r.group == "iocs"}
    cursor = con.execute(query.check_sql)
    assert rows(found.columns, got) == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_search_shows_equal_logins_in_a_stated_order(spark):
    from webtrail.operators import search

    none = spark.createDataFrame([], "artifact string, worst int, ip string, requests long, value string, type string, note string, added long")
    people = spark.createDataFrame([(f"/{i}.sql", "1", "admin", f"e{i * 7 % 20:02}") for i in range(20)], "dump string, user_id string, login string, email string")
    found = search.global_search("adm", none, none, people.repartition(5), none)
    assert sorted(r.extra for r in found.collect()) == [f"e{i:02}" for i in range(8)]


def test_a_cell_of_the_indicator_export_names_every_relation(spark):
    box = spark.createDataFrame([("1.1.1.1", "ip", "", ["hunt"], "o", 1), ("/p7", "path", "", [], "o", 1)], schemas.IOCS).union(
        spark.range(8, 508).selectExpr("concat('/p', id)", "'path'", "''", "array()", "'o'", "1L"))
    links = spark.range(7, 508).selectExpr("'1.1.1.1' AS src", "concat('/p', id) AS dst", "'requested' AS kind", "'' AS note")
    spans = spark.createDataFrame([], "ip string, first_seen string, last_seen string")
    cells = {r.Value: r.Related for r in exports.ioc_csv(box, iocs.edges(box, links.unionAll(links)), spans).collect()}
    assert cells.pop("1.1.1.1") == "; ".join(sorted(f"requested /p{i}" for i in range(7, 508)))
    assert len(cells) == 501 and set(cells.values()) == {"was requested by 1.1.1.1"}

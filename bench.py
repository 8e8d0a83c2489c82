"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webtrail.plans import bindings, catalogue, log_queries  # noqa: E402
from webtrail.session import local_session  # noqa: E402
from webtrail.sinks import exports  # noqa: E402
from webtrail.sources import files, logs  # noqa: E402

HEADLINE = [
    "actor_table", "alerts", "day_series", "sparklines", "trace_page_by_size", "hunt_all_clients", "library_hunt",
    "sigma_clients", "quiet_windows", "parsed_log_lines", "file_findings", "tree_diff", "error_log_findings",
    "dump_rows", "injected_findings", "accounts", "stored_findings", "artifact_fold", "file_touches", "propagation",
    "collected_indicators", "cross_case_matches", "chronology", "cms_items", "countries",
]


def run(name, action, results):
    begin = time.perf_counter()
    action()
    results[name] = round(time.perf_counter() - begin, 3)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.range(1000).selectExpr("sum(id)").collect()
    results: dict[str, float] = {}
    only = set(sys.argv[1:])

    # Raw text log -> index: the reference point is lines indexed per second at about a
    # million lines, so the derived log is written as often as that takes.
    folder = tempfile.mkdtemp(prefix="webtrail-bench-")
    base = log_queries.log_lines(spark, sf).select("value").cache()
    copies = max(1, min(10, 1_000_000 // base.count()))
    for copy in range(copies):
        base.repartition(int(cpus)).write.text(f"{folder}/logs/{copy}")
    base.unpersist()
    paths = [row.path for row in files.listing(spark, [f"{folder}/logs"]).collect() if "/part-" in row.path and "/." not in row.path]
    lines = files.lines(spark, paths).count()
    run("parse_text_log", lambda: logs.requests(logs.access_lines(spark, paths)).write.format("noop").mode("overwrite").save(), results)
    run("index_build", lambda: exports.write_index(logs.requests(logs.access_lines(spark, paths)), f"{folder}/index"), results)

    for name in HEADLINE:
        if not only or name in only:
            run(name, lambda: catalogue.QUERIES[name].run(spark, sf).write.format("noop").mode("overwrite").save(), results)
    print(json.dumps({
        "metric": "sum of headline queries", "value": round(sum(results.values()), 3), "unit": "sec", "queries": results,
        "sf": os.path.basename(sf.rstrip("/")), "log_lines": lines,
        "parse_lines_per_sec": round(lines / results["parse_text_log"]),
        "index_lines_per_sec": round(lines / results["index_build"]),
        "events": bindings.table(spark, sf, "events").count()}))


if __name__ == "__main__":
    main()

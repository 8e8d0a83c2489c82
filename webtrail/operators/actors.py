"""Per-client behaviour: one row per client address, its hours, days and burst.

Skew: one scanner address may own most rows. Every aggregate here is algebraic, so
rows are combined before the shuffle. The distinct count of agents is a second
grouping over (ip, agent) instead of an expanding ``count(distinct)``. The login
burst is a range window over (ip, day) blocks, never over one address's history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import predicates as is_, times, uris
from webtrail.functions.text import any_of

# kind of outcome-gated probe -> the flag column that marks it
PROBES = {"sqli": "f_sqli", "traversal": "f_traversal",
          "upload_php": "f_upload_php", "cms_dir_php": "f_cms_dir_php"}
_DAY = fixed.LOGIN_WINDOW_SECONDS
_UNDATED = 2**62  # orders an undated row after every dated one


def flagged(requests: DataFrame) -> DataFrame:
    """Requests with one boolean per predicate. An index stores these columns, so the
    regular expressions run once per line and never again."""
    if "f_login" in requests.columns:
        return requests
    uri = F.col("uri")
    return requests.select(
        "*",
        is_.login_endpoint(uri).alias("f_login"),
        is_.authenticated_area(uri).alias("f_admin_area"),
        is_.sql_injection(uri).alias("f_sqli"),
        is_.path_traversal(uri).alias("f_traversal"),
        is_.upload_php(uri).alias("f_upload_php"),
        is_.cms_directory_php(uri).alias("f_cms_dir_php"),
        is_.scanner_agent(F.col("agent")).alias("f_scanner"),
    )


def line_order() -> Column:
    """Where a line stands: by time, then source, then place in the source."""
    return F.struct(F.coalesce("epoch", F.lit(_UNDATED)).alias("at"), "source", "pos")


def login_posts(requests: DataFrame) -> DataFrame:
    return flagged(requests).filter((F.col("method") == "POST") & F.col("f_login"))


def login_burst(requests: DataFrame) -> DataFrame:
    """The most login POSTs of a client inside any 24 hours.

    A window that ends at second t touches t's day and the day before. Each second is
    therefore put into its own day's block and, as context, into the next one; the
    range frames run inside a block of at most two days. Equal seconds are counted
    together first, so a block holds at most 172,800 rows whatever the traffic. What lies
    in the window is the running sum up to t without the one up to 24 hours before: both
    frames only grow, while a sliding one is summed anew for every row.
    """
    seconds = (
        login_posts(requests).filter(F.col("epoch").isNotNull())
        .groupBy("ip", "epoch").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("day", F.floor(F.col("epoch") / _DAY).cast("long"))
    )
    blocks = seconds.select(
        "ip", "epoch", "n", "day",
        F.explode(F.array(F.col("day"), F.col("day") + 1)).alias("block"),
    )
    block = Window.partitionBy("ip", "block").orderBy("epoch")
    upto = F.sum("n").over(block.rangeBetween(Window.unboundedPreceding, 0))
    gone = F.sum("n").over(block.rangeBetween(Window.unboundedPreceding, -_DAY))
    return (
        blocks.withColumn("in_window", upto - F.coalesce(gone, F.lit(0)))
        .filter(F.col("block") == F.col("day"))
        .groupBy("ip").agg(F.max("in_window").alias("login_burst"))
    )


def login_statuses(requests: DataFrame) -> DataFrame:
    """ip -> map(status -> count) of its login POSTs (at most one entry per code)."""
    return (
        login_posts(requests).groupBy("ip", "status").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("ip")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))
             .alias("login_statuses"))
    )


def scanner_agents(requests: DataFrame) -> DataFrame:
    """Every distinct (client, scanner agent), uncapped, in long form."""
    return flagged(requests).filter("f_scanner").select("ip", "agent").distinct()


def shown_scanner_agents(agents: DataFrame, limit: int = 5) -> DataFrame:
    """The first few scanner agents per client, in text order, for display."""
    rank = F.row_number().over(Window.partitionBy("ip").orderBy("agent"))
    return (
        agents.withColumn("rank", rank).filter(F.col("rank") <= limit)
        .groupBy("ip").agg(F.array_sort(F.collect_list("agent")).alias("scanner_uas"))
    )


_TZ_SHIFT = 262144  # offsets lie within +-86400 seconds


def _partials() -> list[Column]:
    """Counters of fixed width only. A text or a struct in the buffer would make Spark
    sort all lines before it combines them; so the texts are found apart, on few rows.

    The offset of the latest line rides in the low digits of its own time."""
    status, size, ok = F.col("status"), F.col("size"), is_.answered_ok(F.col("status"))
    login = F.col("f_login") & (F.col("method") == "POST")
    out = [
        F.count(F.lit(1)).alias("requests"),
        F.min("epoch").alias("first_epoch"),
        F.max("epoch").alias("last_epoch"),
        F.max(F.col("epoch") * _TZ_SHIFT + F.col("tz") + _TZ_SHIFT // 2).alias("latest"),
        F.count_if(status.between(400, 499)).alias("err4"),
        F.count_if(status >= 500).alias("err5"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if(size.isNull()).alias("bytes_unknown"),
        F.count_if(F.col("method") == "POST").alias("posts"),
        F.count_if(login).alias("login_posts"),
        F.count_if(login & status.isin(301, 302, 303)).alias("login_redirects"),
        F.min(F.when(login, F.col("epoch"))).alias("login_first"),
        F.max(F.when(login, F.col("epoch"))).alias("login_last"),
        F.count_if(F.col("f_admin_area") & ok).alias("admin_ok"),
    ]
    for kind, flag in PROBES.items():
        answered = F.col(flag) & ok
        out += [
            F.count_if(F.col(flag)).alias(f"{kind}_attempts"),
            F.count_if(answered).alias(f"{kind}_ok"),
            F.min(F.when(answered, size)).alias(f"{kind}_size_min"),
            F.max(F.when(answered, size)).alias(f"{kind}_size_max"),
            F.count_if(answered & size.isNotNull()).alias(f"{kind}_sized"),
            F.count_if(answered & size.isNull()).alias(f"{kind}_unsized"),
        ]
    return out


_SUMS = ["requests", "err4", "err5", "bytes", "bytes_unknown", "posts", "login_posts",
         "login_redirects", "admin_ok"]


def actor_counts(requests: DataFrame) -> DataFrame:
    """The counters of every client in two groupings: (ip, agent), then ip."""
    partial = flagged(requests).groupBy("ip", "agent").agg(*_partials())
    merge = [F.sum(c).alias(c) for c in _SUMS]
    merge += [F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"),
              F.max("latest").alias("latest"), F.min("login_first").alias("login_first"),
              F.max("login_last").alias("login_last"), F.count(F.lit(1)).alias("agents")]
    for kind in PROBES:
        merge += [F.sum(f"{kind}_{c}").alias(f"{kind}_{c}") for c in ("attempts", "ok", "sized", "unsized")]
        merge += [F.min(f"{kind}_size_min").alias(f"{kind}_size_min"),
                  F.max(f"{kind}_size_max").alias(f"{kind}_size_max")]
    tz = (F.pmod(F.col("latest"), F.lit(_TZ_SHIFT)) - _TZ_SHIFT // 2).cast("int")
    return partial.groupBy("ip").agg(*merge).withColumn("tz", F.coalesce(tz, F.lit(0))).drop("latest")


def probe_examples(requests: DataFrame) -> DataFrame:
    """The first target per client and kind of probe, over the rows that are one."""
    order = line_order()
    hits = flagged(requests).filter(any_of([F.col(f) for f in PROBES.values()]))
    first = hits.groupBy("ip").agg(*[
        F.min(F.when(F.col(flag), F.struct(order.alias("o"), F.col("uri")))).alias(kind) for kind, flag in PROBES.items()])
    return first.select("ip", *[F.col(kind)["uri"].alias(f"{kind}_example") for kind in PROBES])


def actor_table(requests: DataFrame) -> DataFrame:
    """One finished row per client. The texts beside the counters come from the few rows
    that are logins, scanners or probes; over an index their flags prune the scan."""
    marked = flagged(requests)
    return (
        actor_counts(marked)
        .join(login_burst(marked), "ip", "left")
        .join(login_statuses(marked), "ip", "left")
        .join(shown_scanner_agents(scanner_agents(marked)), "ip", "left")
        .join(probe_examples(marked), "ip", "left")
        .withColumns({
            "login_burst": F.coalesce("login_burst", F.lit(0)),
            "scanner_uas": F.coalesce("scanner_uas", F.array().cast("array<string>")),
            **{f"{k}_example": F.coalesce(f"{k}_example", F.lit("")) for k in PROBES},
        })
    )


def dated(requests: DataFrame) -> DataFrame:
    return requests.filter(F.col("epoch").isNotNull())


def actor_hours(requests: DataFrame) -> DataFrame:
    """Requests per client and local hour."""
    return (
        dated(requests)
        .groupBy("ip", times.local_hour(F.col("epoch"), F.col("tz")).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def day_outcomes(requests: DataFrame) -> DataFrame:
    """Requests, 2xx answers and errors per local day."""
    return (
        dated(requests)
        .groupBy(times.local_day(F.col("epoch"), F.col("tz")).alias("day"))
        .agg(
            F.count(F.lit(1)).alias("requests"),
            F.count_if(is_.answered_ok(F.col("status"))).alias("ok"),
            F.count_if(F.col("status") >= 400).alias("errors"),
        )
    )


def days(requests: DataFrame, actors: DataFrame) -> DataFrame:
    """The day series with clients seen for the first time that day."""
    newcomers = (
        actors.filter(F.col("first_epoch").isNotNull())
        .groupBy(times.local_day(F.col("first_epoch"), F.col("tz")).alias("day"))
        .agg(F.count(F.lit(1)).alias("new_clients"))
    )
    return (
        day_outcomes(requests).join(newcomers, "day", "left")
        .withColumn("new_clients", F.coalesce("new_clients", F.lit(0)))
    )


def timeline_for(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """The day series of the chosen clients only."""
    chosen = clients.select("ip").distinct()
    return day_outcomes(requests.join(chosen, "ip", "left_semi"))


def source_counts(lines: DataFrame) -> DataFrame:
    """Per log file: parsed and unparsed lines. ``lines`` has source, value, record;
    a blank line is neither."""
    return lines.groupBy("source").agg(
        F.count_if(F.col("record").isNotNull()).alias("lines"),
        F.count_if(F.col("record").isNull() & (F.trim("value") != "")).alias("unparsed"),
    )


def index_totals(requests: DataFrame) -> DataFrame:
    """Lines, clients, undated lines, span and the offsets that occur.

    Grouped by client and offset first, so the distinct counts need no second pass
    over the lines."""
    per_client = requests.groupBy("ip", "tz").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("epoch").isNull()).alias("undated"),
        F.min("epoch").alias("first"), F.max("epoch").alias("last"))
    return per_client.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"),
        F.count_distinct("ip").alias("clients"),
        F.coalesce(F.sum("undated"), F.lit(0)).alias("undated"),
        F.min("first").alias("first_epoch"),
        F.max("last").alias("last_epoch"),
        F.array_sort(F.collect_set("tz")).alias("tz_offsets"),
    )


def top_uris(requests: DataFrame, ip: str, limit: int = 12) -> DataFrame:
    """The targets one client asked for most, with how many were answered 2xx."""
    return (
        requests.filter(F.col("ip") == ip).groupBy("uri")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok"))
        .orderBy(F.desc("n"), "uri").limit(limit)
    )


def top_agents(requests: DataFrame, ip: str, limit: int = 5) -> DataFrame:
    return (
        requests.filter(F.col("ip") == ip).groupBy("agent").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "agent").limit(limit)
    )


def sparklines(hours: DataFrame, clients: DataFrame | None = None,
               buckets: int = fixed.SPARK_BUCKETS) -> DataFrame:
    """48 fixed buckets over the whole case, one dense array per client.

    The case span is two scalar subqueries: values inlined into the plan, no join."""
    low = hours.select(F.min("hour")).scalar()
    high = hours.select(F.max("hour")).scalar()
    wanted = hours if clients is None else hours.join(clients.select("ip").distinct(), "ip", "left_semi")
    width = F.greatest(F.lit(1), F.col("high") - F.col("low") + 1)
    place = F.least(F.lit(buckets - 1),
                    F.floor((F.col("hour") - F.col("low")) * buckets / width)).cast("int")
    filled = (
        wanted.withColumns({"low": low, "high": high})
        .groupBy("ip", place.alias("bucket")).agg(F.sum("n").alias("n"))
        .groupBy("ip").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    )
    return filled.select("ip", F.transform(
        F.sequence(F.lit(0), F.lit(buckets - 1)),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("series"))


def who_requested(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Who asked for any of these file names: the file-to-log pivot."""
    wanted = names.select(uris.leaf(F.col("name")).alias("leaf")).filter("leaf <> ''").distinct()
    return (
        requests.join(wanted, "leaf", "left_semi").groupBy("ip", "leaf")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok_hits"))
    )


def requests_for_names(requests: DataFrame, names: DataFrame) -> DataFrame:
    """The same, one row per (client, target)."""
    wanted = names.select(uris.leaf(F.col("name")).alias("leaf")).filter("leaf <> ''").distinct()
    return (
        requests.join(wanted, "leaf", "left_semi").groupBy("ip", "uri", "leaf")
        .agg(F.count(F.lit(1)).alias("hits"), F.count_if(is_.answered_ok(F.col("status"))).alias("ok_hits"))
    )


def actor_spans(actors: DataFrame) -> DataFrame:
    """First and last local day of a client's traffic."""
    return actors.filter(F.col("first_epoch").isNotNull()).select(
        "ip",
        times.local_day(F.col("first_epoch"), F.col("tz")).alias("first_seen"),
        times.local_day(F.col("last_epoch"), F.col("tz")).alias("last_seen"),
    )


# --- classes, search and order of the client list ----------------------------


def actor_classes() -> dict[str, Column]:
    """Named classes of a client; ``alerted`` is a join (see ``actors_of_class``)."""
    scanner = F.size("scanner_uas") > 0
    flood = F.col("login_posts") >= fixed.LOGIN_THRESHOLD
    return {
        "scanner": scanner,
        "bruteforce": flood,
        "probes": (F.col("sqli_attempts") > 0) | (F.col("traversal_attempts") > 0)
        | (F.col("upload_php_attempts") > 0),
        "quiet": ~(((F.col("login_redirects") > 0) & flood) | (F.col("upload_php_ok") > 0) | flood
                   | scanner | (F.col("sqli_ok") > 0) | (F.col("sqli_attempts") > 0)
                   | (F.col("traversal_ok") > 0)),
    }


def alerted_clients(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("kind").isin(*fixed.INFO_ALERT_KINDS)).select("ip").distinct()


def actors_of_class(actors: DataFrame, alerts: DataFrame, keep: str = "",
                    hide: tuple[str, ...] = (), search: str = "") -> DataFrame:
    """Keep one class, remove any number of others, match part of the address."""
    classes = actor_classes()
    out = actors
    if search:
        out = out.filter(F.lower("ip").contains(search.lower()))
    for name, wanted in [(keep, True)] + [(h, False) for h in hide]:
        if name == "alerted":
            out = out.join(alerted_clients(alerts), "ip", "left_semi" if wanted else "left_anti")
        elif name:
            out = out.filter(classes[name] if wanted else ~classes[name])
    return out


def actor_order(name: str = "requests") -> list[Column]:
    orders = {
        "requests": F.desc("requests"),
        "first": F.asc_nulls_first("first_epoch"),
        "last": F.desc_nulls_last("last_epoch"),
        "errors": (F.col("err4") + F.col("err5")).desc(),
        "alerts": F.desc("login_posts"),
    }
    return [orders.get(name, orders["requests"]), F.asc("ip")]


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of a sorted list; the total is a separate exact count."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)

"""Indicators: collecting, merging, withdrawing, relating and comparing them.

An indicator's value is its key. Relations are one-hop joins; nothing iterates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import indicators as ind, uris
from webtrail.functions.text import holds


def _tags(*names) -> Column:
    return F.array_compact(F.array(*[n if isinstance(n, Column) else F.lit(n) for n in names]))


def with_ipv6(df: DataFrame, value: str) -> DataFrame:
    """Adds the compressed IPv6 form; a plain test stands before the parsing."""
    text = F.trim(F.col(value))
    return df.withColumn("ipv6", F.when(ind.may_be_ipv6(text), ind.compressed_ipv6(text)))


def manual(entries: DataFrame, now: int) -> DataFrame:
    """Indicators added by hand: the stated type when there is such a type, else the
    classified one. ``entries``: value, type, note."""
    typed = with_ipv6(entries.filter(F.trim("value") != ""), "value").withColumn(
        "type", F.when(F.col("type").isin(*fixed.IOC_TYPES), F.col("type")).otherwise(
            ind.classify(F.col("value"), F.col("ipv6"))))
    text = F.trim("value")
    return typed.select(
        F.when(F.col("type") == "hash", F.lower(text)).otherwise(text).alias("value"), "type",
        F.coalesce("note", F.lit("")).alias("note"), _tags("analyst").alias("tags"),
        F.lit("added by the analyst").alias("origin"), F.lit(now).cast("long").alias("added"))


def merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Add indicators. A known one keeps its type, note, origin and date; tags unite.

    Tags are a closed list, so the sets collected per value stay small."""
    rows = stored.withColumn("rank", F.lit(0)).unionByName(new.withColumn("rank", F.lit(1)))
    first = F.min_by(F.struct("type", "note", "origin", "added"), F.struct("rank", "added", "type", "origin", "note"))
    tags = rows.select("value", F.explode_outer("tags").alias("tag")).distinct().groupBy("value").agg(
        F.array_sort(F.collect_list("tag")).alias("tags"))
    kept = rows.groupBy("value").agg(first.alias("f"))
    return kept.join(tags, "value").select("value", "f.type", "f.note", "tags", "f.origin", "f.added")


def edit(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Retype or re-note. ``changes``: value, new_type, new_note (NULL leaves it)."""
    valid = changes.filter(F.col("new_type").isNull() | F.col("new_type").isin(*fixed.IOC_TYPES))
    return stored.join(valid, "value", "left").withColumns({
        "type": F.coalesce("new_type", "type"), "note": F.coalesce("new_note", "note"),
    }).drop("new_type", "new_note")


def _alive(events: DataFrame) -> DataFrame:
    """The changes after the last deletion of their value."""
    ends = events.filter("action = 'delete'").groupBy("value").agg(F.max("seq").alias("since"))
    return events.join(ends, "value", "left").filter(F.col("seq") > F.coalesce("since", F.lit(-1))).drop("since")


def fold(events: DataFrame) -> DataFrame:
    """The indicators that a log of changes leaves. ``events``: seq (their order), value, action (add,
    retype, note, delete), type, note, tags, origin, added; a row is never changed.

    A deletion ends a life: what came before it counts no more, and an addition after it begins anew.
    In one life the first addition gives type, note, origin and date, later ones only tags; the last
    valid retype and the last note after it hold. A change of what is not there does nothing."""
    add, retype, renote = (F.col("action") == a for a in ("add", "retype", "note"))
    retype = retype & F.col("type").isin(*fixed.IOC_TYPES)
    # Only the last edit of a kind matters: if it stands before the addition, no other one stands after.
    rows = _alive(events).groupBy("value").agg(
        F.min(F.when(add, F.struct("seq", "type", "note", "origin", "added"))).alias("first"),
        F.max(F.when(retype, F.struct("seq", "type"))).alias("retyped"), F.max(F.when(renote, F.struct("seq", "note"))).alias("noted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(add, F.col("tags")))))).alias("tags"))
    rows = rows.filter("first IS NOT NULL")
    after = lambda edit, name: F.when(F.col(edit)["seq"] > F.col("first.seq"), F.col(edit)[name]).otherwise(F.col("first")[name])
    return rows.select("value", after("retyped", "type").alias("type"), after("noted", "note").alias("note"), "tags", "first.origin", "first.added")


def fold_links(events: DataFrame, links: DataFrame) -> DataFrame:
    """The edges that the log leaves: ``links`` are seq, src, dst, kind, note. An edge is drawn between
    what is there, goes with either of its ends and does not come back with it; of repeated ones the
    first stays."""
    for end in ("src", "dst"):
        links = links.join(_alive(events).filter("action = 'add'").groupBy(F.col("value").alias(end)).agg(F.min("seq").alias("begun")), end).filter("seq > begun").drop("begun")
    return links.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.min_by("note", "seq").alias("note"))


def delete(stored: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove indicators together with the edges at either end."""
    g = gone.select("value").distinct()
    kept = links.join(g.select(F.col("value").alias("src")), "src", "left_anti").join(
        g.select(F.col("value").alias("dst")), "dst", "left_anti").select("src", "dst", "kind", "note")
    return stored.join(g, "value", "left_anti"), kept


# --- collecting ---------------------------------------------------------------


def _rows(df: DataFrame, value, kind, tags, origin, now, note="") -> DataFrame:
    return df.select(value.alias("value"), F.lit(kind).alias("type"), F.lit(note).alias("note"), tags.alias("tags"),
                     origin.alias("origin"), F.lit(now).cast("long").alias("added"))


def collect_actors(actors: DataFrame, now: int) -> DataFrame:
    """Clients with the tags their own counters give them."""
    from webtrail.operators.alerts import actor_tags

    origin = F.concat(F.lit("actor: "), F.col("requests").cast("string"), F.lit(" request(s)"))
    return _rows(actors, F.col("ip"), "ip", actor_tags(), origin, now)


def rule_summary(confirmed: DataFrame) -> DataFrame:
    """Per confirmed artifact: its rule names as text and what they mention."""
    distinct = confirmed.groupBy("artifact", "artifact_kind", "rule").agg(
        F.min("severity").alias("severity"),
        F.max((F.col("source") == "webshell").cast("int")).alias("webshell"))
    text = F.lower("rule")
    return distinct.groupBy("artifact", "artifact_kind").agg(
        # Rule names are a closed list: at most one row each per artifact.
        F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("severity", "rule"))),
                                             lambda x: x["rule"]), ", "), 1, 200).alias("rules"),
        F.max("webshell").alias("webshell"),
        F.max(text.contains("scanner").cast("int")).alias("scanner"),
        F.max((text.contains("flood") | text.contains("brute")).cast("int")).alias("brute"),
        F.max(text.contains("successful").cast("int")).alias("successful"))


def collect_confirmed(confirmed: DataFrame, touched: DataFrame, digests: DataFrame, roots: list[str], now: int,
                      requesters: int | None = None, hosts: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indicators, edges and provenance that follow from confirmed findings.

    ``confirmed``: findings of confirmed artifacts; ``touched``: (artifact, ip, hits,
    ok_hits); ``digests``: (artifact, sha256). All requesters and hosts are collected unless
    the caller wants the strongest only.
    """
    arts = rule_summary(confirmed).withColumn("origin", F.concat(F.lit("confirmed: "), F.col("rules")))
    files = arts.filter(F.col("artifact_kind") == "file").withColumn(
        "rel", uris.evidence_path(F.col("artifact"), roots))
    clients = arts.filter(F.col("artifact_kind") == "client")
    tables = arts.filter(F.col("artifact_kind") == "table")
    flag = lambda c, name: F.when(F.col(c) == 1, F.lit(name))

    path_rows = _rows(files, F.col("rel"), "path", _tags("finding", "confirmed", flag("webshell", "webshell")),
                      F.col("origin"), now)
    hashed = files.join(digests, "artifact")
    hash_rows = _rows(hashed, F.col("sha256"), "hash", _tags("derived", "confirmed"),
                      F.concat(F.lit("sha-256 of "), uris.basename(F.col("artifact"))), now)
    order = Window.partitionBy("artifact").orderBy(F.desc("ok_hits"), F.desc("hits"), "ip")
    asked = touched.join(files.select("artifact", "rel"), "artifact")
    if requesters is not None:
        asked = asked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= requesters)
    asked_rows = _rows(
        asked, F.col("ip"), "ip", _tags("hunt", F.when(F.col("ok_hits") > 0, F.lit("successful"))),
        F.format_string("requested %s (%d×, %d× 2xx)", uris.basename(F.col("artifact")), "hits", "ok_hits"), now)
    client_rows = _rows(
        clients, F.col("artifact"), "ip",
        _tags("finding", "confirmed", flag("scanner", "scanner"), flag("brute", "brute-force"),
              flag("successful", "successful")), F.col("origin"), now)
    table_rows = _rows(tables, F.col("artifact"), "other", _tags("finding", "confirmed", "injected-code"),
                       F.col("origin"), now)
    named = (
        confirmed.filter(F.col("artifact_kind") == "table")
        .select("artifact", F.explode(ind.hosts_in(F.coalesce("evidence", F.lit("")))).alias("host"))
        .distinct().join(tables.select("artifact", "rules"), "artifact")
    )
    if hosts is not None:
        named = named.withColumn("place", F.row_number().over(Window.partitionBy("artifact").orderBy("host"))).filter(F.col("place") <= hosts)
    host_rows = _rows(named, F.col("host"), "domain", _tags("derived", "injected-code"),
                      F.concat(F.lit("host in evidence of: "), F.col("rules")), now)
    iocs = path_rows
    for part in (hash_rows, asked_rows, client_rows, table_rows, host_rows):
        iocs = iocs.unionByName(part)

    def edge(df, src, dst, kind, note):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), note.alias("note"))

    links = (
        edge(hashed, F.col("sha256"), F.col("rel"), "hash-of", F.lit(""))
        .unionByName(edge(asked, F.col("ip"), F.col("rel"), "requested",
                          F.format_string("%d× requested, %d× 2xx", "hits", "ok_hits")))
        .unionByName(edge(named, F.col("host"), F.col("artifact"), "host-in", F.substring("rules", 1, 120)))
        .filter(F.col("src") != F.col("dst")).dropDuplicates(["src", "dst", "kind"])
    )

    def origin_of(df, value, role):
        return df.select(value.alias("value"), "artifact", F.lit(role).alias("role"), F.lit(True).alias("active"))

    provenance = origin_of(files, F.col("rel"), "direct")
    for df, value, role in ((hashed, "sha256", "hash"), (asked, "ip", "requester"), (clients, "artifact", "direct"),
                            (tables, "artifact", "direct"), (named, "host", "derived-host")):
        provenance = provenance.unionByName(origin_of(df, F.col(value), role))
    return iocs, links, provenance


def flag_files(paths: DataFrame, roots: list[str], now: int) -> tuple[DataFrame, DataFrame]:
    """Files taken in by hand: path and hash, linked. ``paths``: path, sha256, note."""
    marked = paths.withColumn("rel", uris.evidence_path(F.col("path"), roots))
    rows = marked.select(
        F.col("rel").alias("value"), F.lit("path").alias("type"), F.coalesce("note", F.lit("")).alias("note"),
        _tags("analyst", "modified-file").alias("tags"),
        F.lit("marked by the analyst in the file browser").alias("origin"), F.lit(now).cast("long").alias("added"))
    hashed = marked.filter("sha256 is not null")
    rows = rows.unionByName(_rows(hashed, F.col("sha256"), "hash", _tags("analyst", "derived"),
                                  F.concat(F.lit("sha-256 of "), uris.basename(F.col("path"))), now))
    links = hashed.select(F.col("sha256").alias("src"), F.col("rel").alias("dst"), F.lit("hash-of").alias("kind"),
                          F.lit("").alias("note"))
    return rows, links


def flag_accounts(accounts: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Planted accounts: the login, its e-mail and the edge between them."""
    named = accounts.filter(F.trim("login") != "").withColumns(
        {"login": F.trim("login"), "email": F.trim(F.coalesce("email", F.lit("")))})
    where = F.concat(F.when(F.coalesce("cms", F.lit("")) == "", "CMS").otherwise(F.col("cms")), F.lit(" account from "),
                     F.when(F.coalesce("table", F.lit("")) == "", "the export").otherwise(F.col("table")),
                     F.when(F.col("admin"), " (administrator)").otherwise(""))
    rows = _rows(named, F.col("login"), "user", _tags("analyst", "account"),
                 F.concat(F.lit("marked by the analyst — "), where), now)
    mailed = named.filter("email <> ''")
    rows = rows.unionByName(_rows(mailed, F.col("email"), "email", _tags("analyst", "derived"),
                                  F.concat(F.lit("e-mail of account "), F.col("login")), now))
    links = mailed.filter("email <> login").select(
        F.col("email").alias("src"), F.col("login").alias("dst"), F.lit("account-of").alias("kind"), F.lit("").alias("note"))
    return rows, links


# --- withdrawing --------------------------------------------------------------


def retire(provenance: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """A withdrawn decision switches its provenance off; the rows stay."""
    gone = withdrawn.select("artifact").distinct().withColumn("gone", F.lit(True))
    return provenance.join(gone, "artifact", "left").select(
        "value", "artifact", "role", (F.col("active") & F.col("gone").isNull()).alias("active"))


def removable(stored: DataFrame, provenance: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Indicators a withdrawal leaves without any active source and no analyst put in."""
    per_value = provenance.groupBy("value").agg(F.bool_or("active").alias("active"))
    concerned = provenance.join(withdrawn.select("artifact").distinct(), "artifact", "left_semi").select("value").distinct()
    return (
        stored.join(concerned, "value", "left_semi").join(per_value, "value")
        .select("value", "type", (~F.col("active") & ~F.array_contains("tags", "analyst")).alias("removable"))
    )


# --- relating and comparing ---------------------------------------------------


def edges(stored: DataFrame, links: DataFrame) -> DataFrame:
    """Edges with both ends; an edge whose end is gone drops out."""
    node = stored.select("value", "type")
    src = node.select(F.col("value").alias("src"), F.col("type").alias("src_type"))
    dst = node.select(F.col("value").alias("dst"), F.col("type").alias("dst_type"))
    return links.join(src, "src").join(dst, "dst").select("src", "src_type", "dst", "dst_type", "kind", "note")


def readings(edge_rows: DataFrame) -> DataFrame:
    """Every edge read from both of its ends: (value, relation, other, other_type, note)."""
    forward, back = F.col("kind"), F.col("kind")
    for kind, ahead, behind in fixed.LINK_LABELS:
        forward = F.when(F.col("kind") == kind, ahead).otherwise(forward)
        back = F.when(F.col("kind") == kind, behind).otherwise(back)
    there = edge_rows.select(F.col("src").alias("value"), forward.alias("relation"), F.col("dst").alias("other"),
                             F.col("dst_type").alias("other_type"), "note")
    return there.unionByName(edge_rows.select(
        F.col("dst").alias("value"), back.alias("relation"), F.col("src").alias("other"),
        F.col("src_type").alias("other_type"), "note"))


def with_spans(stored: DataFrame, spans: DataFrame) -> DataFrame:
    """First and last local day for addresses the logs know."""
    s = spans.select(F.col("ip").alias("value"), F.lit("ip").alias("type"), "first_seen", "last_seen")
    return stored.join(s, ["value", "type"], "left")


def visible(stored: DataFrame, hide_types=(), hide_tags=(), search: str = "") -> DataFrame:
    """The box as the analyst sees it: hidden types go, entries whose tags are all
    hidden go, the search looks at value, note and origin."""
    out = stored
    if hide_types:
        out = out.filter(~F.col("type").isin(*hide_types))
    if hide_tags:
        hidden = F.array(*[F.lit(t) for t in hide_tags])
        out = out.filter((F.size("tags") == 0) | (F.size(F.array_except("tags", hidden)) > 0))
    if search.strip():
        term = search.strip()
        out = out.filter(holds(F.col("value"), term) | holds(F.coalesce("note", F.lit("")), term)
                         | holds(F.coalesce("origin", F.lit("")), term))
    return out


def visible_edges(edge_rows: DataFrame, shown: DataFrame) -> DataFrame:
    v = shown.select("value").distinct()
    return (edge_rows.join(v.withColumnRenamed("value", "src"), "src", "left_semi")
            .join(v.withColumnRenamed("value", "dst"), "dst", "left_semi"))


def match_keys(case_iocs: DataFrame) -> DataFrame:
    """(case, type, key): the equality under which two cases hold the same indicator."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("other"))))
    return with_ipv6(case_iocs, "value").withColumn("kind", kind).withColumn(
        "key", ind.match_value(F.col("kind"), F.col("value"), F.col("ipv6"))).drop("ipv6")


def cross_case(case_iocs: DataFrame, current: str) -> DataFrame:
    """Entries of other cases equal to one of this case. This case's side is distinct
    keys, so the result is one row per foreign entry, never a product."""
    keyed = match_keys(case_iocs)
    mine = keyed.filter(F.col("case") == current).select("kind", "key").distinct()
    return keyed.filter(F.col("case") != current).join(mine, ["kind", "key"], "left_semi").select(
        "case", "kind", "key", "value")


def cross_case_summary(case_iocs: DataFrame, current: str) -> DataFrame:
    """How many indicators, entries and cases match, and how many were looked at."""
    pairs = cross_case(case_iocs, current).groupBy("case", "kind", "key").agg(F.count(F.lit(1)).alias("n"))
    others = case_iocs.filter(F.col("case") != current).select(F.count_distinct("case")).scalar()
    return pairs.agg(
        F.count_distinct("kind", "key").alias("matched_iocs"), F.coalesce(F.sum("n"), F.lit(0)).alias("matches"),
        F.count_distinct("case").alias("matched_cases")).withColumn("cases_scanned", others)


def extract(documents: DataFrame, text: str, case: str) -> DataFrame:
    """Addresses and hosts named in free text, once per case."""
    body = F.col(text)
    found = F.concat(
        F.transform(ind.addresses_in(body), lambda v: F.struct(v.alias("value"), F.lit("ip").alias("type"))),
        F.transform(ind.hosts_in(body), lambda v: F.struct(v.alias("value"), F.lit("domain").alias("type"))))
    return documents.select(F.col(case).alias("case"), F.inline(found)).distinct()


def country_of(clients: DataFrame, ranges: DataFrame) -> DataFrame:
    """Country of each address by a range table; special ranges answer first.

    ``ranges``: first, last (inclusive integers), iso. Both sides are cut at /16, so the
    range test is an equality on the block plus a comparison inside it, and a table of
    any size needs no nested loop.
    """
    block = 65536
    cut = ranges.select("first", "last", "iso", F.explode(F.sequence(
        F.floor(F.col("first") / block).cast("long"), F.floor(F.col("last") / block).cast("long"))).alias("block"))
    wanted = clients.select("ip").distinct().select(
        "ip", ind.ipv4_number(F.col("ip")).alias("number"), ind.ipv4_range(F.col("ip")).alias("range"))
    placed = wanted.withColumn("block", F.floor(F.col("number") / block).cast("long"))
    hit = placed.alias("a").join(
        cut.alias("r"), (F.col("a.block") == F.col("r.block")) & F.col("a.range").isNull()
        & F.col("a.number").between(F.col("r.first"), F.col("r.last")), "left")
    return hit.groupBy("a.ip", "a.range").agg(F.min(F.struct(
        (F.col("r.last") - F.col("r.first")).alias("width"), F.col("r.iso").alias("iso")))["iso"].alias("iso")).select(
        "ip", F.coalesce("range", F.lit("")).alias("range"), "iso")


def country_of_ipv6(clients: DataFrame, networks: DataFrame) -> DataFrame:
    """Country of each IPv6 address by a table of networks (``network`` as address/length, iso); special
    ranges answer first, then the longest prefix that holds the address.

    An address is two longs. It is cut at each length that occurs, 129 at most, and meets the table
    by equality of length and prefix."""
    parts = F.split("network", "/")
    cut = networks.select(ind.ipv6_words(parts[0]).alias("w"), parts[1].cast("int").alias("length"), "iso").filter("w IS NOT NULL")
    lengths = sorted(r.length for r in cut.select("length").distinct().collect())
    masks = F.array(*[F.struct(F.lit(n).alias("length"), *[F.lit(m).cast("long").alias(k) for k, m in zip(("m1", "m2"), ind.prefix_mask(n))]) for n in lengths])
    halves = lambda df: df.withColumns(dict(zip(("hi", "lo"), ind.ipv6_halves(F.col("w")))))
    wanted = halves(clients.select("ip").distinct().select("ip", ind.ipv6_words(F.col("ip")).alias("w"), ind.ipv6_range(F.col("ip")).alias("range")).filter("w IS NOT NULL"))
    if not lengths:
        return wanted.select("ip", "range", F.lit(None).cast("string").alias("iso"))
    masked = lambda df: df.withColumns({"hi": F.col("hi").bitwiseAND(F.col("m.m1")), "lo": F.col("lo").bitwiseAND(F.col("m.m2")), "length": F.col("m.length")})
    table = masked(halves(cut).withColumn("m", F.element_at(F.filter(masks, lambda m: m["length"] == F.col("length")), 1))).select("hi", "lo", "length", "iso").distinct()
    placed = masked(wanted.filter("range = ''").select("ip", "hi", "lo", F.explode(masks).alias("m")))
    best = placed.join(table, ["hi", "lo", "length"]).groupBy("ip").agg(F.max(F.struct("length", "iso"))["iso"].alias("iso"))
    return wanted.select("ip", "range").join(best, "ip", "left")

"""Which client asked for which file, and how far a decision travels.

A request addresses a file when the tail of its path is the file's path. A tail of one
segment is only a name, so such a file must be met exactly. Both are equalities: every
distinct request path is written out once per tail, and the tail joins on equality.
A name shared by thousands of files (index.php) therefore never pairs up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtrail import fixed_values as fixed
from webtrail.functions import predicates as is_, uris


def request_paths(requests: DataFrame) -> DataFrame:
    """Requests combined to (client, path): hits, 2xx hits, times."""
    ok = is_.answered_ok(F.col("status"))
    return requests.groupBy("ip", uris.uri_path(F.col("uri")).alias("path")).agg(
        F.count(F.lit(1)).alias("hits"), F.count_if(ok).alias("ok_hits"),
        F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"),
        F.min(F.when(ok, F.col("epoch"))).alias("first_ok"), F.max(F.when(ok, F.col("epoch"))).alias("last_ok"),
        F.max_by("tz", F.abs("tz")).alias("tz"))


def addressed(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, artifact): request paths that mean a file. ``paths``: path; ``files``:
    artifact, rel (below the web root, lower case)."""
    tails = paths.select("path").distinct().select(
        "path", F.explode(F.when(F.col("path").startswith("/"), uris.suffixes(F.col("path")))).alias("tail"))
    # A one-segment tail counts only when it is the whole path, and a tail is the literal
    # end of the path: a slash behind a file name means something else.
    whole = F.concat(F.lit("/"), F.col("tail"))
    tails = tails.filter(F.col("path").endswith(whole) & (F.col("tail").contains("/") | (F.col("path") == whole)))
    targets = files.select("artifact", F.trim("rel", F.lit("/")).alias("tail")).filter("tail <> ''")
    return tails.join(targets, "tail").select("path", "artifact")


def touches(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(artifact, client) with hits, 2xx hits and the measured times."""
    met = request_paths(requests)
    return (
        met.join(addressed(met, files), "path")
        .groupBy("artifact", "ip").agg(
            F.sum("hits").alias("hits"), F.sum("ok_hits").alias("ok_hits"),
            F.min("first_epoch").alias("first_epoch"), F.max("last_epoch").alias("last_epoch"),
            F.min("first_ok").alias("first_ok"), F.max("last_ok").alias("last_ok"),
            F.max_by("tz", F.abs("tz")).alias("tz"))
    )


def web_files(arts: DataFrame, roots: list[str]) -> DataFrame:
    return arts.filter(F.col("artifact_kind") == "file").select(
        "artifact", uris.web_path(F.col("artifact"), roots).alias("rel"))


def propagate(arts: DataFrame, decided: DataFrame, touched: DataFrame) -> DataFrame:
    """A decision travels exactly one step: file to client, client to file.

    Linked when a request was answered 2xx, otherwise only suggested; only artifacts
    still open are reached. ``decided``: artifact; ``touched`` from ``touches``.
    """
    state = arts.select("artifact", "artifact_kind", "triage")
    open_ = state.filter(F.col("triage").isin(*fixed.OPEN_STATES)).join(decided, "artifact", "left_anti")
    pairs = touched.select(F.col("artifact").alias("file"), F.col("ip").alias("client"), "hits", "ok_hits")

    def step(origin, target, kind):
        from_ = decided.select(F.col("artifact").alias(origin))
        to = open_.filter(F.col("artifact_kind") == kind).select(
            F.col("artifact").alias(target), F.col("triage").alias("previous"))
        return pairs.join(from_, origin, "left_semi").join(to, target).select(
            F.col(target).alias("artifact"), F.lit(kind).alias("artifact_kind"), F.col(origin).alias("origin"),
            "hits", "ok_hits", "previous")

    reached = step("file", "client", "client").unionByName(step("client", "file", "file"))
    # One row per target: the origin that says most.
    best = F.max_by(F.struct("origin", "hits", "ok_hits"), F.struct("ok_hits", "hits", "origin"))
    return (
        reached.groupBy("artifact", "artifact_kind", "previous").agg(best.alias("b"))
        .select("artifact", "artifact_kind", "previous", "b.*")
        .withColumn("outcome", F.when(F.col("ok_hits") > 0, "linked").otherwise("suggested"))
        .withColumn("why", F.when(
            F.col("artifact_kind") == "client",
            F.when(F.col("ok_hits") > 0, F.concat(F.lit("loaded "), uris.basename(F.col("origin")), F.lit(" ("),
                                                  F.col("ok_hits").cast("string"), F.lit("× 2xx)")))
            .otherwise(F.concat(F.lit("requested "), uris.basename(F.col("origin")),
                                F.lit(", never successful ("), F.col("hits").cast("string"), F.lit("×)"))))
            .otherwise(F.when(F.col("ok_hits") > 0, F.concat(F.lit("loaded by "), F.col("origin"), F.lit(" ("),
                                                             F.col("ok_hits").cast("string"), F.lit("× 2xx)")))
                       .otherwise(F.concat(F.lit("requested by "), F.col("origin"),
                                           F.lit(", never successful ("), F.col("hits").cast("string"), F.lit("×)")))))
    )


def propagated_decisions(reached: DataFrame) -> DataFrame:
    return reached.filter(F.col("outcome") == "linked").select(
        "artifact", F.lit("confirmed").alias("state"), F.concat(F.lit("propagated: "), F.col("why")).alias("note"))


def related_addresses(arts: DataFrame, findings: DataFrame, touched: DataFrame, iocs: DataFrame,
                      limit: int | None = None) -> DataFrame:
    """Addresses an artifact points at, each once, the strongest reason first; all of them
    unless the caller sets a limit for display."""
    from webtrail.functions.indicators import addresses_in

    own = arts.filter(F.col("artifact_kind") == "client").select(
        "artifact", F.col("artifact").alias("ip"), F.lit(0).alias("priority"), F.lit("this client").alias("why"),
        F.lit(None).cast("long").alias("hits"), F.lit(None).cast("long").alias("ok_hits"))
    name = uris.basename(F.col("artifact"))
    asked = touched.select(
        "artifact", "ip", F.lit(1).alias("priority"),
        F.when(F.col("ok_hits") > 0, F.concat(F.lit("loaded "), name, F.lit(" ("), F.col("ok_hits").cast("string"),
                                              F.lit("× 2xx)")))
        .otherwise(F.concat(F.lit("requested "), name, F.lit(", never successful"))).alias("why"), "hits", "ok_hits")
    named = findings.select(
        "artifact", F.explode(addresses_in(F.col("evidence"))).alias("ip"),
        F.lit(2).alias("priority"), F.concat(F.lit("from the evidence of: "), F.col("rule")).alias("why"),
        F.lit(None).cast("long").alias("hits"), F.lit(None).cast("long").alias("ok_hits"))
    every = own.unionByName(asked).unionByName(named)
    reason = F.min(F.struct("priority", (-F.coalesce("ok_hits", F.lit(0))).alias("a"),
                            (-F.coalesce("hits", F.lit(0))).alias("b"), "why", "hits", "ok_hits"))
    once = every.groupBy("artifact", "ip").agg(reason.alias("r"))
    order = Window.partitionBy("artifact").orderBy("r.priority", "r.a", "r.b", "ip")
    box = iocs.filter(F.col("type") == "ip").select(F.col("value").alias("ip")).distinct().withColumn("in_box", F.lit(True))
    placed = once.withColumn("place", F.row_number().over(order))
    return (
        (placed if limit is None else placed.filter(F.col("place") <= limit))
        .join(box, "ip", "left")
        .select("artifact", "ip", "place", "r.why", "r.hits", "r.ok_hits", F.coalesce("in_box", F.lit(False)).alias("in_box"))
    )

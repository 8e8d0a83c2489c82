"""Every request of chosen clients, filtered, sorted and paged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtrail.functions import predicates as is_
from webtrail.functions.text import holds
from webtrail.functions.uris import basename


def trace(requests: DataFrame, clients: DataFrame | list[str], from_epoch: int | None = None,
          to_epoch: int | None = None, search: str = "", status: str = "", method: str = "") -> DataFrame:
    """The matching requests, unsorted and whole. Time and status bounds are plain
    comparisons, so they reach the scan as pushed filters."""
    if isinstance(clients, list):
        out = requests.filter(F.col("ip").isin(*clients)) if clients else requests.limit(0)
    else:
        out = requests.join(clients.select("ip").distinct(), "ip", "left_semi")
    if from_epoch is not None:
        out = out.filter(F.col("epoch") >= from_epoch)
    if to_epoch is not None:
        out = out.filter(F.col("epoch") <= to_epoch)
    if status in is_.STATUS_CLASSES:
        out = out.filter(is_.status_class(F.col("status"), status))
    if method.strip():
        out = out.filter(F.col("method") == method.strip().upper())
    if search.strip():
        out = out.filter(holds(F.col("uri"), search.strip()) | holds(F.col("agent"), search.strip()))
    return out


def trace_order(name: str = "time") -> list[Column]:
    place = [F.asc("source"), F.asc("pos")]
    early = F.asc_nulls_first("epoch")
    orders = {
        "time": [early, *place],
        "time_desc": [F.desc_nulls_last("epoch"), F.desc("source"), F.desc("pos")],
        "status": [F.desc("status"), early, *place],
        "size": [F.desc_nulls_last("size"), early, *place],
        "uri": [F.asc("uri"), early, *place],
    }
    return orders.get(name, orders["time"])


def trace_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("ip").alias("client"), "epoch", "tz", "method", "uri", "status", "size",
                       "referrer", "agent", basename(F.col("source")).alias("source"), "pos")


def methods(requests: DataFrame, clients: list[str]) -> DataFrame:
    """The methods the chosen clients used."""
    return (requests.filter(F.col("ip").isin(*clients) & (F.col("method") != ""))
            .select("method").distinct())

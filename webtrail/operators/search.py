"""One search over artifacts, indicators, accounts and clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtrail.functions.text import holds

PER_GROUP = 8


def global_search(term: str, arts: DataFrame, iocs: DataFrame, accounts: DataFrame, actors: DataFrame,
                  limit: int = PER_GROUP) -> DataFrame:
    """(group, value, extra): the first few hits of each group. Each limit is a top-k of
    its own, so no group is sorted as a whole."""
    none = arts.limit(0).select(F.lit("").alias("group"), F.lit("").alias("value"), F.lit("").alias("extra"))
    if len(term.strip()) < 2:
        return none
    t = term.strip()

    def group(df, name, hit, order, value, extra):
        return df.filter(hit).orderBy(*order).limit(limit).select(
            F.lit(name).alias("group"), F.col(value).alias("value"), F.col(extra).cast("string").alias("extra"))

    return (
        group(arts, "artifacts", holds(F.col("artifact"), t), ["worst", "artifact"], "artifact", "worst")
        .unionAll(group(iocs, "iocs", holds(F.col("value"), t) | holds(F.coalesce("note", F.lit("")), t),
                        [F.desc("added"), "value"], "value", "type"))
        .unionAll(group(accounts, "accounts", holds(F.col("login"), t) | holds(F.coalesce("email", F.lit("")), t),
                        ["login", "user_id", "email"], "login", "email"))
        .unionAll(group(actors, "actors", holds(F.col("ip"), t), [F.desc("requests"), "ip"], "ip", "requests"))
    )

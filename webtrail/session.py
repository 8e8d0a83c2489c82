"""Session settings shared by the tests, the bench and ad-hoc use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench.

    On a cluster the session is the caller's: nothing in the library creates one.
    """
    builder = SparkSession.builder.master(f"local[{cores}]").appName("webtrail")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.checkpoint.dir", _own_folder())
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("WEBTRAIL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


_own: list[str] = []


def _own_folder() -> str:
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="webtrail-"))
    return _own[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's checkpoint folder.

    Only a session that names none and runs on one machine (tests) gets a local one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: a shared folder is needed")
    return _own_folder()

"""Spark session settings and the shared folder intermediate tables are written to."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_LOCAL_FOLDERS: dict[str, str] = {}


def build_session(name: str = "tidegauge", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are written for; on a cluster, master and sizes come
    from the submit command."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor reaches: the cluster's spark.checkpoint.dir. A temporary folder
    stands in only where Spark runs in one local process and none is set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="spark-tidegauge-")
    return _LOCAL_FOLDERS[app]

"""Spark session helpers.

The library never creates a session inside an operator; entry points and
tests call :func:`get_spark`.  Cluster settings (shuffle partitions, file
split size, checkpoint folder) are read from the session when present and
only defaulted where unset, so a cluster's own configuration always wins.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults applied only when the running session does not define them.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what is provably small; 32 MB is the planner's ceiling.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.ui.enabled": "false",
    # local mode runs every task in the driver JVM; ignored once a JVM is up
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "shelfsense") -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` (or an already set SparkContext checkpoint dir)
    is used as is.  Only when neither is set and the master is local (tests)
    a scratch folder is created, under ``$SHELFSENSE_SCRATCH`` or the system
    temp folder; on any other master a missing setting is an error, because a
    machine's own folder is not seen by the other machines.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        base = os.environ.get("SHELFSENSE_SCRATCH") or tempfile.gettempdir()
        conf_dir = tempfile.mkdtemp(prefix="shelfsense-ckpt-", dir=base)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike a local checkpoint) and truncates plans
    that grow with every iteration of a driver loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df: DataFrame, **options) -> DataFrame:
    """``df``, written once as Parquet under the shared checkpoint folder and read from there.

    For rows that several readers take: columns are compressed, and each reader reads only those that it needs, where
    :func:`cut_lineage` keeps whole rows as serialised objects.  The order of rows is not kept.
    ``options`` are those of the writer."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)

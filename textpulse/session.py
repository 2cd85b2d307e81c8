"""Spark session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "textpulse") -> SparkSession:
    """Session with the settings the library is tuned for.

    AQE stays on (partition coalescing and skew-join splitting at runtime);
    the UI is off because nothing here needs a web server.
    """
    master = master or os.environ.get("TEXTPULSE_MASTER", "local[*]")
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("TEXTPULSE_DRIVER_MEMORY", "8g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    A cluster names a shared folder there. Only a local master may go without:
    it gets a private scratch folder. Elsewhere a missing setting is an error,
    since each executor would write to its own disk. The folder is registered
    once per context (registering it again would nest a new folder in it).
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or _LOCAL.get(sc.applicationId)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="textpulse-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_LOCAL: dict[str, str] = {}

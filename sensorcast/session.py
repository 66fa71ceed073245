"""Session construction and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(cpus: int | str | None = None, shuffle_partitions: int | None = None,
              app: str = "sensorcast", **conf) -> SparkSession:
    """A session with the settings the library relies on.

    On a cluster the submitter decides master, memory and partitions: none of
    them is set unless asked for. ``cpus`` asks for a local session (tests,
    bench); ``shuffle_partitions`` overrides Spark's setting.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.showConsoleProgress", "false"))
    if cpus is not None:
        b = b.master(f"local[{cpus}]").config("spark.driver.memory", "16g")
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """True where driver and executors are one process (``local``, ``local[n]``);
    ``local-cluster`` and every other master have executors of their own."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a folder of this machine stands in, but only in a local
    session: on a cluster each executor would write to a disk of its own and
    the read-back would lack rows, so the call is refused.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="sensorcast-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
        d = spark.sparkContext.getCheckpointDir()
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/sensorcast/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's scratch tables (call when its results are
    written); True if there was anything to delete."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{checkpoint_root(spark).rstrip('/')}/sensorcast/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.delete(path, True)

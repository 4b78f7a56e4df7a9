"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stargraph") -> SparkSession:
    """Session for tests and the bench. On a cluster, build the session with the cluster's own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("STARGRAPH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local_master(master: str) -> bool:
    """True for ``local`` and ``local[...]``, where driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    Read from the session.  Only a ``local`` master (tests, bench) may leave it unset: a fresh folder is then
    created and registered.  On any other master an unset folder is an error, because a machine-local folder
    would scatter the intermediate tables over the executors' disks.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not path:
            if not is_local_master(sc.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="stargraph-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared folder (one per write)."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for pure-Python inspection in tests only)."""
    return path[5:] if path.startswith("file:") else path


def materialize(df, name: str):
    """Write ``df`` as parquet to a fresh folder under the shared folder and read it back.

    Cuts the lineage (a lost executor no longer recomputes everything upstream) and lets several consumers
    of one intermediate table share a single computation; the parquet copy keeps column pruning and
    predicate pushdown for the readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


__all__ = ["local_session", "is_local_master", "shared_dir", "scratch_path", "local_path", "materialize"]

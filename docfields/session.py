"""Local sessions for tests and benchmarks, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Applications whose intermediate tables this driver clears when it ends.
_applications: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session; on a cluster the session comes from the submitting environment."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docfields")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # HotSpot leaves larger methods uncompiled; Spark then falls back to smaller ones.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="docfields-")
    spark.conf.set(CHECKPOINT_DIR, own)
    return own


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/docfields/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that still read them must be written before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    # A session that was stopped before has no file system to ask any more.
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        clear(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no other table uses, below the shared folder and the id of this application.

    The folder of the application goes when the driver ends; ``clear`` removes it earlier.
    """
    application = spark.sparkContext.applicationId
    if application not in _applications:
        _applications.add(application)
        atexit.register(_clear_at_exit, spark)
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"

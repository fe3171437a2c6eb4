"""Session helpers used by tests, bench and the entry file."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SEQLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run.

    A job submitted with --py-files has it already; the zip is then a no-op.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "seqloom")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "seqloom"))
    sc._seqloom_shipped = True


@contextmanager
def pickled_by_value():
    """Within this block functions and classes of the package travel whole.

    The worker that sets up a stateful streaming operator starts outside the
    job, where files added to the session are not on its path.
    """
    package = sys.modules["seqloom"]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir.

    A temporary folder is made only where the session names none (local runs).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir()

"""Incremental loads into a table of what is done, bucketed by its key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import shared_dir

BUCKETS = 64


def processed_table(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
    """Makes or finds the table at `path`: rows of `schema`, bucketed by `key`, a folder for each run.

    The files are the table: a session whose catalogue doesn't know it yet takes it up again.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"create table if not exists {name} ({schema}, run_id string) using parquet partitioned by (run_id) clustered by ({key}) into {buckets} buckets location '{path}'")
    spark.sql(f"msck repair table {name}")


def not_in_table(rows: DataFrame, name: str, key: str, run_id: str) -> DataFrame:
    """The rows whose key no other run has loaded; the processed side is read in its buckets and not shuffled."""
    done = rows.sparkSession.table(name).filter(F.col("run_id") != run_id).select(key)
    return rows.join(done, key, "left_anti")


def load_run(rows: DataFrame, name: str, key: str, run_id: str) -> None:
    """Adds the rows that no other run has loaded, under the run's id.

    A run that is repeated replaces its own folder, so nothing is added twice. Keys of ``rows`` are unique.
    """
    spark = rows.sparkSession
    columns = [c for c in spark.table(name).columns if c != "run_id"]
    staged = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"  # a table can't be replaced while it is read
    not_in_table(rows, name, key, run_id).select(*columns).write.parquet(staged)
    spark.read.schema(rows.select(*columns).schema).parquet(staged).createOrReplaceTempView(f"{name}_new")
    run = run_id.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"insert overwrite table {name} partition (run_id = '{run}') select {', '.join(columns)} from {name}_new")
    spark.catalog.dropTempView(f"{name}_new")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

"""Helpers shared by the operators: written tables, array views of Arrow columns, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import shared_dir

SLICE_BYTES = 1 << 20  # text handled at once inside a task


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*frames: DataFrame) -> None:
    """Deletes the folders of tables made by written() once nothing reads them."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as none of the columns needs to clash with it."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def utf8_views(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one buffer, and each row's offsets in it (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about SLICE_BYTES of text; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = utf8_views(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at)
            at = to


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has an edge: rows (node, component).

    Alternates the large-star and small-star steps; a node's neighbours are only
    aggregated to their minimum and joined with it, so no neighbour list is ever
    gathered. Every round is written to the shared folder. Edges with a null end and
    self loops are ignored; no edge gives no row.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    now = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        near = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v"), "edges")
        # small star: the smaller neighbours of u, and u, are linked to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        small = written(small.where("u <> v").distinct(), "edges")
        drop_written(now, large)
        now = small
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end u has one smaller end v, which is no u itself: nothing is left to link."""
    ends = edges.select(F.col("u").alias("end"), F.lit(1).alias("n"), F.lit(0).alias("centre")).unionByName(edges.select("v", F.lit(0), F.lit(1)).toDF("end", "n", "centre"))
    return ends.groupBy("end").agg((F.sum("n") + F.max("centre")).alias("n")).where("n > 1").isEmpty()


__all__ = ["components", "drop_written", "scratch", "text_slices", "unused", "utf8_views", "written"]

"""Views that shape the test tables into manifests, frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions.rand import uniform
from seqloom.operators.manifest import derive_group

CLIP_BLOCK = 300  # vec_ids per clip block: bounds a clip by construction


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a clip manifest with stems like 12_1 (three copies a group)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    sid = F.col("doc_id").cast("string")
    grp = F.expr("cast(doc_id div 3 as string)")
    u = uniform(F.col("doc_id"), "split")
    d = d.select(
        "doc_id",
        F.concat(F.lit("clips/"), "lang", F.lit("/"), sid, F.lit(".npz")).alias("npz"),
        F.concat(F.lit("videos/"), "source", F.lit("/"), "lang", F.lit("/"), sid, F.lit(".mp4")).alias("video"),
        F.concat("lang", F.lit("-"), (F.col("n_chars") % 10).cast("string")).alias("label"),
        F.concat(grp, F.lit("_"), (F.col("doc_id") % 3).cast("string")).alias("stem"),
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("source")).alias("signer_id"),
        F.when(u < 0.15, "test").when(u < 0.2, " TEST ").when(u < 0.3, "val").when(u < 0.4, "").otherwise("train").alias("split"),
        (F.col("n_chars") % 300).cast("int").alias("n_frames"),
        F.lit(25.0).alias("fps"),
        uniform(F.col("doc_id"), "det").alias("det_rate"),
        uniform(F.col("doc_id"), "lhand").alias("lhand_rate"),
        uniform(F.col("doc_id"), "rhand").alias("rhand_rate"),
    )
    return d.withColumn("group_id", derive_group(F.col("stem")))


def conversations_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as a second, narrower manifest whose paths collide with the first."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_ord"),
        F.concat(F.lit("clips/en/"), F.col("conv_id").cast("string"), F.lit(".npz")).alias("npz"),
        F.col("role").alias("label"),
        F.col("conv_id").cast("string").alias("stem"),
        (F.length("text") % 300).cast("int").alias("n_frames"),
    )


def _slice_of_embedding(first: int, n: int):
    return F.expr("array(" + ",".join(f"cast(embedding[{j % 64}] as double)" for j in range(first, first + n)) + ")")


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as landmark frames: coordinate j of a frame is value j mod 64.

    A clip is (label, block of 300 vec_ids), so it never exceeds 300 frames.
    """
    e = table(spark, sf_dir, "embeddings")
    e = e.select(
        "vec_id",
        "label",
        F.expr("concat(cast(label as string), '-', cast(vec_id div %d as string))" % CLIP_BLOCK).alias("clip_id"),
        F.lit(25.0).alias("fps"),
        _slice_of_embedding(0, 18).alias("pose"),
        _slice_of_embedding(18, 42).alias("lhand"),
        _slice_of_embedding(60, 42).alias("rhand"),
        _slice_of_embedding(102, 40).alias("face"),
        F.expr("transform(sequence(0, 8), i -> if((vec_id + i) % 6 = 0, 0.2D, 0.9D))").alias("pose_vis"),
        F.expr("vec_id % 7 <> 3 and vec_id % 300 >= 20").alias("pose_ok"),
        F.expr("vec_id % 5 <> 0").alias("lhand_ok"),
        F.expr("vec_id % 4 <> 1").alias("rhand_ok"),
    )
    order = W.partitionBy("clip_id").orderBy("vec_id")
    return e.withColumn("frame_idx", F.row_number().over(order) - 1)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a live energy stream per user."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("stream_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("frame_idx"),
        F.col("value").alias("energy"),
        (F.col("event_type") != "error").alias("hands"),
    )

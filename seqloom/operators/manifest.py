"""Clip catalogue and manifest operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqloom.operators.ranking import string_ordinal

# The manifest's columns and their types, in stored order.
MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("npz", T.StringType()),
        T.StructField("video", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("stem", T.StringType()),
        T.StructField("group_id", T.StringType()),
        T.StructField("signer_id", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("n_frames", T.IntegerType()),
        T.StructField("fps", T.DoubleType()),
        T.StructField("det_rate", T.DoubleType()),
        T.StructField("lhand_rate", T.DoubleType()),
        T.StructField("rhand_rate", T.DoubleType()),
    ]
)
BLANK_WHEN_MISSING = ("video", "signer_id", "split")

# File suffixes accepted as clips.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm", ".MP4", ".AVI")


def clip_catalog(paths: DataFrame, path: str, suffixes=VIDEO_SUFFIXES) -> DataFrame:
    """Label (parent folder), stem and suffix of every path with an accepted suffix.

    Paths are file names: any character may stand in them, ``#`` and ``?`` too.
    """
    bare = F.regexp_replace(F.col(path), "/+$", "")
    parts = F.split(bare, "/")
    name = F.element_at(parts, -1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return (
        paths.withColumn("label", F.element_at(parts, -2))
        .withColumn("suffix", suffix)
        .withColumn("stem", F.substr(name, F.lit(1), F.length(name) - F.length(suffix)))
        .filter(F.col("suffix").isin(*suffixes))
    )


def derive_group(stem: Column, pattern: str = r"^(\d+)") -> Column:
    """First capture of ``pattern`` anchored at the start, else the stem itself."""
    if not pattern:
        return stem
    anchored = "^(?:" + pattern + ")"
    return F.when(stem.rlike(anchored), F.regexp_extract(stem, anchored, 1)).otherwise(stem)


def derive_signer(path: Column, pattern: str) -> Column:
    """First capture of ``pattern`` anywhere in the path, else the empty string."""
    if not pattern:
        return F.lit("")
    return F.regexp_extract(path, pattern, 1)


def keep_labels(manifest: DataFrame, keep: DataFrame) -> DataFrame:
    """Rows whose label is in ``keep(label)``; Spark broadcasts the list if small."""
    return manifest.join(keep.select("label").distinct(), "label", "left_semi")


def usable_clips(clips: DataFrame, min_det_rate: float = 0.3, min_frames: int = 6) -> DataFrame:
    """Drops failed and poor clips; an unknown detection rate counts as 1."""
    det = F.coalesce(F.col("det_rate"), F.lit(1.0))
    return clips.withColumn("det_rate", det).filter(
        ~F.col("status").isin("error", "empty") & (F.col("det_rate") >= min_det_rate) & (F.col("n_frames") >= min_frames)
    )


def stride_frames(frames: DataFrame, stride: int = 1, max_frames: int | None = None) -> DataFrame:
    """Every ``stride``-th frame of a clip; only with ``max_frames`` at most so many.

    frame_idx counts 0, 1, 2, ... within a clip, so a cap is a plain filter
    (no window, no shuffle); ``frames_beyond`` tells what it removes.
    """
    fps = F.when(F.col("fps").isNull() | F.isnan("fps") | (F.abs("fps") == float("inf")) | (F.col("fps") <= 1e-3), 30.0).otherwise(F.col("fps"))
    return (
        frames.filter((F.col("frame_idx") % stride == 0) & (F.lit(True) if max_frames is None else F.col("frame_idx") < stride * max_frames))
        .withColumn("kept_idx", F.expr(f"cast(frame_idx div {stride} as int)"))
        .withColumn("fps", fps / stride)
    )


def frames_beyond(frames: DataFrame, stride: int, max_frames: int) -> DataFrame:
    """Clips that lose frames to a cap, and how many."""
    beyond = frames.filter((F.col("frame_idx") % stride == 0) & (F.col("frame_idx") >= stride * max_frames))
    return beyond.groupBy("clip_id").agg(F.count("*").alias("n_removed"))


def clip_quality(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(
        F.count("*").alias("n_frames"),
        F.avg(F.col("pose_ok").cast("double")).alias("det_rate"),
        F.avg(F.col("lhand_ok").cast("double")).alias("lhand_rate"),
        F.avg(F.col("rhand_ok").cast("double")).alias("rhand_rate"),
    )


def complete_columns(manifest: DataFrame) -> DataFrame:
    """The fixed manifest columns, absent ones filled with '' or 0, ids as strings."""
    cols = []
    for f in MANIFEST_SCHEMA:
        if f.name in manifest.columns:
            c = F.col(f.name).cast(f.dataType)
        else:
            c = F.lit("" if f.name in BLANK_WHEN_MISSING else 0).cast(f.dataType)
        if f.name in ("signer_id", "split"):
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(f.name))
    extra = [c for c in ("row_ord",) if c in manifest.columns]
    return manifest.select(*cols, *extra)


def union_manifests(inputs: list[tuple[str, DataFrame]], prefix_groups: bool = True) -> DataFrame:
    """Union by name with ``source`` and input order (src_ord, row_ord) kept.

    Each input is (source name, manifest with a row_ord column).
    """
    parts = []
    for i, (source, m) in enumerate(inputs):
        p = complete_columns(m).withColumn("source", F.lit(source or f"src{i}")).withColumn("src_ord", F.lit(i))
        if prefix_groups:
            p = p.withColumn("group_id", F.concat_ws(":", "source", "group_id"))
        parts.append(p)
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_by_path(manifest: DataFrame) -> DataFrame:
    """Keeps the first row per npz in input order.

    Spark prunes each map partition to its own first row per key before the
    shuffle (WindowGroupLimit), so a path repeated very often stays cheap.
    """
    w = W.partitionBy("npz").orderBy("src_ord", "row_ord")
    return manifest.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def not_yet_done(clips: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return clips.join(done.select(key), key, "left_anti")


def labels_only_in(manifest: DataFrame, have: str = "train", lack: str = "test") -> DataFrame:
    """Labels with rows in split ``have`` and none in split ``lack``, in one pass."""
    return (
        manifest.groupBy("label")
        .agg(F.count_if(F.col("split") == have).alias("n_have"), F.count_if(F.col("split") == lack).alias("n_lack"))
        .filter("n_have > 0 and n_lack = 0")
        .select("label", "n_have")
    )


def keys_in_both(manifest: DataFrame, key: str, a: str = "train", b: str = "test") -> DataFrame:
    """Keys present in both splits: a pre-aggregated intersection."""
    return (
        manifest.groupBy(key)
        .agg(F.count_if(F.col("split") == a).alias("n_a"), F.count_if(F.col("split") == b).alias("n_b"))
        .filter("n_a > 0 and n_b > 0")
    )


def orphans(manifest: DataFrame, catalogue: DataFrame, key: str = "npz") -> DataFrame:
    """Manifest rows whose file is missing from the catalogue."""
    return manifest.join(catalogue.select(key), key, "left_anti")


def require_train_and_test(manifest: DataFrame) -> None:
    n = manifest.agg(F.count_if(F.col("split") == "train"), F.count_if(F.col("split") == "test")).first()
    if not n[0] or not n[1]:
        raise ValueError(f"manifest needs train and test rows, has {n[0]} and {n[1]}")


def complete_sources(manifest: DataFrame, source: str = "source") -> DataFrame:
    """Sources that hold both a train and a test row."""
    return (
        manifest.groupBy(source)
        .agg(F.max((F.col("split") == "train").cast("int")).alias("_tr"), F.max((F.col("split") == "test").cast("int")).alias("_te"), F.count("*").alias("n_clips"))
        .filter("_tr = 1 and _te = 1")
        .drop("_tr", "_te")
    )


def catalog_summary(clips: DataFrame, min_det_rate: float = 0.3, min_frames: int = 6) -> DataFrame:
    """One row: usable, rejected and failed clips, label/group/signer counts, rates.

    Rows are first reduced per (label, group, signer); distinct counts then run
    on that smaller table.
    """
    ok = ~F.col("status").isin("error", "empty")
    det = F.coalesce(F.col("det_rate"), F.lit(1.0))
    use = ok & (det >= min_det_rate) & (F.col("n_frames") >= min_frames)
    base = clips.groupBy("label", "group_id", "signer_id").agg(
        F.count("*").alias("total"),
        F.count_if(use).alias("usable"),
        F.count_if(ok & ~use).alias("rejected"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum(F.when(use, F.col("lhand_rate"))).alias("lsum"),
        F.sum(F.when(use, F.col("rhand_rate"))).alias("rsum"),
    )
    used = F.col("usable") > 0
    per_label = base.groupBy("label").agg(F.sum("usable").alias("usable")).filter("usable > 0")
    small = per_label.agg(F.min("usable").alias("min_per_label"))
    agg = base.agg(
        F.sum("total").alias("total"),
        F.sum("usable").alias("usable"),
        F.sum("rejected").alias("rejected"),
        F.sum("errors").alias("errors"),
        F.count_distinct(F.when(used, F.col("label"))).alias("n_labels"),
        F.count_distinct(F.when(used, F.col("group_id"))).alias("n_groups"),
        F.count_distinct(F.when(used & (F.col("signer_id") != ""), F.col("signer_id"))).alias("n_signers"),
        (F.sum("lsum") / F.sum("usable")).alias("lhand_mean"),
        (F.sum("rsum") / F.sum("usable")).alias("rhand_mean"),
    )
    return agg.withColumn("mean_per_label", F.col("usable") / F.greatest(F.col("n_labels"), F.lit(1))).withColumn(
        "min_per_label", small.scalar()
    )


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """Counts by split and by source and in total, in one grouping-sets pass
    over rows merged per (split, source, label, group, signer)."""
    split = F.when(F.col("split") == "", "(untagged)").otherwise(F.col("split"))
    m = manifest.groupBy(split.alias("split"), "source", "label", "group_id", "signer_id").agg(F.count("*").alias("n"))
    signed = F.col("signer_id") != ""
    g = m.groupingSets(
        [[F.col("split")], [F.col("source")], []],
        F.col("split"),
        F.col("source"),
    ).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("clips"),
        F.count_distinct("label").alias("labels"),
        F.count_distinct("group_id").alias("groups"),
        F.count_distinct(F.when(signed, F.col("signer_id"))).alias("signers"),
        F.sum(F.when(signed, F.col("n")).otherwise(0)).alias("signer_clips"),
    )
    return g.select(
        F.when(F.col("gid") == 1, "split").when(F.col("gid") == 2, "source").otherwise("all").alias("level"),
        F.coalesce("split", "source", F.lit("")).alias("value"),
        "clips",
        "labels",
        "groups",
        "signers",
        "signer_clips",
    )


def rarest_labels(manifest: DataFrame, k: int = 10) -> DataFrame:
    return manifest.groupBy("label").agg(F.count("*").alias("clips")).orderBy("clips", F.desc("label")).limit(k)


def cohort_pivot(manifest: DataFrame, old_labels: DataFrame, splits: list[str]) -> DataFrame:
    """Clips per cohort (label known before or new) and split."""
    known = old_labels.select("label").distinct().withColumn("_old", F.lit(True))
    counts = manifest.groupBy("label", "split").agg(F.count("*").alias("n"))
    tagged = counts.join(known, "label", "left").withColumn("cohort", F.when(F.col("_old"), "old").otherwise("new"))
    return tagged.groupBy("cohort").pivot("split", splits).agg(F.sum("n")).na.fill(0)


def frame_stats(manifest: DataFrame, low_rate: float = 0.6) -> DataFrame:
    """Frame counts are at most a few hundred distinct integers, so the exact
    median's count map stays small however many clips there are."""
    return manifest.agg(
        F.avg("n_frames").alias("mean_frames"),
        F.median("n_frames").alias("median_frames"),
        F.max("n_frames").alias("max_frames"),
        F.count_if(F.col("det_rate") < low_rate).alias("low_det_clips"),
        F.avg("lhand_rate").alias("lhand_mean"),
        F.avg("rhand_rate").alias("rhand_mean"),
    )


def label_map(manifest: DataFrame, with_nosign: bool = True, nosign: str = "__NOSIGN__") -> DataFrame:
    """Distinct labels in code-point order numbered from 0; the no-sign label last.

    Labels are numbered in ranges with offsets, so no task gathers them all.
    """
    labels = manifest.select("label").distinct()
    numbered = string_ordinal(labels, "label", "idx").select(F.col("idx").cast("int").alias("idx"), "label")
    if not with_nosign:
        return numbered
    extra = labels.agg(F.count("*").cast("int").alias("idx"), F.count_if(F.col("label") == nosign).alias("n")).filter("n = 0")
    return numbered.unionByName(extra.select("idx", F.lit(nosign).alias("label")))


def with_label_index(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``idx`` by label; Spark broadcasts the label dictionary while it is small."""
    return clips.join(labels.select("label", "idx"), "label")


def class_weights(train: DataFrame, labels: DataFrame, lo: float = 0.2, hi: float = 5.0) -> DataFrame:
    """Inverse-frequency weights; a class without clips gets the mean count."""
    n = train.groupBy("label").agg(F.count("*").alias("n"))
    j = labels.join(n, "label", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("double"))
    facts = j.agg(
        F.struct(
            F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(1.0)).alias("mean_n"),
            F.count("*").alias("k"),
            F.sum("n").alias("total"),
            F.count_if(F.col("n") == 0).alias("zeros"),
        ).alias("f")
    ).scalar()
    flat = j.withColumn("f", facts).select("idx", "label", "n", "f.*")
    cnt = F.when(F.col("n") == 0, F.col("mean_n")).otherwise(F.col("n"))
    tot = F.col("total") + F.col("zeros") * F.col("mean_n")
    return flat.select("idx", "label", cnt.alias("n"), F.greatest(F.lit(lo), F.least(F.lit(hi), tot / (F.col("k") * cnt))).alias("weight"))


def top_labels(train: DataFrame, k: int) -> DataFrame:
    return train.groupBy("label").agg(F.count("*").alias("clips")).orderBy(F.desc("clips"), "label").limit(k)


def min_support(manifest: DataFrame, min_per_class: int = 8, top_k: int = 0) -> DataFrame:
    """Rows of labels with enough clips over all splits, optionally the K largest."""
    n = manifest.groupBy("label").agg(F.count("*").alias("clips")).filter(F.col("clips") >= min_per_class)
    if top_k:
        n = n.orderBy(F.desc("clips"), "label").limit(top_k)
    return manifest.join(n.select("label"), "label", "left_semi")


def level_plan(runs: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, list[int]]]:
    """Where greedy sharding puts runs of equally large labels: (clips, first, cycle).

    runs lists (clips, labels), largest clips first. Of the labels with so many clips the one with
    number r, from first up to the next row's, goes to shard cycle[(r - first) % len(cycle)].

    Each label goes to the lightest shard, the lowest on ties. Shards whose loads lie within one
    label's clips of the lightest take turns in order of load; the turn grows when
    their level reaches the next shard, so a run is a few cycles however many labels it has.
    """
    loads = [0] * n_shards
    plan = []
    for clips, labels in runs:
        done = 0
        while done < labels:
            order = sorted(range(n_shards), key=lambda s: (loads[s], s))
            level = loads[order[0]]
            turn = [s for s in order if loads[s] < level + clips] if clips else order[:1]
            rest = order[len(turn) :]
            if clips and rest:
                rounds = (loads[rest[0]] - level) // clips
                n = min(labels - done, rounds * len(turn))
            else:
                n = labels - done
            plan.append((clips, done, turn))
            for i, s in enumerate(turn):
                loads[s] += clips * (n // len(turn) + (i < n % len(turn)))
            done += n
    return plan


def balanced_shards(manifest: DataFrame, n_shards: int) -> DataFrame:
    """Greedy label sharding: biggest label first, ties by label, each to the lightest shard, the lowest on ties.

    Labels are numbered within equal numbers of clips, in ranges; the driver only sees how many labels
    there are of each size (n different sizes need n * n / 2 clips) and plans whole runs of them.
    """
    counts = manifest.groupBy("label").agg(F.count("*").alias("clips"))
    sizes = counts.groupBy("clips").agg(F.count("*").alias("labels")).orderBy(F.desc("clips")).collect()
    segments: dict[int, list] = {}
    for clips, first, cycle in level_plan([(r["clips"], r["labels"]) for r in sizes], n_shards):
        segments.setdefault(clips, []).append((first, cycle))
    plan = manifest.sparkSession.createDataFrame(list(segments.items()), "clips bigint, segments array<struct<first:bigint,cycle:array<int>>>")
    placed = string_ordinal(counts, "label", "_nth", ["clips"]).join(plan, "clips")
    at = F.element_at(F.filter("segments", lambda s: s["first"] <= F.col("_nth")), -1)
    return placed.withColumn("_at", at).select("label", "clips", F.expr("_at.cycle[cast((_nth - _at.first) % size(_at.cycle) as int)]").alias("shard"))

"""Registered queries: landmark frames, feature windows, motion energy."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.operators import frames as O
from seqloom.plans.frames_sql import FRAMES, HAND_MIN, SCALE_MIN, VELOCITY, chain, resampled
from seqloom.session import shared_dir
from seqloom.sources import io
from seqloom.sources import surrogates as V


def frames_scan(spark, sf):
    f = V.embedding_frames(spark, sf)
    return O.long_rows(f.select("clip_id", "frame_idx", "pose"), ["clip_id", "frame_idx"], "pose", 6)


def frames_round_trip(spark, sf):
    """All blocks, flags and rates written as a landmark table to the shared folder and read back."""
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex[:12]}"
    f = V.embedding_frames(spark, sf)
    io.write_frames(f.select("clip_id", "frame_idx", "fps", "pose", "lhand", "rhand", "face", "pose_ok", "lhand_ok", "rhand_ok"), path)
    f = io.read_frames(spark, path).withColumn("every", F.concat("pose", "lhand", "rhand", "face"))
    return O.long_rows(f, ["clip_id", "frame_idx", "fps", "pose_ok", "lhand_ok", "rhand_ok"], "every", 6)


def frames_half(spark, sf):
    """Two tagged folders of clips in half precision; the test split alone is read back."""
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex[:12]}"
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "label", "pose", "lhand", "rhand", "face")
    for mode, tag, own in (("overwrite", "train", "label % 3 > 0"), ("append", "test", "label % 3 = 0")):
        io.write_frames(io.with_split_tag(f.filter(own).drop("label"), tag), path, half=True, mode=mode)
    f = io.read_frames(spark, path, "test").withColumn("every", F.concat("pose", "lhand", "rhand", "face"))
    return O.long_rows(f, ["clip_id", "frame_idx", "split"], "every", 9)


def aspect_correct(spark, sf):
    """All blocks, hands included, of frames recorded 640 by 480."""
    f = O.correct_aspect(V.embedding_frames(spark, sf), 640, 480).withColumn("every", F.concat("pose", "lhand", "rhand", "face"))
    return O.long_rows(f, ["clip_id", "frame_idx"], "every", 6)


def clip_slice(spark, sf):
    """Frames 5 to 24 of every clip."""
    f = O.slice_clip(V.embedding_frames(spark, sf), 5, 25)
    return O.long_rows(f, ["clip_id", "frame_idx"], "lhand", 6)


def keypoint_project(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("lm"))
    p = O.project_keypoints(e, "lm", "lm", 640, 480)
    blocks = p.select("vec_id", F.explode(F.array(F.struct(F.lit("pose").alias("block"), F.col("pose").alias("a")), F.struct(F.lit("face").alias("block"), F.col("face").alias("a")))).alias("s"))
    return O.long_rows(blocks.select("vec_id", "s.block", "s.a"), ["vec_id", "block"], "a", 6)


def pose_ffill(spark, sf):
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "pose", "pose_ok")
    keep = O.forward_fill_pose(f).select("clip_id", "frame_idx", F.lit("keep").alias("mode"), "pose_f")
    back = O.forward_fill_pose(f, "backfill").select("clip_id", "frame_idx", F.lit("backfill").alias("mode"), "pose_f")
    return O.long_rows(keep.unionByName(back), ["clip_id", "frame_idx", "mode"], "pose_f", 6)


def body_frame(spark, sf):
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "pose", "pose_ok")
    b = O.body_frame(O.forward_fill_pose(f), SCALE_MIN)
    return b.select("clip_id", "frame_idx", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "scale", "cos_a", "sin_a")])


def hand_local(spark, sf):
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "lhand", "rhand", "lhand_ok", "rhand_ok")
    h = O.hand_shape(f, HAND_MIN)
    vals = [f"{v}" for v in O._local_sql("l") + O._local_sql("r")]
    h = h.selectExpr("clip_id", "frame_idx", "lflag", "rflag", f"array({','.join(vals)}) as loc")
    return O.long_rows(h, ["clip_id", "frame_idx", "lflag", "rflag"], "loc")


def _static(spark, sf):
    return O.static_features(V.embedding_frames(spark, sf), HAND_MIN, SCALE_MIN)


def featurize_static(spark, sf):
    return O.long_rows(_static(spark, sf), ["clip_id", "frame_idx"], "static")


def resample_linear(spark, sf):
    return O.long_rows(O.resample(_static(spark, sf)), ["clip_id", "step"], "static")


def _window(spark, sf):
    return O.build_window(V.embedding_frames(spark, sf), hand_min=HAND_MIN, scale_min=SCALE_MIN)


def velocity(spark, sf):
    w = _window(spark, sf).select("clip_id", "step", F.slice("window", L.DIM_STATIC + 1, L.DIM_GLOBAL).alias("vel"))
    return O.long_rows(w, ["clip_id", "step"], "vel")


def build_window(spark, sf):
    return O.long_rows(_window(spark, sf), ["clip_id", "step"], "window")


def feature_ablation(spark, sf):
    return O.long_rows(O.mask_blocks(_window(spark, sf), ["face", "local_r", "velocity"]), ["clip_id", "step"], "window")


def motion_energy(spark, sf):
    f = V.embedding_frames(spark, sf).select("clip_id", "frame_idx", "fps", "pose", "pose_ok")
    return O.motion_energy(f, SCALE_MIN).select("clip_id", "frame_idx", F.round("energy", 5).alias("energy"))


C = chain()
Z = "+ 0.0"

REGISTRY = {
    "build_window": (
        build_window,
        f"with {FRAMES}, {C}, {resampled()}, {VELOCITY} select clip_id, step::int as step, dim::int as dim, round(v, 5) {Z} as v from win",
    ),
    "frames_scan": (
        frames_scan,
        f"with {FRAMES} select clip_id, f::int as frame_idx, j::int as dim, round(raw[(j+1)::int], 6) {Z} as v from fr, range(18) t(j)",
    ),
    "frames_round_trip": (
        frames_round_trip,
        f"with {FRAMES} select clip_id, f::int as frame_idx, fps, pose_ok, lhand_ok, rhand_ok, j::int as dim, round(raw[(j+1)::int], 6) {Z} as v from fr, range(142) t(j)",
    ),
    "frames_half": (
        frames_half,
        f"""with {FRAMES}, x as (select clip_id, f::int as frame_idx, j::int as dim, raw[(j+1)::int] as v from fr, range(142) t(j) where label % 3 = 0),
            e as (select *, power(2.0::double, 10 - greatest(-14, floor(log2(greatest(abs(v), 1e-9))))) as scale from x)
            select clip_id, frame_idx, 'test' as split, dim, round(sign(v) * round_even(abs(v) * scale, 0) / scale, 9) {Z} as v from e""",
    ),
    "aspect_correct": (
        aspect_correct,
        f"with {FRAMES} select clip_id, f::int as frame_idx, j::int as dim, round(raw[(j+1)::int] * case when j % 2 = 0 then 640.0/480.0 else 1 end, 6) {Z} as v from fr, range(142) t(j)",
    ),
    "clip_slice": (
        clip_slice,
        f"with {FRAMES} select clip_id, f::int as frame_idx, j::int as dim, round(raw[(18+j+1)::int], 6) {Z} as v from fr, range(42) t(j) where f >= 5 and f < 25",
    ),
    "keypoint_project": (
        keypoint_project,
        f"""with ix as (
              select 'pose' as block, i - 1 as o, [{','.join(map(str, L.POSE_IDX))}][i] as p from range(1, 10) t(i) union all
              select 'face', i - 1, [{','.join(map(str, L.FACE_IDX))}][i] from range(1, 21) t(i))
            select vec_id, block, (2*o+d)::int as dim,
              round(case when 2*p+d >= 64 then 0 else embedding[(2*p+d+1)::int]::double * case when d = 0 then 640.0/480.0 else 1 end end, 6) {Z} as v
            from embeddings, ix, range(2) t(d)""",
    ),
    "pose_ffill": (
        pose_ffill,
        f"""with {FRAMES}, x as (select *, max(case when pose_ok then f end) over (partition by clip_id order by f) as src,
              min(case when pose_ok then f end) over (partition by clip_id) as fst from fr),
            y as (select clip_id, f, 'keep' as mode, coalesce(src, f) as s from x union all
                  select clip_id, f, 'backfill', coalesce(src, fst, f) from x)
            select y.clip_id, y.f::int as frame_idx, mode, j::int as dim, round(raw[(j+1)::int], 6) {Z} as v
            from y join fr on fr.clip_id = y.clip_id and fr.f = y.s, range(18) t(j)""",
    ),
    "body_frame": (
        body_frame,
        f"""with {FRAMES}, {C} select clip_id, f::int as frame_idx, round(cx, 5) as cx, round(cy, 5) as cy, round(scale, 5) as scale,
            round(cos(ang), 5) as cos_a, round(sin(ang), 5) as sin_a from ax""",
    ),
    "hand_local": (
        hand_local,
        f"""with {FRAMES}, {C} select s.clip_id, s.f::int as frame_idx, lflag, rflag, (dim-142)::int as dim,
            round(case when dim < 184 then (raw[(dim-142+19)::int]-raw[(19+dim%2)::int])/(lspan+1e-6)*lflag
                  else (raw[(dim-184+61)::int]-raw[(61+dim%2)::int])/(rspan+1e-6)*rflag end, 5) {Z} as v
            from stat s join ax using (clip_id, f) where dim between 142 and 225""",
    ),
    "featurize_static": (
        featurize_static,
        f"with {FRAMES}, {C} select clip_id, f::int as frame_idx, dim::int as dim, round(v, 5) {Z} as v from stat",
    ),
    "resample_linear": (
        resample_linear,
        f"with {FRAMES}, {C}, {resampled()} select clip_id, step::int as step, dim::int as dim, round(v, 5) {Z} as v from rsm",
    ),
    "velocity": (
        velocity,
        f"with {FRAMES}, {C}, {resampled()}, {VELOCITY} select clip_id, step::int as step, (dim-228)::int as dim, round(v, 5) {Z} as v from win where dim >= 228",
    ),
    "feature_ablation": (
        feature_ablation,
        f"""with {FRAMES}, {C}, {resampled()}, {VELOCITY} select clip_id, step::int as step, dim::int as dim,
            round(case when dim between 102 and 141 or dim between 184 and 225 or dim >= 228 then 0 else v end, 5) {Z} as v from win""",
    ),
    "motion_energy": (
        motion_energy,
        f"""with {FRAMES}, {C}, w as (select clip_id, f, p, gx, gy from nrm where p in (5, 6)),
            d as (select clip_id, f, p, coalesce(sqrt(power(gx-lag(gx) over q,2)+power(gy-lag(gy) over q,2))*25, 0) as s from w window q as (partition by clip_id, p order by f)),
            m as (select clip_id, f, avg(s) as s from d group by all)
            select clip_id, f::int as frame_idx, round(sum(s) over (partition by clip_id order by f rows between 1 preceding and 1 following)/3, 5) as energy from m""",
    ),
}

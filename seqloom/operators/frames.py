"""Landmark frames to fixed-length feature windows.

All per-clip steps partition by clip_id, so one shuffle serves the whole chain;
a window partition is one recording. Coordinates are flat arrays x0,y0,x1,y1,...; the
vector maths is written as array constructors, which Spark compiles, instead of
interpreted lambdas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions import layout as L
from seqloom.operators.scoring import mean_vector


def _array(items) -> str:
    return "array(" + ",".join(items) + ")"


def project_keypoints(detections: DataFrame, pose: str, face: str, width: int, height: int) -> DataFrame:
    """Keeps the 9 pose and 20 face points and puts x into height units.

    An index past the end of the detection gives (0, 0).
    """
    ratio = f"{float(width)!r}D/{float(height)!r}D" if width != height else "1.0D"

    def pick(col: str, idx: list[int]) -> str:
        xy = []
        for i in idx:
            xy.append(f"coalesce(get({col}, {2 * i}) * ({ratio}), 0.0D)")
            xy.append(f"coalesce(get({col}, {2 * i + 1}), 0.0D)")
        return _array(xy)

    return detections.withColumn("pose", F.expr(pick(pose, L.POSE_IDX))).withColumn("face", F.expr(pick(face, L.FACE_IDX)))


def correct_aspect(frames: DataFrame, width: int, height: int, blocks: tuple[str, ...] = ("pose", "lhand", "rhand", "face")) -> DataFrame:
    """x of all landmark blocks in height units, so that distances in wide and tall frames compare."""
    if width == height:
        return frames
    ratio = f"{float(width)!r}D/{float(height)!r}D"
    return frames.withColumns({b: F.expr(f"transform({b}, (v, i) -> if(i % 2 = 0, v * ({ratio}), v))") for b in blocks})


def forward_fill_pose(frames: DataFrame, leading: str = "keep") -> DataFrame:
    """Adds ``pose_f``: the last detected pose; a leading gap stays raw unless
    ``leading='backfill'``."""
    past = W.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, 0)
    seen = F.when(F.col("pose_ok"), F.col("pose"))
    fill = [F.last(seen, ignorenulls=True).over(past)]
    if leading == "backfill":
        future = W.partitionBy("clip_id").orderBy("frame_idx").rowsBetween(0, W.unboundedFollowing)
        fill.append(F.first(seen, ignorenulls=True).over(future))
    return frames.withColumn("pose_f", F.coalesce(*fill, F.col("pose")))


def body_frame(frames: DataFrame, scale_min: float = L.SCALE_MIN) -> DataFrame:
    """Adds the body axes cx, cy, scale, cos_a, sin_a from ``pose_f``.

    Scale is the shoulder width, else 0.9 x torso, else the clip's median good
    scale, else a constant.
    """

    def xy(p: int) -> tuple[str, str]:
        return f"pose_f[{2 * p}]", f"pose_f[{2 * p + 1}]"

    (lx, ly), (rx, ry) = xy(L.L_SHOULDER), xy(L.R_SHOULDER)
    (hx, hy), (kx, ky) = xy(L.L_HIP), xy(L.R_HIP)
    f = frames.selectExpr("*", f"({lx}+{rx})/2 as cx", f"({ly}+{ry})/2 as cy", f"{lx}-{rx} as _dx", f"{ly}-{ry} as _dy")
    f = f.selectExpr("*", "sqrt(_dx*_dx+_dy*_dy) as _sh", f"sqrt(power(cx-({hx}+{kx})/2,2)+power(cy-({hy}+{ky})/2,2)) as _torso")
    f = f.selectExpr("*", f"if(_sh < {scale_min}D, _torso*{L.TORSO_RATIO}D, _sh) as _s", f"if(_sh < {scale_min}D, 0.0D, atan2(_dy,_dx)) as _ang")
    good = F.when(F.col("_s") >= scale_min, F.col("_s"))
    med = F.median(good).over(W.partitionBy("clip_id"))
    scale = F.when(F.col("_s") >= scale_min, F.col("_s")).otherwise(F.coalesce(med, F.lit(L.SCALE_DEFAULT)))
    return f.select("*", scale.alias("scale"), F.cos("_ang").alias("cos_a"), F.sin("_ang").alias("sin_a")).drop("_dx", "_dy", "_sh", "_torso", "_s", "_ang")


def hand_shape(frames: DataFrame, hand_min: float = L.HAND_MIN_SPAN) -> DataFrame:
    """Adds per hand the RMS span, the updated flag (0 for a degenerate hand)."""
    for side in ("l", "r"):
        h = f"{side}hand"
        sq = "+".join(f"({h}[{j}]-{h}[{j % 2}])*({h}[{j}]-{h}[{j % 2}])" for j in range(2, 2 * L.N_HAND))
        frames = frames.withColumn(f"_{side}span", F.expr(f"sqrt(({sq})/{L.N_HAND})"))
        frames = frames.withColumn(f"{side}flag", F.expr(f"if({h}_ok and _{side}span >= {hand_min}D, 1.0D, 0.0D)"))
        frames = frames.withColumn(f"{side}span", F.expr(f"if(_{side}span < {hand_min}D, 1.0D, _{side}span)")).drop(f"_{side}span")
    return frames


def _global_sql(col: str, n: int, flag: str | None = None) -> list[str]:
    out = []
    tail = f" * {flag}" if flag else ""
    for i in range(n):
        x, y = f"({col}[{2 * i}]-cx)", f"({col}[{2 * i + 1}]-cy)"
        out.append(f"({x}*cos_a+{y}*sin_a)/(scale+{L.EPS}D){tail}")
        out.append(f"({y}*cos_a-{x}*sin_a)/(scale+{L.EPS}D){tail}")
    return out


def _local_sql(side: str) -> list[str]:
    h = f"{side}hand"
    return [f"({h}[{2 * i + a}]-{h}[{a}])/({side}span+{L.EPS}D) * {side}flag" for i in range(L.N_HAND) for a in (0, 1)]


def static_features(frames: DataFrame, hand_min: float = L.HAND_MIN_SPAN, scale_min: float = L.SCALE_MIN, leading: str = "keep") -> DataFrame:
    """Adds ``static``: 142 body-normalised, 84 hand-local values and 2 flags."""
    f = hand_shape(body_frame(forward_fill_pose(frames, leading), scale_min), hand_min)
    vals = (
        _global_sql("pose_f", L.N_POSE)
        + _global_sql("lhand", L.N_HAND, "lflag")
        + _global_sql("rhand", L.N_HAND, "rflag")
        + _global_sql("face", L.N_FACE)
        + _local_sql("l")
        + _local_sql("r")
    )

    def clamp(v: str) -> str:
        return f"greatest(-{L.CLAMP}D, least({L.CLAMP}D, {v}))"

    # The lambda over the two flags keeps this projection out of the fused stage,
    # whose single method would exceed the JVM's size limit; Spark then compiles
    # the wide array in pieces.
    static = f"concat({_array(map(clamp, vals))}, transform(array(lflag, rflag), v -> {clamp('v')}))"
    keep = [c for c in frames.columns if c not in ("pose", "pose_f", "pose_vis", "lhand", "rhand", "face", "lhand_ok", "rhand_ok", "pose_ok")]
    return f.selectExpr(*keep, f"{static} as static")


def resample(static: DataFrame, n_out: int = L.SEQ_LEN, carry: tuple[str, ...] = ()) -> DataFrame:
    """Linear interpolation of each clip's ``static`` onto ``n_out`` steps.

    Every frame emits the steps that fall between it and its successor, so no
    join and no per-clip array is needed.
    """
    order = W.partitionBy("clip_id").orderBy("frame_idx")
    whole = W.partitionBy("clip_id")
    steps = F.expr(
        f"""case when _t = 1 then sequence(0, {n_out - 1})
                 else filter(sequence(cast(floor(_i*{n_out - 1}/(_t-1)) as int), cast(least({n_out - 1}, ceil((_i+1)*{n_out - 1}/(_t-1))) as int)),
                             k -> (k*(_t-1)) div {n_out - 1} = _i) end"""
    )
    f = static.select(
        "clip_id",
        *carry,
        "static",
        (F.row_number().over(order) - 1).alias("_i"),
        F.count("*").over(whole).alias("_t"),
        F.lead("static").over(order).alias("_next"),
    )
    f = f.withColumn("step", F.explode(steps))
    f = f.withColumn("_w", F.expr(f"if(_t = 1, 0.0D, step*(_t-1)/{n_out - 1} - _i)"))
    lerp = "if(_next is null or _w = 0, static, zip_with(static, _next, (a, b) -> a + _w*(b-a)))"
    return f.selectExpr("clip_id", *carry, "step", f"{lerp} as static")


def add_velocity(steps: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Appends the step-to-step change of the 142 global values; step 0 gets 0."""
    order = W.partitionBy("clip_id").orderBy("step")
    prev = steps.withColumn("_prev", F.coalesce(F.lag("static").over(order), F.col("static")))
    n = L.DIM_GLOBAL
    vel = f"zip_with(slice(static, 1, {n}), slice(_prev, 1, {n}), (a, b) -> a - b)"
    return prev.selectExpr("clip_id", *carry, "step", f"concat(static, {vel}) as window")


def build_window(
    frames: DataFrame,
    n_out: int = L.SEQ_LEN,
    hand_min: float = L.HAND_MIN_SPAN,
    scale_min: float = L.SCALE_MIN,
    leading: str = "keep",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Raw frames to (clip_id, step, window of 370 values)."""
    s = static_features(frames, hand_min, scale_min, leading)
    return add_velocity(resample(s, n_out, carry=carry), carry)


def window_mean(windows: DataFrame, dims: int = L.DIM_GLOBAL, carry: tuple[str, ...] = ()) -> DataFrame:
    """One vector per clip: the mean over the steps of the first ``dims`` values."""
    return windows.groupBy("clip_id", *carry).agg(mean_vector(F.slice("window", 1, dims)).alias("vec"))


def pad_empty_clips(windows: DataFrame, clips: DataFrame, n_out: int = L.SEQ_LEN, width: int = L.DIM_WINDOW) -> DataFrame:
    """Zero windows for clips that have no frame at all."""
    missing = clips.select("clip_id").join(windows.select("clip_id").distinct(), "clip_id", "left_anti")
    zeros = missing.select("clip_id", F.explode(F.sequence(F.lit(0), F.lit(n_out - 1))).alias("step"), F.array_repeat(F.lit(0.0), width).alias("window"))
    return windows.unionByName(zeros)


def mask_blocks(windows: DataFrame, blocks: list[str], col: str = "window", width: int = L.DIM_WINDOW) -> DataFrame:
    """Zeroes the named feature blocks (see layout.BLOCKS)."""
    off = {j for b in blocks for j in range(*L.BLOCKS[b])}
    return windows.withColumn(col, F.expr(_array("0.0D" if j in off else f"{col}[{j}]" for j in range(width))))


def motion_energy(frames: DataFrame, scale_min: float = L.SCALE_MIN, leading: str = "keep", box: int = 3) -> DataFrame:
    """Wrist speed in shoulder widths per second, box-filtered with zero padding."""
    f = body_frame(forward_fill_pose(frames, leading), scale_min)
    order = W.partitionBy("clip_id").orderBy("frame_idx")
    pts = []
    for p in (L.L_WRIST, L.R_WRIST):
        x, y = f"(pose_f[{2 * p}]-cx)", f"(pose_f[{2 * p + 1}]-cy)"
        pts += [f"({x}*cos_a+{y}*sin_a)/(scale+{L.EPS}D)", f"({y}*cos_a-{x}*sin_a)/(scale+{L.EPS}D)"]
    f = f.selectExpr("clip_id", "frame_idx", "fps", f"{_array(pts)} as _w").withColumn("_p", F.lag("_w").over(order))
    step = "(sqrt(power(_w[0]-_p[0],2)+power(_w[1]-_p[1],2))+sqrt(power(_w[2]-_p[2],2)+power(_w[3]-_p[3],2)))/2*fps"
    f = f.withColumn("_d", F.expr(f"coalesce({step}, 0.0D)"))
    half = box // 2
    energy = F.sum("_d").over(order.rowsBetween(-half, box - 1 - half)) / F.lit(float(box)) if box > 1 else F.col("_d")
    return f.select("clip_id", "frame_idx", energy.alias("energy"))


def slice_clip(frames: DataFrame, start: int, stop: int) -> DataFrame:
    return frames.filter(F.col("frame_idx").between(start, stop - 1))


def long_rows(df: DataFrame, keys: list[str], col: str, digits: int = 5) -> DataFrame:
    """One row per array element: keys, dim, v.

    The outer form keeps Spark from inferring a size(col) > 0 filter, which it
    would push down by copying the whole array expression.
    """
    return df.select(*keys, F.posexplode_outer(col).alias("dim", "v")).select(*keys, "dim", (F.round("v", digits) + 0.0).alias("v"))

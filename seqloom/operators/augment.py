"""Training-set expansion with hash-derived draws (see functions.rand)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from seqloom.functions import layout as L
from seqloom.functions.rand import gauss_draws, hash_hex, seed31, uniform
from seqloom.operators import frames as O
from seqloom.operators.ranking import hash_cuts


def _draw(tag: str, seed: int) -> Column:
    return uniform(F.col("clip_id"), f"{tag}{seed}")


def mirror(frames: DataFrame, p: float, seed: int = 42, width: float = 1.0) -> DataFrame:
    """Mirrors a share p of the clips: x becomes width - x (0 stays: missing),
    hands, flags and paired points swap sides."""

    def flip(col: str, perm: list[int]) -> Column:
        xs = []
        for q in perm:
            xs.append(f"if({col}[{2 * q}] <> 0, {width}D - {col}[{2 * q}], 0.0D)")
            xs.append(f"{col}[{2 * q + 1}]")
        return F.expr("array(" + ",".join(xs) + ")")

    hand = list(range(L.N_HAND))
    new = {
        "pose": flip("pose", L.POSE_MIRROR),
        "face": flip("face", L.FACE_MIRROR),
        "lhand": flip("rhand", hand),
        "rhand": flip("lhand", hand),
        "lhand_ok": F.col("rhand_ok"),
        "rhand_ok": F.col("lhand_ok"),
    }
    if "pose_vis" in frames.columns:
        new["pose_vis"] = F.expr("array(" + ",".join(f"pose_vis[{q}]" for q in L.POSE_MIRROR) + ")")
    f = frames.withColumn("_m", _draw("mirror", seed) < p)
    return f.withColumns({c: F.when(F.col("_m"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_m")


def temporal_crop(frames: DataFrame, seed: int = 42, rules: L.AugmentRules = L.AugmentRules()) -> DataFrame:
    """Cuts frames at both ends (more at the front) and renumbers the rest."""
    t = F.count("*").over(W.partitionBy("clip_id"))
    f = frames.withColumn("_t", t)
    lo = F.floor(F.col("_t") * (1.0 - rules.warp) * _draw("crop_lo", seed) * 0.5)
    f = f.withColumn("_lo", F.when(F.col("_t") < 8, 0).otherwise(lo))
    hi = F.col("_t") - F.floor(F.col("_t") * rules.warp * _draw("crop_hi", seed) * 0.5)
    f = f.withColumn("_hi", F.when(F.col("_t") < 8, F.col("_t")).otherwise(F.greatest(F.col("_lo") + 6, F.least(hi, F.col("_t")))))
    kept = f.filter((F.col("frame_idx") >= F.col("_lo")) & (F.col("frame_idx") < F.col("_hi")))
    return kept.withColumn("frame_idx", (F.col("frame_idx") - F.col("_lo")).cast("int")).drop("_t", "_lo", "_hi")


def hand_dropout(frames: DataFrame, seed: int = 42, rules: L.AugmentRules = L.AugmentRules()) -> DataFrame:
    """Loses a whole hand in some clips and single hand frames in others."""
    frame_key = F.concat("clip_id", F.lit("#"), F.col("frame_idx").cast("string"))
    some = _draw("drop_some", seed) < rules.drop_some
    cols = {}
    for side in ("l", "r"):
        whole = _draw(f"drop_{side}", seed) < rules.drop_hand
        single = some & (uniform(frame_key, f"drop_{side}{seed}") <= rules.drop_frame)
        cols[f"{side}hand_ok"] = F.col(f"{side}hand_ok") & ~whole & ~single
    return frames.withColumns(cols)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def jitter(static: pd.Series, step: pd.Series, seed: pd.Series, cos: pd.Series, sin: pd.Series, dx: pd.Series, dy: pd.Series, std: pd.Series) -> pd.Series:
    """Turns, scales and shifts the points of each row and adds keyed normal noise.

    Arrow batches: one row needs some thousand arithmetic steps, which numpy
    does about a hundred times faster than nested SQL lambdas.
    """
    if not len(static):
        return static
    x = np.stack(static.to_numpy())
    c, s = cos.to_numpy()[:, None], sin.to_numpy()[:, None]
    pts = x[:, : L.DIM_GLOBAL + L.DIM_LOCAL]
    px, py = pts[:, 0::2].copy(), pts[:, 1::2].copy()
    pts[:, 0::2], pts[:, 1::2] = px * c - py * s, px * s + py * c
    pts[:, : L.DIM_GLOBAL : 2] += dx.to_numpy()[:, None]
    pts[:, 1 : L.DIM_GLOBAL : 2] += dy.to_numpy()[:, None]
    at = step.to_numpy().astype(np.int64)[:, None] * L.DIM_STATIC + np.arange(L.DIM_STATIC)
    x += std.to_numpy()[:, None] * gauss_draws(seed.to_numpy()[:, None], at)
    return pd.Series(list(x))


def spatial_jitter(steps: DataFrame, seed: int = 42, rules: L.AugmentRules = L.AugmentRules()) -> DataFrame:
    """Rotates, scales and shifts the resampled static features and adds noise.

    Hand-local coordinates are not shifted; noise goes on every value.
    """

    def span(tag: str, half: float) -> Column:
        return (_draw(tag, seed) * 2 - 1) * half

    turn, size = F.radians(span("rot", rules.rotate_deg)), span("scale", rules.scale) + 1
    moved = jitter(
        "static", "step", seed31(F.col("clip_id"), f"noise{seed}"), F.cos(turn) * size, F.sin(turn) * size,
        span("shift_x", rules.shift), span("shift_y", rules.shift), F.lit(rules.noise),
    )
    return steps.withColumn("static", moved)


def synthetic_negatives(frames: DataFrame, ratio: float, seed: int = 42, hand_min: float = L.HAND_MIN_SPAN, scale_min: float = L.SCALE_MIN, rules: L.AugmentRules = L.AugmentRules()) -> DataFrame:
    """Static steps of a resting signer from the start or end of hash-chosen clips.

    floor(n * ratio) samples: the first frame of a short edge slice, held for the
    whole window with slight noise. Above a ratio of 1 every clip gives floor(ratio)
    samples, each with draws of its own, and hash-chosen clips one more.
    """
    whole = int(ratio)
    parts = [_negatives(frames, None, seed, i, hand_min, scale_min, rules) for i in range(whole)]
    if ratio > whole or not whole:
        parts.append(_negatives(frames, ratio - whole, seed, whole, hand_min, scale_min, rules))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _negatives(frames: DataFrame, share: float | None, seed: int, sample: int, hand_min: float, scale_min: float, rules: L.AugmentRules) -> DataFrame:
    """One sample of each clip, or of a share of them."""
    seed = seed + 1000 * sample
    tag = f"negative{seed}"
    f = frames
    if share is not None:
        cuts = hash_cuts(frames.select("clip_id").distinct(), "clip_id", tag, [(share, 0)])
        f = f.filter(hash_hex(F.col("clip_id"), tag) <= cuts.getField("c0"))
    f = f.withColumn("_t", F.count("*").over(W.partitionBy("clip_id")))
    f = f.withColumn("_k", F.greatest(F.lit(2), F.expr("cast(_t div 8 as int)")))
    head = _draw("edge", seed) < 0.5
    f = f.withColumn("_a", F.when(head, 0).otherwise(F.greatest(F.lit(0), F.col("_t") - F.col("_k"))))
    f = f.filter((F.col("frame_idx") >= F.col("_a")) & (F.col("frame_idx") < F.col("_a") + F.col("_k")))
    s = O.static_features(f.drop("_k"), hand_min, scale_min).filter("frame_idx = _a")
    s = s.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(L.SEQ_LEN - 1))))
    one, zero = F.lit(1.0), F.lit(0.0)
    shaky = jitter("static", "step", seed31(F.col("clip_id"), f"rest{seed}"), one, zero, zero, zero, F.lit(rules.rest_noise))
    out = F.when(F.col("_t") < 4, F.array_repeat(zero, L.DIM_STATIC)).otherwise(shaky)
    return s.select(F.concat(F.lit(f"neg{sample or ''}:"), "clip_id").alias("clip_id"), "step", out.alias("static"))


def training_set(frames: DataFrame, labels: DataFrame, nosign_ratio: float = 0.12, mirror_p: float = 0.0, seed: int = 42, hand_min: float = L.HAND_MIN_SPAN, scale_min: float = L.SCALE_MIN) -> DataFrame:
    """Augmented windows of the training clips plus synthetic negatives.

    ``labels`` has clip_id and label of the training clips.
    """
    f = frames.join(labels.select("clip_id"), "clip_id", "left_semi")
    a = hand_dropout(temporal_crop(mirror(f, mirror_p, seed), seed), seed)
    real = spatial_jitter(O.resample(O.static_features(a, hand_min, scale_min)), seed)
    windows = O.add_velocity(real).join(labels.select("clip_id", "label"), "clip_id")
    neg = O.add_velocity(synthetic_negatives(f, nosign_ratio, seed, hand_min, scale_min)).withColumn("label", F.lit(L.NOSIGN))
    return windows.unionByName(neg)

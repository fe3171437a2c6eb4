"""A made-up signer: landmark frames with hands of a real shape."""

import numpy as np
from pyspark.sql import types as T


def open_hand() -> np.ndarray:
    """21 points relative to the wrist: five fingers of four joints, fanned out over 100 degrees."""
    points = [(0.0, 0.0)]
    for finger in range(5):
        angle = np.radians(40 + 25 * finger)
        reach = 0.045 + 0.012 * min(finger, 4 - finger)
        points += [(reach * step * np.cos(angle) / 2, -reach * step * np.sin(angle) / 2) for step in (1, 2, 3, 4)]
    return np.array(points)


HAND = open_hand()
#: Nose, shoulders, elbows, wrists, hips of someone who faces the camera; left first.
BODY = np.array([[0.51, 0.17], [0.64, 0.33], [0.37, 0.34], [0.71, 0.47], [0.30, 0.49], [0.69, 0.60], [0.33, 0.63], [0.57, 0.75], [0.44, 0.74]])

FRAME_SCHEMA = T.StructType(
    [T.StructField("clip_id", T.StringType()), T.StructField("frame_idx", T.IntegerType()), T.StructField("fps", T.DoubleType())]
    + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("pose", "pose_vis", "lhand", "rhand", "face")]
    + [T.StructField(c, T.BooleanType()) for c in ("pose_ok", "lhand_ok", "rhand_ok")]
)


def person(n=40, fps=25.0, moving=True):
    """Dict of arrays: pose (n,9,2), hands (n,21,2), face (n,20,2), flags (n,)."""
    turn = np.linspace(0, 3 * np.pi, n)
    size = 0.06 if moving else 0.0
    swing = size * np.stack([np.sin(turn), 0.5 * (1 - np.cos(turn))], axis=1)  # wrists draw arcs, mirror-wise
    pose = np.tile(BODY, (n, 1, 1))
    pose[:, 5] += swing
    pose[:, 6] += swing * [-1, 1]
    spread = (0.9 + 0.15 * np.cos(turn))[:, None, None]
    left = pose[:, 5:6] + HAND * spread
    right = pose[:, 6:7] + HAND * [-1, 1] * spread
    return dict(
        fps=fps, pose=pose, lhand=left, rhand=right, face=np.tile(BODY[0], (n, 20, 1)), vis=np.full((n, 9), 0.9),
        pose_ok=np.ones(n, bool), lhand_ok=np.ones(n, bool), rhand_ok=np.ones(n, bool),
    )


def frames(spark, clips: dict):
    rows = []
    for cid, p in clips.items():
        for i in range(len(p["pose"])):
            flat = {k: p[k][i].ravel().tolist() for k in ("pose", "lhand", "rhand", "face")}
            rows.append(
                (cid, i, p["fps"], flat["pose"], p["vis"][i].tolist(), flat["lhand"], flat["rhand"], flat["face"], bool(p["pose_ok"][i]), bool(p["lhand_ok"][i]), bool(p["rhand_ok"][i]))
            )
    return spark.createDataFrame(rows, FRAME_SCHEMA)


def windows(df) -> dict:
    """clip_id -> (steps, width) array of collected windows."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["clip_id"], r["step"])):
        out.setdefault(r["clip_id"], []).append(r["window"])
    return {k: np.array(v) for k, v in out.items()}

"""Landmark layout and the thresholds shared by batch and streaming jobs."""

from __future__ import annotations

from dataclasses import dataclass

# Which detector points are kept, in stored order.
POSE_IDX = [0, 11, 12, 13, 14, 15, 16, 23, 24]
FACE_IDX = [
    61, 291, 0, 17, 13, 14, 78, 308, 40, 270,
    33, 133, 362, 263, 159, 145, 386, 374,
    70, 300,
]
N_POSE_RAW = 33
N_FACE_RAW = 468

N_POSE = 9
N_HAND = 21
N_FACE = 20

# Positions inside the kept pose points.
L_SHOULDER, R_SHOULDER = 1, 2
L_WRIST, R_WRIST = 5, 6
L_HIP, R_HIP = 7, 8

# left/right partners under mirroring, in stored order.
POSE_MIRROR = [0, 2, 1, 4, 3, 6, 5, 8, 7]
FACE_MIRROR = [1, 0, 2, 3, 4, 5, 7, 6, 9, 8, 13, 12, 11, 10, 16, 17, 14, 15, 19, 18]

DIM_GLOBAL = 2 * (N_POSE + 2 * N_HAND + N_FACE)
DIM_LOCAL = 2 * 2 * N_HAND
DIM_STATIC = DIM_GLOBAL + DIM_LOCAL + 2
DIM_WINDOW = DIM_STATIC + DIM_GLOBAL
SEQ_LEN = 48
NOSIGN = "__NOSIGN__"

HAND_MIN_SPAN = 0.012
SCALE_MIN = 1e-3
SCALE_DEFAULT = 0.25
TORSO_RATIO = 0.9
EPS = 1e-6
CLAMP = 8.0

# First dimension of each block in the static vector (pose starts at 0).
BLOCKS = {
    "pose": (0, 18),
    "lhand": (18, 60),
    "rhand": (60, 102),
    "face": (102, 142),
    "local_l": (142, 184),
    "local_r": (184, 226),
    "flags": (226, 228),
    "velocity": (228, 370),
}


@dataclass(frozen=True)
class SegmentRules:
    """Thresholds of the sign segmenter; energies are shoulder widths per second."""

    hi: float = 0.55
    lo: float = 0.22
    quiet: int = 6
    min_len: int = 10
    max_len: int = 90
    cooldown: int = 8
    pre_roll: int = 8
    spare: int = 20  # the frame buffer keeps max_len + spare frames

    @property
    def buffer(self) -> int:
        return self.max_len + self.spare


@dataclass(frozen=True)
class GateRules:
    conf: float = 0.60
    margin: float = 0.15


@dataclass(frozen=True)
class AugmentRules:
    rotate_deg: float = 10.0
    scale: float = 0.12
    shift: float = 0.06
    warp: float = 0.15
    drop_hand: float = 0.08
    drop_some: float = 0.3
    drop_frame: float = 0.05
    noise: float = 0.008
    rest_noise: float = 0.004

"""Motion energy, sign segmentation and emissions over live streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import layout as L
from seqloom.operators.ordered_scan import ordered_scan

EVENTS = ["idle", "start", "active", "end", "discard", "cooldown"]


class SegmentScan:
    """The segmenter as a finite automaton.

    A row is one of four symbols (trigger x quiet); a state is idle, active
    (frames so far, quiet frames so far) or cooling down. Composing transition
    tables gives the effect of a whole partition on any entry state.
    """

    columns = ["energy", "hands"]
    outputs = [("event", T.StringType()), ("seg_len", T.IntegerType()), ("frame_no", T.LongType())]

    def __init__(self, rules: L.SegmentRules = L.SegmentRules()):
        self.rules = r = rules
        self.cool = max(1, r.cooldown)
        codes: dict[tuple, int] = {("idle",): 0}
        for left in range(1, self.cool + 1):
            codes[("cool", left)] = len(codes)
        for n in range(1, max(2, r.max_len)):
            for q in range(0, max(1, r.quiet)):
                codes[("act", n, q)] = len(codes)
        size = len(codes)
        self.next = np.zeros((4, size), np.int16)
        self.event = np.zeros((4, size), np.int8)
        self.length = np.zeros((4, size), np.int32)
        self.frames = np.zeros(size, np.int32)  # of an open segment
        for state, code in codes.items():
            self.frames[code] = state[1] if state[0] == "act" else 0
            for sym in range(4):
                new, event, length = self._step(state, bool(sym & 2), bool(sym & 1))
                self.next[sym, code] = codes[new]
                self.event[sym, code] = EVENTS.index(event)
                self.length[sym, code] = length

    def _step(self, state: tuple, trigger: bool, quiet: bool) -> tuple[tuple, str, int]:
        r = self.rules
        if state[0] == "cool":
            left = state[1] - 1
            return (("cool", left) if left > 0 else ("idle",)), "cooldown", 0
        if state[0] == "idle":
            return (("act", 1, 0), "start", 0) if trigger else (("idle",), "idle", 0)
        n, q = state[1] + 1, state[2] + 1 if quiet else 0
        if q >= r.quiet or n >= r.max_len:
            return ("cool", self.cool), ("end" if n >= r.min_len else "discard"), n
        return ("act", n, q), "active", 0

    def symbols(self, rows) -> np.ndarray:
        energy, hands = rows["energy"].astype(float), rows["hands"].astype(bool)
        return ((energy > self.rules.hi) & hands) * 2 + ((energy < self.rules.lo) | ~hands)

    def start(self):
        return (0, 0)

    def run(self, state, rows):
        seen, code = state
        syms = self.symbols(rows)
        step = self.next.tolist()
        codes = np.empty(len(syms), np.int16)
        for i, s in enumerate(syms.tolist()):
            codes[i] = code
            code = step[s][code]
        names = np.array(EVENTS, dtype=object)
        out = {
            "event": names[self.event[syms, codes]],
            "seg_len": self.length[syms, codes],
            "frame_no": np.arange(seen, seen + len(syms), dtype=np.int64),
        }
        return (seen + len(syms), code), out

    def identity(self):
        every = np.arange(self.next.shape[1], dtype=np.int16)
        return (0, every, every)

    def fold(self, summary, rows):
        n, to, states = summary  # entry state e now stands at states[to[e]]
        syms = self.symbols(rows).tolist()
        for i, s in enumerate(syms):
            states = self.next[s][states]
            if i % 16 == 15 and len(states) > 1:  # different entry states soon meet
                states, back = np.unique(states, return_inverse=True)
                to = back.astype(np.int16)[to]
        return (n + len(syms), to, states)

    def resume(self, summary, state):
        n, to, states = summary
        return (state[0] + n, int(states[to[state[1]]]))


class EnergyScan:
    """Smoothed wrist speed of a live stream.

    State is the running mean and the wrists of the last good frame. A summary
    keeps the mean as a*mean + b + c*v, with v the first good frame's speed,
    which needs the wrists of an earlier partition.
    """

    columns = ["good", "w0", "w1", "w2", "w3", "vis_l", "vis_r", "dt"]
    outputs = [("energy", T.DoubleType())]

    def start(self):
        return (0.0, None)

    @staticmethod
    def _speed(prev, cur, dt) -> float:
        if prev is None or dt <= 1e-4:
            return 0.0
        steps = [np.hypot(cur[0] - prev[0], cur[1] - prev[1]), np.hypot(cur[2] - prev[2], cur[3] - prev[3])]
        both = [s for s, a, b in zip(steps, cur[4:], prev[4:]) if a and b]
        return float(sum(both) / len(both) / dt) if both else 0.0

    def _speeds(self, rows):
        """Speed of each good row against the good row before it, in this piece."""
        good = np.flatnonzero(rows["good"].astype(bool))
        w = np.stack([rows[c].astype(float) for c in ("w0", "w1", "w2", "w3")], axis=1)[good]
        vis = np.stack([rows[c].astype(bool) for c in ("vis_l", "vis_r")], axis=1)[good]
        dt = rows["dt"].astype(float)[good]
        d = np.zeros(len(good))
        if len(good) > 1:
            step = np.stack([np.hypot(w[1:, 0] - w[:-1, 0], w[1:, 1] - w[:-1, 1]), np.hypot(w[1:, 2] - w[:-1, 2], w[1:, 3] - w[:-1, 3])], axis=1)
            both = vis[1:] & vis[:-1]
            n = both.sum(axis=1)
            ok = (n > 0) & (dt[1:] > 1e-4)
            mean = np.where(both, step, 0.0).sum(axis=1) / np.maximum(n, 1)
            d[1:] = np.where(ok, mean / np.where(dt[1:] > 1e-4, dt[1:], 1.0), 0.0)
        firsts = ((*w[0].tolist(), *vis[0].tolist()), float(dt[0])) if len(good) else None
        lasts = (*w[-1].tolist(), *vis[-1].tolist()) if len(good) else None
        return good, d, firsts, lasts

    def run(self, state, rows):
        ema, prev = state
        good, d, first, last = self._speeds(rows)
        if first is not None:
            d[0] = self._speed(prev, first[0], first[1])
        v = np.full(len(rows["good"]), np.nan)
        v[good] = d
        out = np.empty(len(v))
        for i, x in enumerate(v.tolist()):
            ema = ema * 0.7 if x != x else 0.6 * ema + 0.4 * x
            out[i] = ema
        return (ema, last if last is not None else prev), {"energy": out}

    def identity(self):
        return (1.0, 0.0, 0.0, None, None)

    def fold(self, summary, rows):
        a, b, c, head, tail = summary
        good, d, first, last = self._speeds(rows)
        v = np.full(len(rows["good"]), np.nan)
        v[good] = d
        start = None
        if first is not None:
            if head is None:
                start, head = int(good[0]), first
            else:
                v[good[0]] = self._speed(tail, first[0], first[1])
        for i, x in enumerate(v.tolist()):
            if x != x:
                a, b, c = a * 0.7, b * 0.7, c * 0.7
            elif i == start:
                a, b, c = a * 0.6, b * 0.6, 0.4
            else:
                a, b, c = a * 0.6, b * 0.6 + 0.4 * x, c * 0.6
        return (a, b, c, head, last if last is not None else tail)

    def resume(self, summary, state):
        a, b, c, head, tail = summary
        ema, prev = state
        v = self._speed(prev, head[0], head[1]) if head is not None else 0.0
        return (a * ema + b + c * v, tail if tail is not None else prev)


class RateScan:
    """Frame-rate meter: 0.9/0.1 running mean of 1/dt, seeded by its first value."""

    columns = ["us"]
    outputs = [("rate", T.DoubleType())]

    def start(self):
        return (0.0, None)

    @staticmethod
    def _rates(us: np.ndarray) -> np.ndarray:
        return 1.0 / np.maximum((us[1:] - us[:-1]) / 1e6, 1e-4)

    @staticmethod
    def _mix(e: float, x: float) -> float:
        return 0.9 * e + 0.1 * x if e else x

    def run(self, state, rows):
        e, last = state
        us = rows["us"].astype(np.int64)
        known = us if last is None else np.concatenate([[last], us])
        out = np.full(len(us), np.nan)
        at = len(us) - (len(known) - 1)
        for i, x in enumerate(self._rates(known).tolist(), at):
            e = self._mix(e, x)
            out[i] = e
        return (e, int(us[-1])), {"rate": out}

    def identity(self):
        return (None, None, None, 1.0, 0.0)  # first us, last us, first inner rate, a, b

    def fold(self, summary, rows):
        first, last, x1, a, b = summary
        us = rows["us"].astype(np.int64)
        known = us if last is None else np.concatenate([[last], us])
        for x in self._rates(known).tolist():
            if x1 is None:
                x1 = x
            else:
                a, b = a * 0.9, b * 0.9 + 0.1 * x
        return (int(us[0]) if first is None else first, int(us[-1]), x1, a, b)

    def resume(self, summary, state):
        first, last, x1, a, b = summary
        e, before = state
        if first is None:
            return state
        if before is not None:
            e = self._mix(e, float(self._rates(np.array([before, first]))[0]))
        if x1 is not None:
            e = a * self._mix(e, x1) + b
        return (e, last)


def wrist_columns(frames: DataFrame) -> DataFrame:
    """Adds the shoulder-relative wrists and flags EnergyScan reads."""

    def xy(p: int) -> tuple[str, str]:
        return f"pose[{2 * p}]", f"pose[{2 * p + 1}]"

    (lx, ly), (rx, ry) = xy(L.L_SHOULDER), xy(L.R_SHOULDER)
    f = frames.withColumn("_sh", F.expr(f"sqrt(({lx}-{rx})*({lx}-{rx})+({ly}-{ry})*({ly}-{ry}))"))
    cols = {"good": F.expr(f"pose_ok and _sh >= {L.SCALE_MIN}D")}
    for k, p in enumerate((L.L_WRIST, L.R_WRIST)):
        x, y = xy(p)
        cols[f"w{2 * k}"] = F.expr(f"({x}-({lx}+{rx})/2)/if(_sh > 0, _sh, 1.0D)")
        cols[f"w{2 * k + 1}"] = F.expr(f"({y}-({ly}+{ry})/2)/if(_sh > 0, _sh, 1.0D)")
    cols["vis_l"] = F.expr(f"pose_vis[{L.L_WRIST}] > 0.5D")
    cols["vis_r"] = F.expr(f"pose_vis[{L.R_WRIST}] > 0.5D")
    return f.withColumns(cols).drop("_sh")


def online_energy(frames: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """Live motion energy per frame; ``frames`` needs pose, pose_vis, pose_ok, dt."""
    f = wrist_columns(frames).select(key, *order, *[c for c in keep if c not in (key, *order)], *EnergyScan.columns)
    return ordered_scan(f, key, order, EnergyScan()).drop(*EnergyScan.columns)


def segment(frames: DataFrame, key: str, order: list[str], rules: L.SegmentRules = L.SegmentRules()) -> DataFrame:
    """Adds event, seg_len and frame_no to frames with energy and hands."""
    return ordered_scan(frames, key, order, SegmentScan(rules))


def segment_windows(segmented: DataFrame, key: str, end_id: str, rules: L.SegmentRules) -> DataFrame:
    """The frames each finished segment hands to the classifier.

    A segment takes its own frames plus a short lead, as far as the frame buffer
    reaches; frame numbers are listed and equi-joined, so no range join runs.
    """
    n = F.greatest(F.lit(1), F.least(F.col("frame_no") + 1, F.lit(rules.buffer), F.col("seg_len") + rules.pre_roll))
    ends = segmented.filter("event = 'end'").select(key, F.col(end_id).alias("seg_id"), F.col("frame_no").alias("_e"), n.alias("n"))
    want = ends.select(key, "seg_id", "n", F.posexplode(F.sequence(F.col("_e") - F.col("n") + 1, F.col("_e"))).alias("pos", "frame_no"))
    return want.join(segmented.drop("event", "seg_len"), [key, "frame_no"])


def rate_ema(frames: DataFrame, key: str, order: list[str], us: str) -> DataFrame:
    return ordered_scan(frames.withColumn("us", F.col(us)), key, order, RateScan()).drop("us")

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.operators import augment as A
from seqloom.operators import frames as O
from tests.people import BODY, FRAME_SCHEMA, frames, person, windows


@pytest.fixture(scope="module")
def wins(spark):
    clips = {"base": person()}
    small = person()
    for k in ("pose", "lhand", "rhand", "face"):
        small[k] = small[k] * 0.6 + 0.2
    clips["affine"] = small
    clips["fast"] = person(80, 50.0)
    gap = person()
    gap["pose_ok"][10:20] = False
    gap["pose"][10:20] = 0
    clips["gap"] = gap
    lead = person()
    lead["pose_ok"][:5] = False
    lead["pose"][:5] = 0
    clips["lead"] = lead
    nohand = person()
    nohand["lhand_ok"][:] = False
    clips["nohand"] = nohand
    flat = person()
    flat["lhand"][:] = [0.66, 0.62]
    clips["flat"] = flat
    clips["one"] = person(1)
    clips["two"] = person(2)
    noshoulder = person()
    noshoulder["pose"][7, 1] = noshoulder["pose"][7, 2]
    clips["noshoulder"] = noshoulder
    nobody = person()
    nobody["pose"][:] = 0.5
    clips["nobody"] = nobody
    return windows(O.build_window(frames(spark, clips).repartition(7)))


def test_shapes_and_constants(wins):
    assert L.DIM_GLOBAL == 142 and L.DIM_STATIC == 228 and L.DIM_WINDOW == 370
    for w in wins.values():
        assert w.shape == (48, 370) and np.isfinite(w).all()
        assert (w[0, 228:] == 0).all()
        assert np.allclose(np.diff(w[:, :142], axis=0), w[1:, 228:])


def test_invariant_to_place_and_size(wins):
    assert np.abs(wins["base"] - wins["affine"]).max() < 5e-3


def test_invariant_to_frame_rate(wins):
    assert np.abs(wins["base"] - wins["fast"]).max() < 0.05


def test_values_against_numpy(wins):
    p = person()
    ls, rs = p["pose"][:, 1], p["pose"][:, 2]
    c, v = (ls + rs) / 2, ls - rs
    s, a = np.hypot(*v.T), np.arctan2(v[:, 1], v[:, 0])
    allpts = np.concatenate([p["pose"], p["lhand"], p["rhand"], p["face"]], axis=1) - c[:, None]
    g = np.stack([allpts[..., 0] * np.cos(a)[:, None] + allpts[..., 1] * np.sin(a)[:, None], allpts[..., 1] * np.cos(a)[:, None] - allpts[..., 0] * np.sin(a)[:, None]], axis=-1)
    g = (g / (s[:, None, None] + 1e-6)).reshape(40, -1)
    want = np.stack([np.interp(np.linspace(0, 1, 48), np.linspace(0, 1, 40), g[:, j]) for j in range(142)], axis=1)
    assert np.abs(np.clip(want, -8, 8) - wins["base"][:, :142]).max() < 1e-9


def test_missing_hand(wins):
    w = wins["nohand"]
    assert (w[:, 226] == 0).all() and (w[:, 18:60] == 0).all() and (w[:, 142:184] == 0).all()
    assert (w[:, 227] == 1).all()


def test_degenerate_hand(wins):
    w = wins["flat"]
    assert (w[:, 226] == 0).all() and np.abs(w).max() < 8


def test_short_clips(wins):
    assert np.allclose(wins["one"], wins["one"][0])
    assert np.allclose(wins["two"][0, :228], wins["two"][:, :228][0]) and not np.isnan(wins["two"]).any()


def test_shoulder_fallbacks(spark):
    p = person(5)
    p["pose"][2, 1] = p["pose"][2, 2]  # shoulders coincide: 0.9 x torso
    q = person(5)
    q["pose"][3] = 0.5  # everything coincides: the clip's median good scale
    r = person(3)
    r["pose"][:] = 0.5  # no good scale at all: the constant
    b = O.body_frame(O.forward_fill_pose(frames(spark, {"p": p, "q": q, "r": r})))
    got = {(x["clip_id"], x["frame_idx"]): (x["scale"], x["sin_a"]) for x in b.collect()}
    torso = np.hypot(*(p["pose"][2, 1] - (p["pose"][2, 7] + p["pose"][2, 8]) / 2))
    assert got["p", 2][0] == pytest.approx(0.9 * torso) and got["p", 2][1] == 0
    shoulders = np.hypot(*(BODY[1] - BODY[2]))
    assert got["q", 3][0] == pytest.approx(shoulders)
    assert all(got["r", i][0] == 0.25 for i in range(3))


def test_leading_gap(spark):
    p = person(10)
    p["pose_ok"][:3] = False
    p["pose"][:3] = 0
    f = frames(spark, {"c": p})
    keep = {r["frame_idx"]: r["pose_f"] for r in O.forward_fill_pose(f).collect()}
    back = {r["frame_idx"]: r["pose_f"] for r in O.forward_fill_pose(f, "backfill").collect()}
    assert keep[0] == [0.0] * 18 and np.allclose(back[0], p["pose"][3].ravel()) and keep[5] == back[5]


def test_motion_energy(spark):
    e = O.motion_energy(frames(spark, {"m": person(), "s": person(moving=False), "two": person(2)}))
    mean = {r["clip_id"]: r["e"] for r in e.groupBy("clip_id").agg(F.avg("energy").alias("e")).collect()}
    assert mean["m"] > 3 * mean["s"] and mean["s"] < L.SegmentRules().hi
    assert e.filter("clip_id = 'two'").count() == 2


def test_empty_clip_and_blocks(spark):
    f = frames(spark, {"a": person(8)})
    w = O.pad_empty_clips(O.build_window(f), spark.createDataFrame([("a",), ("b",)], "clip_id string"))
    got = windows(w)
    assert (got["b"] == 0).all() and got["b"].shape == (48, 370)
    m = windows(O.mask_blocks(O.build_window(f), ["face", "velocity"]))["a"]
    assert (m[:, 102:142] == 0).all() and (m[:, 228:] == 0).all() and np.allclose(m[:, :102], got["a"][:, :102])


def test_mirror_twice_is_identity(spark):
    p = person(6)
    p["pose"][:, 3, 0] += 0.1  # an uneven signer
    f = frames(spark, {"a": p})
    m = A.mirror(f, 1.0)
    again = A.mirror(m, 1.0)
    a, b = (sorted(x.select("frame_idx", "pose", "lhand", "face").collect()) for x in (f, again))
    for x, y in zip(a, b):
        assert np.allclose(x["pose"], y["pose"]) and np.allclose(x["lhand"], y["lhand"]) and np.allclose(x["face"], y["face"])
    assert not np.allclose(sorted(m.select("frame_idx", "pose").collect())[0]["pose"], a[0]["pose"])


def test_crop_keeps_short_clips_and_bounds(spark):
    t = A.temporal_crop(frames(spark, {"short": person(7), **{f"c{i}": person(40) for i in range(12)}}))
    n = {r["clip_id"]: (r["n"], r["lo"]) for r in t.groupBy("clip_id").agg(F.count("*").alias("n"), F.min("frame_idx").alias("lo")).collect()}
    assert n["short"] == (7, 0)
    assert all(6 <= v[0] <= 40 and v[1] == 0 for v in n.values()) and len({v[0] for v in n.values()}) > 3


def test_training_set_is_reproducible(spark):
    f = frames(spark, {f"c{i}": person(20 + i) for i in range(10)})
    labels = spark.createDataFrame([(f"c{i}", f"L{i % 2}") for i in range(10)], "clip_id string, label string")
    a, b = (windows(A.training_set(x, labels, 0.2, 0.5)) for x in (f, f.repartition(5)))
    assert a.keys() == b.keys() and len(a) == 12
    for k in a:
        assert np.allclose(a[k], b[k])
    still = [v for k, v in a.items() if k.startswith("neg:")][0]
    assert np.abs(still[:, 228:]).max() < 0.05


def test_schema_of_frames():
    assert [f.name for f in FRAME_SCHEMA][:2] == ["clip_id", "frame_idx"]


def test_all_blocks_pass_through_a_landmark_table(spark, tmp_path):
    from seqloom.plans.registry import REGISTRY

    rows = [(i, 0, [float(j + i) for j in range(64)]) for i in (0, 1, 25)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = REGISTRY["frames_round_trip"][0](spark, str(tmp_path)).collect()
    assert len(out) == 3 * 142 and {(r.frame_idx, r.dim): r.v for r in out} == {(f, j): float(j % 64 + i) for f, (i, _, _) in enumerate(rows) for j in range(142)}
    assert {(r.frame_idx, r.fps, r.pose_ok, r.lhand_ok, r.rhand_ok) for r in out} == {(0, 25.0, False, False, True), (1, 25.0, False, True, False), (2, 25.0, True, False, False)}

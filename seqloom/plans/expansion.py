"""Registered queries: augmentation, training sets, near-duplicate checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.functions.rand import uniform
from seqloom.operators import augment as A
from seqloom.operators import frames as O
from seqloom.operators import metric_index as MI
from seqloom.operators import neardup as N
from seqloom.plans import sql
from seqloom.plans.frames_sql import FRAMES, HAND_MIN, SCALE_MIN, VELOCITY, chain, resampled
from seqloom.sources import surrogates as V


def _flat(frames):
    raw = frames.select("clip_id", "frame_idx", "lhand_ok", "rhand_ok", F.concat("pose", "lhand", "rhand", "face").alias("raw"))
    return O.long_rows(raw, ["clip_id", "frame_idx", "lhand_ok", "rhand_ok"], "raw", 6)


def aug_mirror(spark, sf):
    return _flat(A.mirror(V.embedding_frames(spark, sf), 0.5))


def aug_temporal(spark, sf):
    return A.temporal_crop(V.embedding_frames(spark, sf)).select("clip_id", "frame_idx", "vec_id")


def aug_hand_dropout(spark, sf):
    return A.hand_dropout(V.embedding_frames(spark, sf)).select("clip_id", "frame_idx", "lhand_ok", "rhand_ok")


def aug_spatial(spark, sf):
    s = O.resample(O.static_features(V.embedding_frames(spark, sf), HAND_MIN, SCALE_MIN))
    return O.long_rows(A.spatial_jitter(s), ["clip_id", "step"], "static")


def synth_negatives(spark, sf):
    s = A.synthetic_negatives(V.embedding_frames(spark, sf), 0.3, hand_min=HAND_MIN, scale_min=SCALE_MIN)
    return O.long_rows(s, ["clip_id", "step"], "static")


def training_set(spark, sf):
    f = V.embedding_frames(spark, sf)
    labels = f.select("clip_id", F.col("label").cast("string").alias("label")).distinct().filter(uniform(F.col("clip_id"), "fold") < 0.7)
    t = A.training_set(f, labels, 0.2, 0.5, hand_min=HAND_MIN, scale_min=SCALE_MIN)
    return O.long_rows(t, ["clip_id", "label", "step"], "window")


def _clips(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select(
        F.col("vec_id").alias("clip_id"),
        "label",
        F.when(uniform(F.col("vec_id"), "fold") < 0.3, "test").otherwise("train").alias("fold"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def near_dup_min_dist(spark, sf):
    return N.nearest_in_label(_clips(spark, sf), 64).select("clip_id", "label", F.round("dmin", 6).alias("dmin"))


def near_dup_pivots(spark, sf):
    """The same distances through the index of pivots."""
    return MI.nearest_by_pivots(_clips(spark, sf), 64).select("clip_id", "label", F.round("dmin", 6).alias("dmin"))


def near_dup_profile(spark, sf):
    near = N.nearest_in_label(_clips(spark, sf), 64).withColumn("cohort", F.when(F.col("label") < 5, "old").otherwise("new"))
    p = N.near_dup_profile(near, "cohort", (0.112, 0.115, 0.12))
    return p.select("cohort", "n", *[F.round(c, 5).alias(c) for c in p.columns if c not in ("cohort", "n")])


def _u(tag: str, key: str = "clip_id") -> str:
    return sql.u(key, tag + "42")


# Point order of a mirrored frame: pose, right hand, left hand, face.
_PERM = L.POSE_MIRROR + list(range(30, 51)) + list(range(9, 30)) + [51 + q for q in L.FACE_MIRROR]

MIRROR = f"""frm as (
  select clip_id, f, vec_id, pose_ok, case when m then rhand_ok else lhand_ok end as lhand_ok, case when m then lhand_ok else rhand_ok end as rhand_ok,
    case when m then list_transform(range(142), lambda j: case when j % 2 = 0 and raw[(2*perm[(j//2+1)::int]+1)::int] <> 0
        then 1.0 - raw[(2*perm[(j//2+1)::int]+1)::int] else raw[(2*perm[(j//2+1)::int]+j%2+1)::int] end) else raw end as raw
  from (select *, {_u('mirror')} < 0.5 as m, {_PERM} as perm from {{src}}))"""


def _temporal(src: str) -> str:
    return f"""ft0 as (select *, count(*) over (partition by clip_id) as t from {src}),
ft1 as (select *, case when t < 8 then 0 else floor(t * 0.85::double * {_u('crop_lo')} * 0.5)::bigint end as lo,
   t - floor(t * 0.15::double * {_u('crop_hi')} * 0.5)::bigint as hi0 from ft0),
frt as (select * replace (f - lo as f) from ft1 where f >= lo and f < case when t < 8 then t else greatest(lo + 6, least(hi0, t)) end)"""


def _dropout(src: str) -> str:
    key = "clip_id||'#'||f"
    side = lambda s: (
        f"{s}hand_ok and {_u('drop_' + s)} >= 0.08 and not ({_u('drop_some')} < 0.3 and {_u('drop_' + s, key)} <= 0.05) as {s}hand_ok"
    )
    return f"frd as (select * replace ({side('l')}, {side('r')}) from {src})"


def _gauss(seed: str, j: str) -> str:
    first = f"(({seed} + ({j}) * 7919) % 2147483647) * 48271 % 2147483647"
    u1, u2 = (f"((({first}) * {m} % 2147483647) + 1) / 2147483649.0::double" for m in (16807, 69621))
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * ({u2})))"


def _jitter(src: str) -> str:
    span = lambda tag, half: f"(({_u(tag)} * 2 - 1) * {half})"
    return f"""jt0 as (select clip_id, step, dim, v, lead(v) over q as nx, lag(v) over q as pv from {src} window q as (partition by clip_id, step order by dim)),
jp as (select clip_id, radians({span('rot', 10.0)}) as rot, 1 + {span('scale', 0.12)} as sc, {span('shift_x', 0.06)} as sx, {span('shift_y', 0.06)} as sy,
   {sql.seed31('clip_id', 'noise42')} as seed from (select distinct clip_id from {src})),
jit as (select clip_id, step, dim, case when dim >= 226 then v when dim % 2 = 0 then (v*cos(rot) - nx*sin(rot))*sc + case when dim < 142 then sx else 0 end
      else (pv*sin(rot) + v*cos(rot))*sc + case when dim < 142 then sy else 0 end end + 0.008 * {_gauss('seed', 'step*228+dim')} as v
  from jt0 join jp using (clip_id))"""


def _negatives(src: str, ratio: float) -> str:
    """Edge slices in CTE ``ngs``; their held steps come from ``negh`` after chain('ngs')."""
    return f"""ng0 as (select *, count(*) over (partition by clip_id) as t from {src}),
ng1 as (select *, greatest(2, t // 8) as kk from ng0 where clip_id in (
   select clip_id from (select clip_id, row_number() over (order by {sql.hexkey('clip_id', 'negative42')}) as rk, count(*) over () as n from (select distinct clip_id from {src})) where rk <= floor(n*{ratio}))),
ngs as (select clip_id, f, raw, pose_ok, lhand_ok, rhand_ok, t from ng1
   where f >= case when {_u('edge')} < 0.5 then 0 else greatest(0, t-kk) end and f < case when {_u('edge')} < 0.5 then 0 else greatest(0, t-kk) end + kk)"""


NEG_HELD = f"""negh as (select 'neg:'||s.clip_id as clip_id, k as step, dim, case when t < 4 then 0 else v + 0.004 * {_gauss('seed', 'k*228+dim')} end as v
  from (select *, min(f) over (partition by clip_id) as f0 from stat) s
  join (select clip_id, any_value(t) as t, {sql.seed31('clip_id', 'rest42')} as seed from ngs group by clip_id) g using (clip_id), range(48) r(k) where f = f0)"""

_COLS = "clip_id, step::int as step, dim::int as dim, round(v, 5) + 0.0 as v"
TRAIN_CLIPS = f"trc as (select * from fr where {sql.u('clip_id', 'fold')} < 0.7)"

NEAR = f"""cl as (select vec_id as clip_id, label, embedding as vec, case when {sql.u('vec_id', 'fold')} < 0.3 then 'test' else 'train' end as fold from embeddings),
nd as (select a.clip_id, a.label, min(list_sum(list_transform(range(1, 65), lambda i: abs(a.vec[i::int]::double - b.vec[i::int]::double))) / 64) as dmin
  from cl a join cl b on a.label = b.label and a.fold = 'test' and b.fold = 'train' group by a.clip_id, a.label)"""


def _rename(block: str) -> str:
    """The same CTE chain under second names, for use twice in one query."""
    import re

    for name in ("ff", "b0", "b1", "ax", "pts", "nrm", "stat"):
        block = re.sub(rf"\b{name}\b", name + "_n", block)
    return block


REGISTRY = {
    "aug_mirror": (
        aug_mirror,
        f"""with {FRAMES}, {MIRROR.format(src='fr')} select clip_id, f::int as frame_idx, lhand_ok, rhand_ok, j::int as dim,
            round(raw[(j+1)::int], 6) + 0.0 as v from frm, range(142) t(j)""",
    ),
    "aug_temporal": (aug_temporal, f"with {FRAMES}, {_temporal('fr')} select clip_id, f::int as frame_idx, vec_id from frt"),
    "aug_hand_dropout": (aug_hand_dropout, f"with {FRAMES}, {_dropout('fr')} select clip_id, f::int as frame_idx, lhand_ok, rhand_ok from frd"),
    "aug_spatial": (aug_spatial, f"with {FRAMES}, {chain()}, {resampled()}, {_jitter('rsm')} select {_COLS} from jit"),
    "synth_negatives": (synth_negatives, f"with {FRAMES}, {_negatives('fr', 0.3)}, {chain('ngs')}, {NEG_HELD} select {_COLS} from negh"),
    "training_set": (
        training_set,
        f"""with {FRAMES}, {TRAIN_CLIPS}, {MIRROR.format(src='trc')}, {_temporal('frm')}, {_dropout('frt')}, {chain('frd')}, {resampled()}, {_jitter('rsm')},
            {_negatives('trc', 0.2)}, {_rename(chain('ngs'))}, {_rename(NEG_HELD)},
            al as (select * from jit union all select * from negh), {VELOCITY.replace('rsm', 'al')}
            select win.clip_id, case when win.clip_id like 'neg:%' then '__NOSIGN__' else string_split(win.clip_id, '-')[1] end as label,
              step::int as step, dim::int as dim, round(v, 5) + 0.0 as v from win""",
    ),
    "near_dup_min_dist": (near_dup_min_dist, f"with {NEAR} select clip_id, label, round(dmin, 6) as dmin from nd"),
    "near_dup_pivots": (near_dup_pivots, f"with {NEAR} select clip_id, label, round(dmin, 6) as dmin from nd"),
    "near_dup_profile": (
        near_dup_profile,
        f"""with {NEAR}, c as (select *, case when label < 5 then 'old' else 'new' end as cohort from nd)
            select cohort, count(*) as n, round(avg(dmin), 5) as mean, round(stddev_samp(dmin), 5) as std, round(min(dmin), 5) as min, round(max(dmin), 5) as max,
              round(avg((dmin < 0.112)::int), 5) as below_0_112, round(avg((dmin < 0.115)::int), 5) as below_0_115, round(avg((dmin < 0.12)::int), 5) as below_0_12,
              round(quantile_cont(dmin, 0.1), 5) as p10, round(quantile_cont(dmin, 0.25), 5) as p25, round(quantile_cont(dmin, 0.5), 5) as p50
            from c group by cohort""",
    ),
}

"""SQL blocks for landmark frames, written over long rows (clip, frame, point)."""

from __future__ import annotations

HAND_MIN = 0.17
SCALE_MIN = 0.03

FRAMES = """fr as (
  select vec_id, label, label||'-'||(vec_id // 300) as clip_id,
    row_number() over (partition by label, vec_id // 300 order by vec_id) - 1 as f,
    (vec_id % 7 <> 3 and vec_id % 300 >= 20) as pose_ok, vec_id % 5 <> 0 as lhand_ok, vec_id % 4 <> 1 as rhand_ok,
    25.0::double as fps,
    list_transform(range(142), lambda j: embedding[(j % 64 + 1)::int]::double) as raw
  from embeddings)"""


def chain(src: str = "fr", hand_min: float = HAND_MIN, scale_min: float = SCALE_MIN, leading: str = "keep") -> str:
    """Static features as rows (clip_id, f, dim, v) in CTE ``stat``; axes in ``ax``."""
    back = (
        ", case when pose_ok then raw[1:18] end"
        if leading == "keep"
        else ", first_value(case when pose_ok then raw[1:18] end ignore nulls) over (partition by clip_id order by f rows between current row and unbounded following)"
    )
    hand = lambda a: (
        f"sqrt(list_sum(list_transform(range(21), lambda i: power(raw[({a}+2*i+1)::int]-raw[{a + 1}],2)+power(raw[({a}+2*i+2)::int]-raw[{a + 2}],2)))/21)"
    )
    return f"""ff as (
  select *, coalesce(last_value(case when pose_ok then raw[1:18] end ignore nulls)
      over (partition by clip_id order by f rows between unbounded preceding and current row){back}, raw[1:18]) as pf
  from {src}),
b0 as (
  select *, (pf[3]+pf[5])/2 as cx, (pf[4]+pf[6])/2 as cy, sqrt(power(pf[3]-pf[5],2)+power(pf[4]-pf[6],2)) as sh,
    atan2(pf[4]-pf[6], pf[3]-pf[5]) as a0, {hand(18)} as ls, {hand(60)} as rs from ff),
b1 as (
  select *, case when sh < {scale_min} then 0.9*sqrt(power(cx-(pf[15]+pf[17])/2,2)+power(cy-(pf[16]+pf[18])/2,2)) else sh end as s1,
    case when sh < {scale_min} then 0 else a0 end as ang,
    case when lhand_ok and ls >= {hand_min} then 1.0::double else 0 end as lflag, case when rhand_ok and rs >= {hand_min} then 1.0::double else 0 end as rflag,
    case when ls < {hand_min} then 1.0 else ls end as lspan, case when rs < {hand_min} then 1.0 else rs end as rspan from b0),
ax as (
  select *, case when s1 >= {scale_min} then s1 else
      coalesce(median(case when s1 >= {scale_min} then s1 end) over (partition by clip_id), 0.25) end as scale from b1),
pts as (
  select clip_id, f, p, cx, cy, scale, ang, lflag, rflag, lspan, rspan, raw,
    case when p < 9 then pf[(2*p+1)::int] else raw[(2*p+1)::int] end as x,
    case when p < 9 then pf[(2*p+2)::int] else raw[(2*p+2)::int] end as y
  from ax, range(71) t(p)),
nrm as (
  select *, case when p between 9 and 29 then lflag when p between 30 and 50 then rflag else 1 end as m,
    ((x-cx)*cos(ang)+(y-cy)*sin(ang))/(scale+1e-6) as gx, ((y-cy)*cos(ang)-(x-cx)*sin(ang))/(scale+1e-6) as gy from pts),
stat as (
  select clip_id, f, dim, greatest(-8.0, least(8.0, v)) as v from (
    select clip_id, f, 2*p as dim, gx*m as v from nrm union all
    select clip_id, f, 2*p+1, gy*m from nrm union all
    select clip_id, f, 142+2*(p-9), (x-raw[19])/(lspan+1e-6)*lflag from nrm where p between 9 and 29 union all
    select clip_id, f, 143+2*(p-9), (y-raw[20])/(lspan+1e-6)*lflag from nrm where p between 9 and 29 union all
    select clip_id, f, 184+2*(p-30), (x-raw[61])/(rspan+1e-6)*rflag from nrm where p between 30 and 50 union all
    select clip_id, f, 185+2*(p-30), (y-raw[62])/(rspan+1e-6)*rflag from nrm where p between 30 and 50 union all
    select clip_id, f, 226, lflag from nrm where p = 0 union all
    select clip_id, f, 227, rflag from nrm where p = 0))"""


def resampled(src: str = "stat", n: int = 48) -> str:
    """Rows (clip_id, step, dim, v) in CTE ``rsm``."""
    return f"""ct as (select clip_id, count(distinct f) as t from {src} group by clip_id),
gr as (select clip_id, t, k, case when t = 1 then 0 else (k*(t-1)) // {n - 1} end as lo, case when t = 1 then 0.0 else k*(t-1)/{n - 1}.0 - (k*(t-1)) // {n - 1} end as w
       from ct, range({n}) g(k)),
rsm as (
  select gr.clip_id, k as step, a.dim, a.v + w*(coalesce(b.v, a.v) - a.v) as v
  from gr join {src} a on a.clip_id = gr.clip_id and a.f = lo
  left join {src} b on b.clip_id = gr.clip_id and b.f = lo + 1 and b.dim = a.dim)"""


VELOCITY = """win as (
  select clip_id, step, dim, v from rsm union all
  select clip_id, step, 228+dim, coalesce(v - lag(v) over (partition by clip_id, dim order by step), 0) from rsm where dim < 142)"""

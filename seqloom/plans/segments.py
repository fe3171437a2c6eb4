"""Registered queries: live energy, segmentation, emissions, running sentences."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.functions import layout as L
from seqloom.functions.text import sentence
from seqloom.operators import frames as FR
from seqloom.operators import gloss as G
from seqloom.operators import scoring as C
from seqloom.operators import segments as O
from seqloom.operators.ordered_scan import Counter, ordered_scan
from seqloom.operators.ranking import exact_percentiles
from seqloom.plans import frames_sql as FS
from seqloom.plans import scoring as SC
from seqloom.plans import text as TX
from seqloom.session import shared_dir
from seqloom.sources import surrogates as V
from seqloom.streaming import live as live_ops

RULES = L.SegmentRules(hi=60.0, lo=20.0, quiet=2, min_len=4, max_len=9, cooldown=2, pre_roll=3, spare=3)


ARRIVALS = 4  # micro-batches the events table is dealt to
MOST_JITTER = 10_800  # seconds


def _segmented(spark, sf):
    return O.segment(V.event_stream(spark, sf), "stream_id", ["ts", "frame_idx"], RULES)


def segment_events(spark, sf):
    return _segmented(spark, sf).select("stream_id", "frame_idx", "frame_no", "event", "seg_len")


def _arrivals(rows, jitter):
    """Adds `arrival`, the micro-batch a row comes in: by its time plus the jitter (seconds)."""
    span = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    step = (span[1] - span[0] + MOST_JITTER) // ARRIVALS + 1
    return rows.withColumn("arrival", F.floor((F.unix_seconds("ts") - span[0] + jitter) / step))


STREAMS_A_SHARD = 128


def _shards(rows, key="stream_id"):
    """Shards of the streaming state: as many as the streams need, so that none grows with the table."""
    return rows.agg(F.approx_count_distinct(key)).first()[0] // STREAMS_A_SHARD + 16


def _streamed(spark, rows, live, key="stream_id"):
    """The result of `live(source, shards)` over the rows, which come in several micro-batches with rows swapped inside the watermark.

    Each arrival is one micro-batch, however many files it has: were it cut, its later files
    could fall behind the watermark of the first.
    """
    run = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    placed, shards = _arrivals(rows, F.pmod(F.xxhash64("frame_idx"), F.lit(1800))), _shards(rows, key)
    for i in range(ARRIVALS):
        placed.filter(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(f"{run}/in")
        if i == ARRIVALS - 1:
            live_ops.closing_rows(rows, key, "ts", -1).write.mode("append").parquet(f"{run}/in")
        out = live_ops.run_available(live(spark.readStream.schema(rows.schema).parquet(f"{run}/in"), shards), f"{run}/out", f"{run}/state")
    return out


def segment_stream(spark, sf):
    """The same events from a Structured Streaming run over the events table.

    The table arrives in several micro-batches; rows up to half an hour apart swap places
    between them, inside the watermark of an hour.
    """
    out = _streamed(spark, V.event_stream(spark, sf), lambda live, n: live_ops.segment_stream(live, rules=RULES, shards=n))
    return out.select("stream_id", "frame_idx", "frame_no", "event", "seg_len")


def rate_stream(spark, sf):
    """The rate meter from a streaming run; equals rate_ema."""
    rows = V.event_stream(spark, sf).select("stream_id", "ts", "frame_idx")
    out = _streamed(spark, rows, lambda live, n: live_ops.rate_stream(live, "stream_id", ("ts", "frame_idx"), shards=n)).filter("stream_id >= 0")
    return out.select("stream_id", "frame_idx", F.round(F.when(~F.isnan("rate"), F.col("rate")), 6).alias("rate"))


LATE_JITTER, DELAY, IDLE = 10_800, 3600, 43_200  # seconds


def segment_flush_stream(spark, sf):
    """Events of rows in time, flushed segments and late rows of a streaming run.

    Rows come up to three hours late, the watermark waits for one: each micro-batch is parted before
    the segmenter, and late rows are returned as event `late`. A segment left open by half a
    day without a row is flushed.
    """
    rows = V.event_stream(spark, sf)
    run = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    placed, shards = _arrivals(rows, F.pmod(F.col("frame_idx") * 7919, F.lit(LATE_JITTER))), _shards(rows)
    split = live_ops.split_late(f"{run}/split", "ts", DELAY)
    for i in range(ARRIVALS):  # one micro-batch an arrival, in both queries
        placed.filter(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(f"{run}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{run}/in")
        source.writeStream.foreachBatch(split).option("checkpointLocation", f"{run}/split-state").trigger(availableNow=True).start().awaitTermination()
        if i == ARRIVALS - 1:
            live_ops.closing_rows(rows, "stream_id", "ts", -1, "20 hours").write.parquet(f"{run}/split/on_time/batch={ARRIVALS}")
        on_time = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{run}/split/on_time")
        events = live_ops.segment_flush_stream(on_time, rules=RULES, idle_seconds=IDLE, shards=shards)
        out = live_ops.run_available(events, f"{run}/out", f"{run}/state").filter("stream_id >= 0")
    late = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{run}/split/late")
    late = late.select("stream_id", "frame_idx", F.lit("late").alias("event"), F.lit(0).alias("seg_len"))
    return out.select("stream_id", "frame_idx", "event", "seg_len").unionByName(late)


def segment_windows(spark, sf):
    return O.segment_windows(_segmented(spark, sf), "stream_id", "frame_idx", RULES).select("stream_id", "seg_id", "pos", "frame_idx")


def _live_frames(spark, sf):
    f = V.embedding_frames(spark, sf)
    return f.withColumn("stream_id", F.col("label")).withColumn("dt", F.lit(0.04)).withColumn("hands", F.col("lhand_ok") | F.col("rhand_ok"))


def online_energy(spark, sf):
    e = O.online_energy(_live_frames(spark, sf), "stream_id", ["vec_id"], [])
    return e.select("stream_id", "vec_id", F.round("energy", 5).alias("energy"))


LIVE_RULES = L.SegmentRules(hi=40.0, lo=25.0, quiet=2, min_len=4, max_len=9, cooldown=2, pre_roll=3, spare=3)
GATE = L.GateRules(0.35, 0.05)
EMIT_SCALE = 3.0


def stream_emissions(spark, sf):
    """Live frames to energy, segments, windows, classes and gated emissions.

    The two scans carry only ids and energies; landmarks join back by frame id
    for the segments' frames alone.
    """
    live = _live_frames(spark, sf)
    energy = O.online_energy(live, "stream_id", ["vec_id"], ["hands"])
    seg = O.segment(energy, "stream_id", ["vec_id"], LIVE_RULES)
    want = O.segment_windows(seg, "stream_id", "vec_id", LIVE_RULES).select(
        F.concat(F.col("stream_id").cast("string"), F.lit(":"), F.col("seg_id").cast("string")).alias("clip_id"),
        "stream_id", "seg_id", "n", F.col("pos").alias("frame_idx"), "vec_id",
    )
    frames = want.join(live.drop("clip_id", "frame_idx", "stream_id"), "vec_id")
    ids = ("stream_id", "seg_id", "n")
    feats = FR.window_mean(FR.build_window(frames, hand_min=FS.HAND_MIN, scale_min=FS.SCALE_MIN, carry=ids), carry=ids)
    clips = V.embedding_frames(spark, sf)
    known = FR.window_mean(FR.build_window(clips, hand_min=FS.HAND_MIN, scale_min=FS.SCALE_MIN, carry=("label",)), carry=("label",))
    model = C.fit_centroids(known, L.DIM_GLOBAL, 10, EMIT_SCALE, y="label")
    scored = model.transform(feats)
    name = F.when(F.col("pred") == 9, L.NOSIGN).otherwise(F.concat(F.lit("SIGN-"), F.col("pred").cast("string")))
    out = C.gate(scored.withColumn("gloss", name), GATE, "gloss")
    return out.select("stream_id", "seg_id", "gloss", F.round("conf", 5).alias("conf"), F.round("margin", 5).alias("margin"), F.col("n").cast("int").alias("frames"))


def rate_ema(spark, sf):
    ev = V.event_stream(spark, sf).select("stream_id", "ts", "frame_idx")
    r = O.rate_ema(ev.withColumn("us_in", F.unix_micros("ts")), "stream_id", ["ts", "frame_idx"], "us_in")
    return r.select("stream_id", "frame_idx", F.round(F.when(~F.isnan("rate"), F.col("rate")), 6).alias("rate"))


def latency_stats(spark, sf):
    """Wait for the quiet tail at the metered frame rate, over finished segments."""
    ends = _segmented(spark, sf).filter("event = 'end'").select("stream_id", "frame_idx")
    ev = V.event_stream(spark, sf).select("stream_id", "ts", "frame_idx").withColumn("us_in", F.unix_micros("ts"))
    rate = O.rate_ema(ev, "stream_id", ["ts", "frame_idx"], "us_in")
    lat = rate.join(ends, ["stream_id", "frame_idx"], "left_semi").select((F.lit(float(RULES.quiet)) / F.col("rate")).alias("lat"))
    p = exact_percentiles(lat, [], "lat", {"p90": 0.9})
    m = lat.agg(F.count("*").alias("n"), F.avg("lat").alias("mean"))
    return m.select("n", F.round("mean", 3).alias("latency_mean_s"), F.round(p.select("p90").scalar(), 3).alias("latency_p90_s"))


def false_alarm_rate(spark, sf):
    idle = V.event_stream(spark, sf).filter("stream_id % 3 = 0")
    streams = idle.groupBy("stream_id").agg(F.count("*").alias("n_frames")).withColumn("fps", F.lit(25.0))
    emitted = _segmented(spark, sf).filter("event = 'end'").select("stream_id")
    return G.false_alarms(emitted, streams)


def running_sentence(spark, sf):
    """The sentence so far after each emitted gloss; an error event clears it."""
    ev = TX.event_glosses(spark, sf).select("user_id", "ts", "event_id", "gloss")
    ev = ev.withColumn("reset", F.coalesce(F.col("gloss"), F.lit("")) == "error")
    numbered = ordered_scan(ev.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", ["ts", "event_id"], Counter("reset", "part"))
    real = G.drop_control(numbered.filter("not reset"))
    t = G.lookup(real, G.lexicon(spark, TX.EVENT_LEXICON))
    so_far = W.partitionBy("user_id", "part").orderBy("ts", "event_id")
    items = F.collect_list(F.struct(F.col("event_id").alias("ord"), "vi", "pos", "tense")).over(so_far)
    return t.withColumn("items", items).select("user_id", "event_id", sentence(F.col("items")).alias("sentence"))


def _sentence_rows(spark, sf):
    ev = TX.event_glosses(spark, sf).select(F.col("user_id").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("frame_idx"), "gloss")
    return G.sentence_rows(ev, G.lexicon(spark, TX.EVENT_LEXICON), F.col("gloss") == "error").drop("gloss")


def sentence_digests(spark, sf):
    """The running sentence after each gloss as length and digest, each at the cost of its gloss."""
    out = G.sentence_digests(_sentence_rows(spark, sf), "stream_id", ["ts", "frame_idx"])
    return out.select("stream_id", "frame_idx", "n_words", "n_chars", "digest", "place")


def sentence_stream(spark, sf):
    """The same from a streaming run."""
    out = _streamed(spark, _sentence_rows(spark, sf), lambda live, n: live_ops.sentence_stream(live, "stream_id", ("ts", "frame_idx"), shards=n)).filter("stream_id >= 0")
    return out.select("stream_id", "frame_idx", "n_words", "n_chars", "digest", "place")


def fsm_sql(src: str, key: str, rules: L.SegmentRules) -> str:
    """Segment events of ``src(key, rn, id, energy, hands)`` by stepping all streams together."""
    r = rules
    q2 = f"case when s.energy < {r.lo} or not s.hands then quiet + 1 else 0 end"
    over = f"({q2} >= {r.quiet} or cnt + 1 >= {r.max_len})"
    return f"""fsm as (
  select {key} as k, 0::bigint as rn, 'I' as st, 0 as cnt, 0 as quiet, 0 as cool, null::varchar as event, 0 as seg_len, null::bigint as id from (select distinct {key} from {src})
  union all
  select k, s.rn,
    case st when 'C' then case when cool - 1 <= 0 then 'I' else 'C' end
            when 'I' then case when s.energy > {r.hi} and s.hands then 'A' else 'I' end
            else case when {over} then 'C' else 'A' end end,
    case st when 'I' then 1 when 'A' then case when {over} then 0 else cnt + 1 end else 0 end,
    case st when 'A' then case when {over} then 0 else {q2} end else 0 end,
    case st when 'C' then cool - 1 when 'A' then {r.cooldown} else 0 end,
    case st when 'C' then 'cooldown'
            when 'I' then case when s.energy > {r.hi} and s.hands then 'start' else 'idle' end
            else case when {over} then case when cnt + 1 >= {r.min_len} then 'end' else 'discard' end else 'active' end end,
    case when st = 'A' and {over} then cnt + 1 else 0 end, s.id
  from fsm join {src} s on s.{key} = k and s.rn = fsm.rn + 1),
seg as (select k as stream_id, id, rn - 1 as frame_no, event, seg_len from fsm where rn > 0)"""


def seg_windows_sql(rules: L.SegmentRules) -> str:
    return f"""sw as (select e.stream_id, e.id as seg_id, f.frame_no - e.frame_no + least(e.frame_no + 1, {rules.buffer}, e.seg_len + {rules.pre_roll}) - 1 as pos, f.id
  from seg e join seg f on f.stream_id = e.stream_id and f.frame_no between e.frame_no - least(e.frame_no + 1, {rules.buffer}, e.seg_len + {rules.pre_roll}) + 1 and e.frame_no
  where e.event = 'end')"""


EV = """src as (select user_id as stream_id, row_number() over (partition by user_id order by ts, event_id) as rn, event_id as id, value as energy, event_type <> 'error' as hands from events)"""

RATE = """r0 as (select user_id as k, event_id, row_number() over (partition by user_id order by ts, event_id) as rn,
    (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6::double as dt from events),
rs as (select *, case when dt is not null then 1.0::double / greatest(dt, 1e-4::double) end as x from r0),
re as (select k, rn, event_id, x as rate from rs where rn = 1
  union all select rs.k, rs.rn, rs.event_id, case when re.rate is null then rs.x else 0.9*re.rate + 0.1*rs.x end from re join rs on rs.k = re.k and rs.rn = re.rn + 1)"""

# Live energy over the embedding frames: all streams advance one frame per step.
ENERGY = f"""lf0 as (select label, vec_id, row_number() over (partition by label order by vec_id) as rn, raw, pose_ok, lhand_ok or rhand_ok as hands,
    sqrt(power(raw[3]-raw[5],2)+power(raw[4]-raw[6],2)) as sh, (raw[3]+raw[5])/2 as cx, (raw[4]+raw[6])/2 as cy,
    (vec_id + 5) % 6 <> 0 as vl, (vec_id + 6) % 6 <> 0 as vr from fr),
lf1 as (select *, pose_ok and sh >= 0.001 as good, [(raw[11]-cx)/sh, (raw[12]-cy)/sh, (raw[13]-cx)/sh, (raw[14]-cy)/sh] as w from lf0),
lf2 as (select *, last_value(case when good then struct_pack(w := w, vl := vl, vr := vr) end ignore nulls)
    over (partition by label order by rn rows between unbounded preceding and 1 preceding) as p from lf1),
lf3 as (select *, sqrt(power(w[1]-p.w[1],2)+power(w[2]-p.w[2],2)) as dl, sqrt(power(w[3]-p.w[3],2)+power(w[4]-p.w[4],2)) as dr, vl and p.vl as ml, vr and p.vr as mr from lf2),
lf4 as (select *, case when p is null or not (ml or mr) then 0.0 else ((case when ml then dl else 0 end + case when mr then dr else 0 end) / (ml::int + mr::int)) / 0.04 end as v from lf3),
en as (select label, 0::bigint as rn, 0.0::double as energy, null::bigint as vec_id, null::boolean as hands from (select distinct label from lf4)
  union all select en.label, l.rn, case when good then 0.6*energy + 0.4*v else 0.7*energy end, l.vec_id, l.hands from en join lf4 l on l.label = en.label and l.rn = en.rn + 1)"""

_LIVE = "lsrc as (select label as stream_id, rn, vec_id as id, energy, hands from en where rn > 0)"

EMIT = f"""with recursive {FS.FRAMES}, {ENERGY}, {_LIVE}, {fsm_sql('lsrc', 'stream_id', LIVE_RULES)}, {seg_windows_sql(LIVE_RULES)},
allf as (select label::int as y, clip_id, f, raw, pose_ok, lhand_ok, rhand_ok, 'train' as fold from fr
  union all select -1, sw.stream_id||':'||seg_id, pos, raw, pose_ok, lhand_ok, rhand_ok, 'test' from sw join fr on fr.vec_id = sw.id),
{FS.chain('allf')}, {FS.resampled()},
mv as (select clip_id, dim, avg(v) as v from rsm where dim < 142 group by all),
mf as (select clip_id, any_value(y) as y, any_value(fold) as orig_split, any_value(fold) as fold, any_value(vec) as vec
  from (select clip_id, list(v order by dim) as vec from mv group by clip_id) join (select distinct clip_id, y, fold from allf) using (clip_id) group by clip_id),
{SC._run_sql('emit', 'mf', L.DIM_GLOBAL, EMIT_SCALE)},
x as (select clip_id, any_value(pred) as pred, max(p) as conf, max(p) - max(case when cls <> pred then p end) as margin from emit group by clip_id)
select string_split(clip_id, ':')[1]::int as stream_id, string_split(clip_id, ':')[2]::bigint as seg_id, 'SIGN-'||pred as gloss,
  round(conf, 5) as conf, round(margin, 5) as margin, (select count(*) from allf a where a.clip_id = x.clip_id)::int as frames
from x where pred <> 9 and conf >= {GATE.conf} and margin >= {GATE.margin}"""

RUNNING = f"""{TX.LEX_SQL}, {TX.TOKENS_SQL}, rs as (select event_id, raw = 'error' as reset,
              sum((raw = 'error')::int) over (partition by user_id order by ts, event_id) as part from ev),
            g as (select t.*, part, row_number() over (partition by user_id, part order by ts, t.event_id) as i from tkn t join rs on rs.event_id = t.event_id where not reset),
            px as (select a.event_id as emit, b.event_id, b.i, b.vi, b.pos, b.tense from g a join g b on a.user_id = b.user_id and a.part = b.part and b.i <= a.i),
            {TX.sentence_sql('px', 'emit', 'i')}"""

DIGESTS = f"""with {RUNNING},
w3 as (select k, o, q, 1 + case when prev in ('NOUN','PRON') and pos = 'NOUN' and has_verb = 0 then 1 else 0 end + case when q = v1 and has_neg = 0 and tn in ('past', 'fut') then 1 else 0 end as nw from s3),
w4 as (select k, o, nw, sum(nw) over (partition by k order by q) as upto from w3),
w5 as (select k, sum(nw) as n from w4 group by k),
own as (select emit, max(i) as i from px group by emit),
dg as (select k, sentence, list_reduce(list_prepend(0::bigint, list_transform(range(1, length(sentence) + 1), lambda i: unicode(sentence[i])::bigint)), lambda h, c: (h * 1000003 + c) % 2147483647) as digest from snt)
select e.user_id as stream_id, e.event_id as frame_idx, w5.n::bigint as n_words, length(sentence)::bigint as n_chars, digest::bigint as digest, coalesce(w4.upto, 0)::bigint as place
from dg join own on own.emit = dg.k join w5 on w5.k = dg.k left join w4 on w4.k = dg.k and w4.o = own.i join events e on e.event_id = dg.k"""


def flush_sql(rules: L.SegmentRules) -> str:
    """Rows in time and late ones by arrival; all streams step together, a gap closes an open segment first."""
    r = rules
    q2 = f"case when energy < {r.lo} or not hands then quiet + 1 else 0 end"
    over = f"({q2} >= {r.quiet} or cnt + 1 >= {r.max_len})"
    kind = lambda n: f"case when {n} >= {r.min_len} then 'flush_end' else 'flush_discard' end"
    return f"""with recursive span as (select min(epoch_us(ts) // 1000000) as lo, max(epoch_us(ts) // 1000000) as hi from events),
arr as (select user_id, event_id, ts, value, event_type, (epoch_us(ts) // 1000000 - lo + event_id * 7919 % {LATE_JITTER}) // ((hi - lo + {MOST_JITTER}) // {ARRIVALS} + 1) as arrival from events, span),
tops as (select arrival, max(epoch_us(ts)) as top from arr group by arrival),
mk as (select arr.*, coalesce(epoch_us(ts) <= (select max(top) from tops where tops.arrival < arr.arrival) - {DELAY * 1_000_000}, false) as late from arr),
src as (select user_id as k, event_id as id, value as energy, event_type <> 'error' as hands, row_number() over w as rn, lag(event_id) over w as pid,
    coalesce(epoch_us(ts) - lag(epoch_us(ts)) over w > {IDLE * 1_000_000}, false) as gap from mk where not late window w as (partition by user_id order by ts, event_id)),
fsm as (select k, 0::bigint as rn, 'I' as st, 0 as cnt, 0 as quiet, 0 as cool, null::varchar as event, 0 as seg_len, null::bigint as id, 0 as fl, null::bigint as fid from (select distinct k from src)
  union all
  select k, rn, case e when 'C' then case when cool - 1 <= 0 then 'I' else 'C' end when 'I' then case when energy > {r.hi} and hands then 'A' else 'I' end else case when {over} then 'C' else 'A' end end,
    case e when 'I' then 1 when 'A' then case when {over} then 0 else cnt + 1 end else 0 end,
    case e when 'A' then case when {over} then 0 else {q2} end else 0 end,
    case e when 'C' then cool - 1 when 'A' then {r.cooldown} else 0 end,
    case e when 'C' then 'cooldown' when 'I' then case when energy > {r.hi} and hands then 'start' else 'idle' end
      else case when {over} then case when cnt + 1 >= {r.min_len} then 'end' else 'discard' end else 'active' end end,
    case when e = 'A' and {over} then cnt + 1 else 0 end, id, case when st = 'A' and gap then cnt else 0 end, pid
  from (select fsm.k, s.rn, st, case when st = 'A' and gap then 'I' else st end as e, cnt, quiet, cool, energy, hands, s.id, gap, pid from fsm join src s on s.k = fsm.k and s.rn = fsm.rn + 1)),
last as (select k, arg_max(st, rn) as st, arg_max(cnt, rn) as cnt, arg_max(id, rn) as id from fsm group by k)
select k as stream_id, id as frame_idx, event, seg_len::int as seg_len from fsm where rn > 0
union all select k, fid, {kind('fl')}, fl::int from fsm where fl > 0
union all select k, id, {kind('cnt')}, cnt::int from last where st = 'A'
union all select user_id, event_id, 'late', 0 from mk where late"""


REGISTRY = {
    "sentence_digests": (sentence_digests, DIGESTS),
    "sentence_stream": (sentence_stream, DIGESTS),
    "rate_stream": (rate_stream, f"with recursive {RATE} select k as stream_id, event_id as frame_idx, round(rate, 6) as rate from re"),
    "segment_flush_stream": (segment_flush_stream, flush_sql(RULES)),
    "stream_emissions": (stream_emissions, EMIT),
    "segment_events": (
        segment_events,
        f"with recursive {EV}, {fsm_sql('src', 'stream_id', RULES)} select stream_id, id as frame_idx, frame_no, event, seg_len::int as seg_len from seg",
    ),
    "segment_stream": (
        segment_stream,
        f"with recursive {EV}, {fsm_sql('src', 'stream_id', RULES)} select stream_id, id as frame_idx, frame_no, event, seg_len::int as seg_len from seg",
    ),
    "segment_windows": (
        segment_windows,
        f"with recursive {EV}, {fsm_sql('src', 'stream_id', RULES)}, {seg_windows_sql(RULES)} select stream_id, seg_id, pos::int as pos, id as frame_idx from sw",
    ),
    "online_energy": (
        online_energy,
        f"with recursive {FS.FRAMES}, {ENERGY} select label as stream_id, vec_id, round(energy, 5) as energy from en where rn > 0",
    ),
    "rate_ema": (rate_ema, f"with recursive {RATE} select k as stream_id, event_id as frame_idx, round(rate, 6) as rate from re"),
    "latency_stats": (
        latency_stats,
        f"""with recursive {EV}, {fsm_sql('src', 'stream_id', RULES)}, {RATE}, l as (select {float(RULES.quiet)}::double / rate as lat from re join seg on seg.id = re.event_id where event = 'end')
            select count(*) as n, round(avg(lat), 3) as latency_mean_s, round(quantile_cont(lat, 0.9), 3) as latency_p90_s from l""",
    ),
    "false_alarm_rate": (
        false_alarm_rate,
        f"""with recursive {EV}, {fsm_sql('src', 'stream_id', RULES)}, m as (select count(*) / 25.0::double / 60.0 as mins from events where user_id % 3 = 0)
            select count(*) as emitted, round(any_value(mins), 2) as idle_minutes, round(count(*) / greatest(any_value(mins), 1e-6), 2) as false_per_min
            from seg, m where event = 'end' and stream_id % 3 = 0""",
    ),
    "running_sentence": (running_sentence, f"with {RUNNING} select e.user_id, e.event_id, sentence from snt join events e on e.event_id = k"),
}

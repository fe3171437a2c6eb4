import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions import layout as L
from seqloom.operators import frames as FR
from seqloom.operators import segments as S
from seqloom.operators.ordered_scan import Counter, ordered_scan
from seqloom.plans.segments import REGISTRY
from seqloom.session import shared_dir
from seqloom.streaming import live
from tests.oracle import rows_of
from tests.people import person

RULES = L.SegmentRules()


def events_of(energies, hands=None, rules=RULES):
    scan = S.SegmentScan(rules)
    rows = {"energy": np.array(energies, float), "hands": np.array([True] * len(energies) if hands is None else hands)}
    _, out = scan.run(scan.start(), rows)
    return list(out["event"]), list(out["seg_len"])


def plain_fsm(energies, hands, r):
    """The segmenter written as a plain loop, to check the transition tables."""
    st, n, q, cool, out = "idle", 0, 0, 0, []
    for e, h in zip(energies, hands):
        if st == "cool":
            cool -= 1
            st = "idle" if cool <= 0 else st
            out.append(("cooldown", 0))
        elif st == "idle":
            if e > r.hi and h:
                st, n, q = "act", 1, 0
            out.append(("start" if st == "act" else "idle", 0))
        else:
            n, q = n + 1, q + 1 if (e < r.lo or not h) else 0
            if q >= r.quiet or n >= r.max_len:
                out.append(("end" if n >= r.min_len else "discard", n))
                st, cool = "cool", r.cooldown
            else:
                out.append(("active", 0))
    return out


def test_one_sign():
    ev, n = events_of([0.05] * 5 + [0.9] * 20 + [0.05] * 22)
    assert ev.index("start") == 5 and ev.index("end") == 30 and n[30] == 26 and ev.count("end") == 1


def test_quiet_stream():
    assert set(events_of([0.05] * 60)[0]) == {"idle"}


@pytest.mark.parametrize("burst,want", [(3, "discard"), (4, "end")])
def test_short_bursts(burst, want):
    ev, n = events_of([0.9] * burst + [0.05] * 30)
    assert want in ev and n[ev.index(want)] == burst + 6


def test_forced_cut_and_cooldown():
    ev, n = events_of([0.9] * 200)
    assert ev[89] == "end" and n[89] == 90 and ev[90:98] == ["cooldown"] * 8 and ev[98] == "start"


def test_lost_hands_end_a_sign():
    ev, _ = events_of([0.9] * 30, [True] * 15 + [False] * 15)
    assert ev.index("end") == 20


def test_open_segment_is_not_flushed():
    assert "end" not in events_of([0.9] * 20)[0]


@pytest.fixture(scope="module")
def long_stream(spark):
    """One stream with nearly all rows, next to many short ones."""
    rng = np.random.default_rng(3)
    hot = pd.DataFrame({"stream_id": 7, "i": np.arange(6000)})
    rest = pd.DataFrame({"stream_id": rng.integers(0, 60, 900) * 2, "i": np.arange(10000, 10900)})
    pdf = pd.concat([hot, rest], ignore_index=True)
    pdf["energy"] = np.where(rng.random(len(pdf)) < 0.5, rng.random(len(pdf)), np.repeat(rng.random(len(pdf) // 10 + 1), 10)[: len(pdf)])
    pdf["hands"] = rng.random(len(pdf)) < 0.97
    pdf["good"] = rng.random(len(pdf)) < 0.8
    for c in ("w0", "w1", "w2", "w3"):
        pdf[c] = rng.normal(size=len(pdf))
    pdf["vis_l"], pdf["vis_r"] = rng.random(len(pdf)) < 0.8, rng.random(len(pdf)) < 0.8
    pdf["dt"] = np.where(rng.random(len(pdf)) < 0.02, 0.0, 0.04)
    pdf["us"] = (pdf["i"] * 40000 + rng.integers(0, 30000, len(pdf))).astype(np.int64)
    return pdf.sample(frac=1, random_state=1)


def sequential(pdf, scan):
    out = []
    for _, g in pdf.sort_values(["stream_id", "i"]).groupby("stream_id", sort=True):
        _, o = scan.run(scan.start(), {c: g[c].to_numpy() for c in scan.columns})
        out.append(g[["stream_id", "i"]].assign(**o))
    return pd.concat(out).sort_values(["stream_id", "i"]).reset_index(drop=True)


@pytest.mark.parametrize("scan", [S.SegmentScan(RULES), S.SegmentScan(L.SegmentRules(hi=0.6, lo=0.5, quiet=2, min_len=4, max_len=9, cooldown=2)), S.EnergyScan(), S.RateScan(), Counter("hands", "seen")], ids=["segments", "short", "energy", "rate", "count"])
def test_split_streams_equal_one_pass(spark, long_stream, scan):
    df = spark.createDataFrame(long_stream).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_scan(df, "stream_id", ["i"], scan).withColumn("pid", F.spark_partition_id())
        pdf = got.toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert pdf[pdf.stream_id == 7].pid.nunique() > 3  # the long stream really was split
    pdf = pdf.sort_values(["stream_id", "i"]).reset_index(drop=True)
    want = sequential(long_stream, scan)
    for name, _ in scan.outputs:
        if want[name].dtype.kind == "f":
            assert np.allclose(pdf[name].astype(float), want[name], rtol=1e-9, equal_nan=True)
        else:
            assert pdf[name].tolist() == want[name].tolist()


def test_tables_match_plain_loop(long_stream):
    g = long_stream[long_stream.stream_id == 7].sort_values("i")
    for r in (RULES, L.SegmentRules(hi=0.6, lo=0.5, quiet=2, min_len=4, max_len=9, cooldown=2)):
        ev, n = events_of(g.energy, g.hands, r)
        assert list(zip(ev, n)) == plain_fsm(g.energy, g.hands, r)


def test_window_is_clipped_by_buffer_and_start(spark):
    rows = [("a", i, 0.9 if 2 <= i < 200 else 0.05, True) for i in range(230)]
    df = spark.createDataFrame(rows, "stream_id string, i long, energy double, hands boolean")
    seg = S.segment(df, "stream_id", ["i"], RULES)
    w = S.segment_windows(seg, "stream_id", "i", RULES).groupBy("seg_id").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    got = {r["seg_id"]: (r["n"], r["lo"], r["hi"]) for r in w.collect()}
    assert got[91] == (92, 0, 91) and got[189] == (98, 92, 189)


def energy_rows(n=300):
    rng = np.random.default_rng(5)
    base = pd.Timestamp("2024-01-01")
    rows = []
    for s in ("a", "b", "c"):
        e = np.repeat(rng.choice([0.05, 0.9], n // 10), 10)
        rows += [(s, base + pd.Timedelta(milliseconds=40 * i), i, float(e[i]), bool(rng.random() < 0.98)) for i in range(n)]
    return pd.DataFrame(rows, columns=["stream_id", "ts", "frame_idx", "energy", "hands"]).sort_values(["ts", "stream_id"])


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, tmp_path, files):
    """Rows come out of order within a file and across files, inside the watermark."""
    pdf = energy_rows()
    src = tmp_path / "in"
    src.mkdir()
    late = np.random.default_rng(1).random(len(pdf)) < 0.2  # a fifth of the rows come a file later
    file = np.minimum(np.arange(len(pdf)) * files // len(pdf) + late, files - 1)
    for k in range(files):
        part = np.flatnonzero(file == k)
        spark.createDataFrame(pdf.iloc[part].sample(frac=1, random_state=k)).coalesce(1).write.mode("append").parquet(str(src))
    df = spark.createDataFrame(pdf)
    live.closing_rows(df, "stream_id", "ts", "~end").coalesce(1).write.mode("append").parquet(str(src))
    want = S.segment(df, "stream_id", ["ts", "frame_idx"], RULES).select("stream_id", "frame_idx", "frame_no", "event", "seg_len")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = live.run_available(live.segment_stream(stream, rules=RULES), str(tmp_path / "out"), str(tmp_path / "cp")).select(*want.columns)
    assert out.count() == len(pdf) and want.exceptAll(out).isEmpty() and out.exceptAll(want).isEmpty()
    assert out.filter("event = 'end'").count() > 3


def test_live_frames_equal_batch_windows(spark, tmp_path):
    """Stream: landmarks to finished segments' frames, then feature windows."""
    rows = []
    base = pd.Timestamp("2024-01-01")
    p = person(150)
    rng = np.random.default_rng(2)
    shake = np.where((np.arange(150) // 25 % 2 == 0)[:, None], rng.normal(0, 0.02, (150, 2)), 0.0)
    p["pose"][:, 5] += shake
    for i in range(150):
        rows.append(("s", (base + pd.Timedelta(milliseconds=40 * i)).to_pydatetime(), i, 25.0, 0.04, *[p[k][i].ravel().tolist() for k in ("pose", "lhand", "rhand", "face")], p["vis"][i].tolist(), True, True, True))
    schema = "stream_id string, ts timestamp, i int, fps double, dt double, pose array<double>, lhand array<double>, rhand array<double>, face array<double>, pose_vis array<double>, pose_ok boolean, lhand_ok boolean, rhand_ok boolean"
    src = tmp_path / "in"
    df = spark.createDataFrame(rows, schema)
    for part in (rows[:60] + rows[70:90], rows[60:70] + rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    live.closing_rows(df, "stream_id", "ts", "~end").coalesce(1).write.mode("append").parquet(str(src))
    energy = S.online_energy(df.withColumn("hands", F.col("lhand_ok")), "stream_id", ["i"], ["hands"])
    batch = S.segment_windows(S.segment(energy, "stream_id", ["i"], RULES), "stream_id", "i", RULES)
    want = {(r["seg_id"], r["pos"], r["i"]) for r in batch.collect()}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    segs = live.segment_frame_stream(stream, "stream_id", ("ts", "i"), RULES)
    out = tmp_path / "windows"

    def classify(batch_df):
        ids = ("stream_id", "seg_id")
        clips = batch_df.withColumn("clip_id", F.concat_ws(":", "stream_id", "seg_id"))
        return FR.build_window(clips, carry=ids)

    q = segs.writeStream.foreachBatch(live.each_batch(classify, str(out))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.json(str(out) + "/batch=*")
    assert want and {r["seg_id"] for r in got.select("seg_id").distinct().collect()} == {s for s, _, _ in want}
    assert got.count() == 48 * len({s for s, _, _ in want})
    joined = batch.select("seg_id", F.col("pos").alias("frame_idx"), "i").join(df, "i").withColumn("clip_id", F.concat_ws(":", F.lit("s"), "seg_id"))
    ref = FR.build_window(joined, carry=("seg_id",))
    diff = got.select("seg_id", "step", F.col("window").alias("w")).join(ref, ["seg_id", "step"]).select(F.max(F.expr("array_max(zip_with(w, window, (a, b) -> abs(a - b)))"))).first()[0]
    assert diff < 1e-9


def test_checkpoint_folder_is_taken_from_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark)


@pytest.fixture(scope="module")
def many_files(spark, tmp_path_factory):
    """The small events table in as many files, and partitions, as a large one has."""
    path = str(tmp_path_factory.mktemp("events"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(24).write.parquet(f"{path}/events.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # each file is a partition
    yield path
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
@pytest.mark.parametrize("key", ["segment_stream", "segment_flush_stream", "rate_stream", "sentence_stream"])
def test_streams_over_many_files(spark, many_files, key):
    """An arrival of any number of files is one micro-batch: no file falls behind the watermark of another."""
    fn, sql = REGISTRY[key]
    got = fn(spark, many_files).toPandas()
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{many_files}/events.parquet/*.parquet'")
    assert rows_of(got) == rows_of(con.execute(sql).df())


@pytest.mark.parametrize("scan", [S.SegmentScan(RULES), S.RateScan()])
def test_one_call_serves_a_shard(scan):
    """Streams of a shard keep their own states, over calls and between them."""
    long, double, flag = T.LongType(), T.DoubleType(), T.BooleanType()
    fields = [("k", T.StringType()), (live.MICROS, long), ("i", long), ("energy", double), ("hands", flag), ("us", long)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 90), live.MICROS: rng.permutation(90) * 1_000_000, "i": np.arange(90), "energy": rng.choice([5.0, 90.0], 90), "hands": True})
    pdf["us"] = pdf[live.MICROS]
    proc = live.ShardProcessor("k", ["ts", "i"], schema, scan, T.StructType([T.StructField("x", long), T.StructField("y", long)]))
    proc.init(_Handle())
    got = pd.concat([out for piece, at in ((pdf[:50], 20_000), (pdf[50:50], 30_000), (pdf[50:], 30_000), (pdf[:0], 99_000)) for out in proc._advance([piece], at)])
    # the first 50 rows come before the watermark of 20 s, the rest after it: order holds among rows released together
    for k, rows in got.groupby("k"):
        assert sorted(rows["i"]) == sorted(pdf[pdf.k == k]["i"])
        _, want = scan.run(scan.start(), {c: rows[c].to_numpy() for c in scan.columns})
        for c, v in want.items():
            assert rows[c].tolist() == v.tolist() or np.allclose(rows[c], v, equal_nan=True)


class _Handle:
    """Keyed state of one shard, in memory."""

    def getListState(self, *_):
        return _State()

    getValueState = getListState

    def registerTimer(self, at):
        pass


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, value):
        self.value = value

    update = put

    def clear(self):
        self.value = None

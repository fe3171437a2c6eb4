import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.operators import gloss as G
from seqloom.operators import manifest as M
from seqloom.operators import processed as P
from seqloom.operators import ranking as R
from seqloom.operators import splits as S
from seqloom.sources import io
from tests.people import frames, person


@pytest.fixture(scope="module")
def sixty(spark):
    tags = ["train", "test", "val", "", " TEST "]
    rows = [(f"x{i}.npz", f"L{i % 6}", f"s{i}", f"g{i // 3}", f"S{i % 5}", tags[i % 5]) for i in range(60)]
    return spark.createDataFrame(rows, "npz string, label string, stem string, group_id string, signer_id string, split string").repartition(5)


@pytest.mark.parametrize("mode,key,n_test,n_val", [("group", "group_id", 3, 3), ("signer", "signer_id", 1, 1)])
def test_key_splits_do_not_leak(sixty, mode, key, n_test, n_val):
    f = S.make_splits(sixty, mode)
    S.assert_no_leakage(f, key)
    keys = {r["fold"]: r["n"] for r in f.groupBy("fold").agg(F.count_distinct(key).alias("n")).collect()}
    assert keys["test"] == n_test and keys["val"] == n_val and keys["train"] > 0
    again = S.make_splits(sixty.repartition(3), mode)
    assert f.select("npz", "fold").exceptAll(again.select("npz", "fold")).isEmpty()


def test_random_split_leaks_groups(sixty):
    f = S.make_splits(sixty, "random")
    n = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert n == {"test": 9, "val": 9, "train": 42}
    with pytest.raises(AssertionError):
        S.assert_no_leakage(f, "group_id")


def test_provided_split(sixty):
    f = S.make_splits(sixty.withColumn("group_id", F.col("npz")), "provided")
    got = {(r["split"], r["fold"]): r["count"] for r in f.groupBy("split", "fold").count().collect()}
    assert got["test", "test"] == 12 and got[" TEST ", "test"] == 12
    assert sum(v for (_, fold), v in got.items() if fold == "val") == 5 and ("val", "test") not in got


def test_split_errors(sixty):
    with pytest.raises(ValueError):
        S.make_splits(sixty.drop("split"), "provided")
    with pytest.raises(ValueError):
        S.make_splits(sixty.withColumn("split", F.lit("train")), "provided")
    with pytest.raises(ValueError):
        S.make_splits(sixty.withColumn("signer_id", F.lit("")), "signer")
    with pytest.raises(ValueError):
        S.make_splits(sixty, "other")


def test_tiny_splits(spark):
    one = spark.createDataFrame([("a", "g", "L")], "npz string, group_id string, label string")
    assert S.make_splits(one, "group").first()["fold"] == "test"
    assert S.make_splits(one, "random").first()["fold"] == "train"


def test_group_and_signer(spark):
    d = spark.createDataFrame([("127824_1",), ("127824",), ("abc_1",), ("x9",)], "stem string")
    assert [r[0] for r in d.select(M.derive_group(F.col("stem"))).collect()] == ["127824", "127824", "abc_1", "x9"]
    assert [r[0] for r in d.select(M.derive_group(F.col("stem"), r"(\d+)")).collect()] == ["127824", "127824", "abc_1", "x9"]
    assert [r[0] for r in d.select(M.derive_group(F.col("stem"), "")).collect()][0] == "127824_1"
    assert [r[0] for r in d.select(M.derive_signer(F.col("stem"), r"x(\d)")).collect()] == ["", "", "", "9"]


def test_union_defaults_and_first_wins(spark):
    a = spark.createDataFrame([(0, "p1", "A", "g"), (1, "p2", "B", "g")], "row_ord long, npz string, label string, group_id string")
    b = spark.createDataFrame([(0, "p1", "Z"), (1, "p3", "C")], "row_ord long, npz string, label string")
    u = M.union_manifests([("one", a), ("", b)])
    rows = {r["npz"]: r for r in M.first_by_path(u).collect()}
    assert rows["p1"]["label"] == "A" and rows["p1"]["group_id"] == "one:g" and rows["p3"]["group_id"] == "src1:0" or rows["p3"]["group_id"] == ":0"
    assert rows["p3"]["video"] == "" and rows["p3"]["n_frames"] == 0 and rows["p3"]["fps"] == 0.0 and rows["p3"]["stem"] == "0"
    plain = M.union_manifests([("one", a)], prefix_groups=False)
    assert plain.first()["group_id"] == "g"


def test_many_copies_of_one_path(spark):
    d = spark.range(5000).select(F.concat(F.lit("p"), F.col("id") % 1).alias("npz"), F.lit("L").alias("label"), (5000 - F.col("id")).alias("row_ord"))
    out = M.first_by_path(M.union_manifests([("s", d)]))
    assert out.count() == 1 and out.first()["row_ord"] == 1
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_label_map_and_weights(spark):
    d = spark.createDataFrame([("b",), ("a",), ("b",), ("é",)], "label string")
    m = {r["label"]: r["idx"] for r in M.label_map(d).collect()}
    assert m == {"a": 0, "b": 1, "é": 2, L.NOSIGN: 3}
    real = {r["label"]: r["idx"] for r in M.label_map(d.union(spark.createDataFrame([(L.NOSIGN,)], "label string"))).collect()}
    assert real == {L.NOSIGN: 0, "a": 1, "b": 2, "é": 3}
    w = {r["label"]: r["weight"] for r in M.class_weights(d, M.label_map(d)).collect()}
    counts = np.array([1, 2, 1, 4 / 3])
    assert np.allclose([w[k] for k in ("a", "b", "é", L.NOSIGN)], np.clip(counts.sum() / (4 * counts), 0.2, 5))


def test_quality_and_stride(spark):
    p = person(100)
    p["pose_ok"][:25] = False
    f = frames(spark, {"a": p})
    q = M.clip_quality(f).first()
    assert q["n_frames"] == 100 and q["det_rate"] == 0.75
    s = M.stride_frames(f, 2, 10).collect()
    assert sorted(r["frame_idx"] for r in s) == list(range(0, 20, 2)) and s[0]["fps"] == 12.5
    assert M.frames_beyond(f, 2, 10).first()["n_removed"] == 40


def test_long_clips_keep_all_frames(spark):
    f = spark.range(1000).selectExpr("'a' as clip_id", "cast(id as int) as frame_idx", "25.0D as fps")
    assert M.stride_frames(f).count() == 1000 and M.stride_frames(f, 3).count() == 334


def test_file_names_may_hold_any_character(spark):
    d = spark.createDataFrame([("x/l/a#2.mp4",), ("x/l/what?.mp4",), ("x/l/b.mp4/",)], "p string")
    assert sorted(r["stem"] for r in M.clip_catalog(d, "p").collect()) == ["a#2", "b", "what?"]


def test_alternatives_in_a_group_pattern_are_anchored(spark):
    d = spark.createDataFrame([("b1",), ("xb1",)], "s string")
    assert [r[0] for r in d.select(M.derive_group(F.col("s"), "^a|(b)")).collect()] == ["b", "xb1"]


def test_ordinals_and_percentiles_with_an_outlier(spark):
    d = spark.range(20_000).selectExpr("id * 3 as k", "cast(id % 7919 as double) as v").union(spark.createDataFrame([(10**15, 1e12)], "k long, v double"))
    b = R.value_buckets(d, [], "k")
    assert b.groupBy("_b").count().agg(F.max("count")).first()[0] < 1000
    o = R.global_ordinal(d, "k")
    assert o.where("ordinal <> k / 3 + 1").count() == 1 and o.agg(F.max("ordinal")).first()[0] == 20_001
    got = R.exact_percentiles(d, [], "v", {"p50": 0.5}).first()["p50"]
    assert got == np.percentile([float(i % 7919) for i in range(20_000)] + [1e12], 50)


def test_balanced_shards_walk(spark):
    d = spark.createDataFrame([(x,) for x, n in zip("abcde", (5, 4, 3, 3, 1)) for _ in range(n)], "label string")
    got = {r["label"]: r["shard"] for r in M.balanced_shards(d, 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=3000), np.full(2000, 0.5), [1e6]])
    d = spark.createDataFrame([("a", float(x)) for x in v] + [("b", 1.0), ("b", 2.0)], "g string, v double")
    got = {r["g"]: r for r in R.exact_percentiles(d, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).collect()}
    for name, q in (("p10", 10), ("p50", 50), ("p90", 90)):
        assert got["a"][name] == pytest.approx(np.percentile(v, q)) and got["b"][name] == pytest.approx(np.percentile([1.0, 2.0], q))
    one = R.exact_percentiles(d.filter("g = 'b'"), [], "v", {"p90": 0.9}).first()
    assert one["p90"] == pytest.approx(1.9)


def test_ordinals(spark):
    d = spark.range(0, 9000, 3).repartition(7)
    o = R.global_ordinal(d, "id")
    assert o.filter("ordinal <> id div 3 + 1").isEmpty()


def test_stratified_fraction(spark):
    d = spark.range(1000).select(F.concat(F.lit("c"), F.col("id")).alias("npz"), F.when(F.col("id") < 900, "big").otherwise("small").alias("label"))
    n = {r["label"]: r["count"] for r in S.stratified_fraction(d, 0.25).groupBy("label").count().collect()}
    assert n == {"big": 225, "small": 25}


def test_clip_folder_listing(spark, tmp_path):
    for name in ("Xin chào/a.mp4", "Xin chào/b.txt", "Ăn/c.d.MP4", "Ăn/e.Mp4"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    got = {(r["label"], r["stem"], r["suffix"]) for r in io.list_clips(spark, str(tmp_path)).collect()}
    assert {(s, x) for _, s, x in got} == {("a", ".mp4"), ("c.d", ".MP4")}


def test_manifest_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("p", "0123", None, 7)], "npz string, group_id string, signer_id string, n_frames int")
    io.write_csv(d, str(tmp_path / "m"))
    r = io.read_manifest(spark, str(tmp_path / "m")).first()
    assert (r["group_id"], r["signer_id"], r["n_frames"]) == ("0123", "", 7)


def test_lists_and_sentences(spark, tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("# note\nEM Ăn xôi\n\n  BỐ ĐI \n", encoding="utf-8")
    assert [r["value"] for r in io.read_list(spark, str(p)).orderBy("ord").collect()] == ["EM Ăn xôi", "BỐ ĐI"]
    assert [r["ref"] for r in io.read_reference_sentences(spark, str(p)).orderBy("ord").collect()] == [["EM", "ĂN", "XÔI"], ["BỐ", "ĐI"]]


def test_lexicon_file(spark, tmp_path):
    p = tmp_path / "lex.json"
    p.write_text(json.dumps({"_note": {"vi": "x"}, "xe đạp": {"vi": "XE", "pos": "VERB"}, "mới": "mới tinh"}, ensure_ascii=False, indent=1), encoding="utf-8")
    lex = {r["gloss"]: r for r in io.load_lexicon(spark, str(p), G.lexicon(spark, {"XE-ĐẠP": ("xe đạp", "NOUN", None), "TÔI": ("tôi", "PRON", None)})).collect()}
    assert lex["XE-ĐẠP"]["vi"] == "XE" and lex["XE-ĐẠP"]["pos"] == "VERB" and lex["MỚI"]["pos"] is None and lex["TÔI"]["vi"] == "tôi"
    assert len(lex) == 3


def test_frames_round_trip_and_reports(spark, tmp_path):
    f = frames(spark, {"a": person(5)}).withColumn("split", F.lit("train"))
    io.write_frames(f, str(tmp_path / "f"))
    back = io.read_frames(spark, str(tmp_path / "f"))
    a, b = f.orderBy("frame_idx").collect(), back.orderBy("frame_idx").collect()
    assert len(b) == 5 and np.allclose([r["pose"] for r in a], [r["pose"] for r in b], atol=1e-6)
    holes = spark.createDataFrame([(None, None)], "pose array<double>, pose_ok boolean")
    r = io.with_default_points(holes).first()
    assert r["pose"] == [0.0] * 18 and r["pose_ok"] is False
    for _ in range(2):
        io.append_json(spark.createDataFrame([(1.0, "A", 0.9, 0.5, 30)], io.EMISSION_SCHEMA), str(tmp_path / "log"))
    assert spark.read.schema(io.EMISSION_SCHEMA).json(str(tmp_path / "log")).count() == 2


def test_orphans_and_required_folds(sixty, spark):
    have = spark.createDataFrame([(f"x{i}.npz",) for i in range(58)], "npz string")
    assert {r["npz"] for r in M.orphans(sixty, have).collect()} == {"x58.npz", "x59.npz"}
    M.require_train_and_test(sixty)
    with pytest.raises(ValueError):
        M.require_train_and_test(sixty.filter("split <> 'test'"))


def _greedy(counts, n):
    loads, out = [0] * n, {}
    for label, clips in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        s = min(range(n), key=lambda i: (loads[i], i))
        out[label], loads[s] = s, loads[s] + clips
    return out


@pytest.mark.parametrize("seed", range(30))
def test_level_plan_is_the_greedy_walk(seed):
    r = random.Random(seed)
    n = r.randint(1, 7)
    counts = {f"l{i:03}": r.choice([0, 1, 1, 2, 3, 7, r.randint(1, 200)]) for i in range(r.randint(1, 120))}
    sizes = sorted(Counter(counts.values()).items(), reverse=True)
    plan, got = M.level_plan(sizes, n), {}
    for clips, _ in sizes:
        own = [(first, cycle) for c, first, cycle in plan if c == clips]
        for k, label in enumerate(sorted(x for x, c in counts.items() if c == clips)):
            first, cycle = [x for x in own if x[0] <= k][-1]
            got[label] = cycle[(k - first) % len(cycle)]
    assert got == _greedy(counts, n) and len(plan) <= len(sizes) * (n + 1)


def test_shards_and_numbers_of_many_labels(spark):
    r = random.Random(4)
    counts = {f"{r.choice('aàbßZ')}{i}": r.choice([1, 1, 1, 1, 2, 5, 90]) for i in range(1500)}
    d = spark.createDataFrame([(x,) for x, c in counts.items() for _ in range(c)], "label string")
    assert {x["label"]: x["shard"] for x in M.balanced_shards(d, 5).collect()} == _greedy(counts, 5)
    assert {x["label"]: x["idx"] for x in M.label_map(d).collect()} == {x: i for i, x in enumerate([*sorted(counts), L.NOSIGN])}
    assert M.label_map(d.limit(0)).collect()[0]["idx"] == 0 and M.balanced_shards(d.limit(0), 3).count() == 0


def test_report_is_one_document(spark, tmp_path):
    path = str(tmp_path / "report.json")
    rows = spark.createDataFrame([(i, f'a "quoted"\nname {i}', None if i % 3 else 0.5) for i in range(200)], "id long, name string, wer double")
    for n in (200, 3, 0):
        io.write_report(spark.createDataFrame([(0.25, n)], "wer double, n long"), rows.filter(F.col("id") < n), "id", path)
        parts = sorted(x for x in (tmp_path / "report.json").iterdir() if x.name.startswith("part-"))
        whole = json.loads("".join(x.read_text() for x in parts))
        assert whole["summary"] == {"wer": 0.25, "n": n} and [v["id"] for v in whole["per_video"]] == list(range(n))
        summary, back = io.read_report(spark, path, "wer double, n long", "id long, name string, wer double")
        assert summary.collect() == [(0.25, n)] and sorted(back.collect()) == sorted(rows.filter(F.col("id") < n).collect())
    assert [x.name for x in tmp_path.iterdir()] == ["report.json"]


def test_half_precision_is_numpys(spark):
    r = np.random.default_rng(3)
    v = np.concatenate([r.normal(size=300) * 10.0 ** r.integers(-9, 6, 300), 2.0 ** np.arange(-27.0, 17), -(2.0 ** np.arange(-27.0, 17)), [0, 65504, 65519.9, 65520, 1e9, -1e9, 1 / 3, 2049, 2051, np.inf, -np.inf, 2.0**-14 - 2.0**-25]])
    with np.errstate(over="ignore"):
        want = v.astype(np.float16)
    h = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, x double").withColumn("h", io.to_half(F.col("x")))
    got = h.withColumn("y", io.from_half(F.col("h"))).orderBy("i").collect()
    assert [g["y"] for g in got] == want.astype(float).tolist()
    assert [g["h"] & 0x7FFF for g in got] == (want.view(np.uint16) & 0x7FFF).tolist()
    assert np.isnan(spark.createDataFrame([(float("nan"),)], "x double").select(io.from_half(io.to_half(F.col("x")))).first()[0])


def test_a_split_is_read_alone(spark, tmp_path):
    f = frames(spark, {"c": person(5)})
    for mode, tag in (("overwrite", "train"), ("append", "test")):
        io.write_frames(io.with_split_tag(f, tag), str(tmp_path / "f"), half=True, mode=mode)
    one = io.read_frames(spark, str(tmp_path / "f"), "test")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and one.count() == 5
    assert np.allclose(one.orderBy("frame_idx").first()["pose"], person(5)["pose"][0].ravel(), atol=1e-3)
    assert io.read_frames(spark, str(tmp_path / "f")).count() == 10


def test_incremental_load(spark, tmp_path):
    name = "processed_test"
    P.processed_table(spark, name, str(tmp_path / "t"), "id bigint, v string", "id", 8)
    rows = spark.range(100).select("id", F.lit("x").alias("v"))
    P.load_run(rows.filter("id < 30"), name, "id", "a")
    for _ in range(2):
        P.load_run(rows, name, "id", "b")
    P.load_run(rows.filter("id < 30"), name, "id", "a")
    assert {(r["run_id"], r["count"]) for r in spark.table(name).groupBy("run_id").count().collect()} == {("a", 30), ("b", 70)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = P.not_in_table(spark.range(120).toDF("id"), name, "id", "c")
        assert new.count() == 20
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(id#") and "SortMergeJoin" in plan
        processed = plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")]
        assert "Exchange" not in processed.split("Filter")[-1] and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"drop table {name}")
    P.processed_table(spark, name, str(tmp_path / "t"), "id bigint, v string", "id", 8)
    assert spark.table(name).count() == 100
    spark.sql(f"drop table {name}")


def test_lists_keep_their_order_over_files(spark, tmp_path):
    for k, lines in enumerate((["# head", "one", "", " two "], ["three"] * 1, [f"n{i}" for i in range(500)])):
        (tmp_path / f"part-{k}.txt").write_text("\n".join(lines) + "\n")
    got = [r["value"] for r in io.read_list(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == ["one", "two", "three", *[f"n{i}" for i in range(500)]]

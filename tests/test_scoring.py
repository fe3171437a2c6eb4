import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.functions import layout as L
from seqloom.operators import evaluation as E
from seqloom.operators import neardup as N
from seqloom.operators import scoring as C
from seqloom.plans.scoring import LETTERS, letter_freq, letter_vectors

SCHEMA = "clip_id int, run string, y int, pred int, prob array<double>"


def preds(spark, rows, run="r"):
    return spark.createDataFrame([(i, run, y, int(np.argmax(p)), p) for i, (y, p) in enumerate(rows)], SCHEMA)


def test_softmax(spark):
    d = spark.createDataFrame([([1000.0, 1000.0, 0.0],), ([2.0],)], "z array<double>")
    got = [r[0] for r in d.select(C.softmax(F.col("z"))).collect()]
    assert np.allclose(got[0], [0.5, 0.5, 0]) and got[1] == [1.0]


def test_macro_f1_label_sets(spark):
    """Class 2 is predicted but never true: it counts as 0 in the union."""
    m = E.eval_metrics(preds(spark, [(0, [0.9, 0.1, 0.0]), (0, [0.1, 0.0, 0.9]), (1, [0.0, 1.0, 0.0])])).first()
    assert m["acc"] == pytest.approx(2 / 3)
    assert m["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3) and m["macro_f1_true"] == pytest.approx((2 / 3 + 1) / 2)
    rep = {r["cls"]: r for r in E.per_class_report(preds(spark, [(0, [0.9, 0.1, 0.0]), (0, [0.1, 0.0, 0.9])])).collect()}
    assert rep[2]["support"] == 0 and rep[2]["precision"] == 0.0 and rep[0]["recall"] == 0.5


def test_truth_rank_ties_by_index(spark):
    p = preds(spark, [(2, [0.4, 0.3, 0.3]), (1, [0.4, 0.3, 0.3])])
    assert [r["true_rank"] for r in C.top_n(p, 1).orderBy("clip_id").collect()] == [3, 2]
    k = E.eval_metrics(p, k=2).first()["top5"]
    assert k == 0.5


def test_confidence_curve_stops(spark):
    c = {r["threshold"]: r for r in E.confidence_curve(preds(spark, [(0, [0.55, 0.45]), (0, [0.3, 0.7])])).collect()}
    assert max(c) == 0.7 and c[0.0]["n"] == 2 and c[0.55]["n"] == 2 and c[0.6]["n"] == 1 and c[0.6]["accuracy"] == 0.0


def test_gate(spark):
    p = preds(spark, [(0, [0.7, 0.3]), (0, [0.61, 0.39]), (0, [0.55, 0.45]), (1, [0.1, 0.9])])
    name = F.when(F.col("pred") == 1, L.NOSIGN).otherwise("A")
    assert [r["clip_id"] for r in C.gate(p.withColumn("name", name)).orderBy("clip_id").collect()] == [0, 1]
    single = preds(spark, [(0, [1.0])])
    assert C.with_margin(single).first()["margin"] == 1.0


def test_ensemble(spark):
    a = preds(spark, [(0, [0.6, 0.4]), (1, [0.6, 0.4])], "a")
    b = preds(spark, [(0, [0.6, 0.4]), (1, [0.1, 0.9])], "b")
    got = {r["clip_id"]: r["pred"] for r in C.ensemble(a.union(b), ["a", "b"]).collect()}
    assert got == {0: 0, 1: 1}
    with pytest.raises(Exception, match="disagree"):
        C.ensemble(a.union(b.filter("clip_id = 0")), ["a", "b"]).collect()


def test_run_reports(spark):
    m = spark.createDataFrame([("a", "provided", 0.5, 0.9, 1.0), ("b", "provided", 0.6, 0.91, 1.0), ("c", None, 0.99999, 0.99, 1.0)], "run string, split_mode string, acc double, macro_f1 double, top5 double")
    assert E.best_run(m).first()["run"] == "b"
    assert {r["run"]: r["split_mode"] for r in E.run_compare(m).collect()}["c"] == "?"


def test_metrics_files(spark, tmp_path):
    d = tmp_path / "runs" / "bilstm"
    d.mkdir(parents=True)
    (d / "test_metrics.json").write_text('{\n "split_mode": "provided",\n "acc": 0.5, "macro_f1": 0.4, "top5": 0.9}')
    r = E.read_metrics(spark, str(tmp_path / "runs" / "*" / "test_metrics.json")).first()
    assert r["run"] == "bilstm" and r["macro_f1"] == 0.4


def test_other_scorer(spark):
    rng = np.random.default_rng(0)
    rows = [(i, i % 2, (rng.normal(size=3) + (3 if i % 2 else -3)).tolist()) for i in range(80)]
    d = spark.createDataFrame(rows, "clip_id int, y int, vec array<double>").withColumn("run", F.lit("lr"))
    p = C.logistic_transform(C.fit_logistic(d, maxIter=5), d)
    q = C.fit_centroids(d, 3, 2, 1.0).transform(d)
    assert E.eval_metrics(p).first()["acc"] == 1.0 and E.eval_metrics(q).first()["acc"] == 1.0


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_nearest_against_all_pairs(spark, spread):
    """A label with most rows, a third of them copies, and planted near copies."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(1, 16)) + spread * rng.normal(size=(400, 16)) * rng.random((400, 1)) * 3
    vecs = np.concatenate([base, np.repeat(base[:1], 200, axis=0), base[1:40] + 1e-4])
    label = np.where(rng.random(len(vecs)) < 0.9, "hot", "cold")
    fold = np.where(rng.random(len(vecs)) < 0.3, "test", "train")
    d = spark.createDataFrame([(i, str(label[i]), str(fold[i]), vecs[i].tolist()) for i in range(len(vecs))], "clip_id int, label string, fold string, vec array<double>").repartition(6)
    got = {r["clip_id"]: r["dmin"] for r in N.nearest_in_label(d, 16).collect()}
    want = {}
    for i in np.flatnonzero(fold == "test"):
        tr = vecs[(fold == "train") & (label == label[i])]
        want[int(i)] = np.abs(tr - vecs[i]).mean(axis=1).min()
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_letters_of_long_texts_take_little_memory():
    """A batch of long texts is counted by pieces; a table over all its code points took some 40 bytes each."""
    texts = pd.Series(["zà" * 400_000 + "\U0001f600", None, "", "abc", "ABC ü"] * 4)
    tracemalloc.start()
    got = letter_freq.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000
    for text, freq in zip(texts, got):
        text = text or ""
        assert list(freq) == [text.count(x) / max(len(text), 1) for x in LETTERS]


def test_letters_of_a_batch_become_strings_by_slices():
    texts = [("zà" * 5_000 + "\U0001f600") * (i % 3) for i in range(1_500)] + [None, "", "ABC ü", "zà" * 700_000]
    column = pa.array(texts)
    tracemalloc.start()
    got = letter_vectors.func(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 < sum(len(t or "") for t in texts)
    assert got.to_pylist() == [list(f) for f in letter_freq.func(pd.Series(texts, dtype=object))]
    assert letter_vectors.func(column.slice(1_500, 3)).to_pylist() == got.to_pylist()[1_500:1_503]
    assert letter_vectors.func(column.slice(0, 0)).to_pylist() == []


def test_gate_scores_each_row_once(spark, capfd):
    """A filter on pred or prob was pushed below the scores, which were then worked out twice."""
    model = C.CentroidModel(np.array([[0.0, 1.0], [1.0, 0.0]]), 10.0)
    rows = spark.createDataFrame([(1, [0.0, 0.9]), (2, [0.5, 0.5])], "clip_id int, vec array<double>").repartition(2)
    gated = C.gate(model.transform(rows).withColumn("name", F.concat(F.lit("c"), F.col("pred").cast("string"))))
    gated.explain()
    assert capfd.readouterr().out.count("EvalPython") == 1
    assert [r.clip_id for r in gated.collect()] == [1]

"""Nearest vectors by pivots: exact on any data, few comparisons on clustered data."""

import numpy as np
import pytest

from seqloom.operators import metric_index as M
from seqloom.operators import neardup as N

DIMS = 12


def _clips(spark, kind, n, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, DIMS)) * 5
    rows = []
    for i in range(n):
        label, fold = ("hot" if r.random() < 0.7 else f"l{i % 3}"), ("test" if r.random() < 0.3 else "train")
        v = centres[r.integers(0, 30)] + r.normal(size=DIMS) * 0.1 if kind == "clustered" else r.normal(size=DIMS) if kind == "uniform" else np.round(r.normal(size=DIMS))
        rows.append((i, label, fold, v.tolist()))
    rows += [(n, "only test", "test", [0.0] * DIMS), (n + 1, "only train", "train", [0.0] * DIMS), (n + 2, "hot", "test", rows[0][3]), (n + 3, "hot", "test", rows[0][3])]
    return spark.createDataFrame(rows, "clip_id long, label string, fold string, vec array<double>")


@pytest.mark.parametrize("kind", ["clustered", "uniform", "grid"])
def test_equals_comparing_all(spark, kind):
    clips = _clips(spark, kind, 3000)
    want = {r.clip_id: r.dmin for r in N.nearest_in_label(clips, DIMS).collect()}
    got = M.nearest_by_pivots(clips, DIMS).collect()
    assert {r.clip_id: r.dmin for r in got} == want
    share = sum(r.compared for r in got if r.label == "hot") / sum(r.label == "hot" for r in got) / clips.filter("label = 'hot' and fold = 'train'").select("vec").distinct().count()
    print(kind, "share of the hot label's training vectors compared:", round(share, 3))
    assert share <= (0.25 if kind == "clustered" else 1)


def test_bounds_hold():
    r = np.random.default_rng(5)
    x, p, q = r.normal(size=(200, DIMS)), r.normal(size=(5, DIMS)), r.normal(size=(40, DIMS))
    to = M.distances(x, p)
    cell = to.argmin(1)
    real = M.distances(q, x)
    bound = M.ring_bounds(M.distances(q, p), cell, to.min(1), to.min(1))
    assert (bound <= real).all()


def test_no_rows(spark):
    assert M.nearest_by_pivots(_clips(spark, "grid", 10).limit(0), DIMS).count() == 0


def test_no_vector_is_sent_to_each_ring(spark):
    """Uniform vectors ask nearly all rings of their label; each is sent once to a part of them."""
    clips = _clips(spark, "uniform", 3000).cache()
    clips.count()
    sent = lambda: sum(e.totalShuffleWrite() for e in _executors(spark))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent()
        assert M.nearest_by_pivots(clips, DIMS).count() > 800
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        times = (sent() - before) / (clips.count() * DIMS * 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    print("bytes through shuffles, times the vectors' own:", round(times, 1))
    assert times < 25


def _executors(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return [found.apply(i) for i in range(found.size())]


def test_parts_and_shelves_lose_no_vector(spark, monkeypatch):
    """Rings that lie in several shelves, and parts of several shelves."""
    clips = _clips(spark, "grid", 2000).unionByName(_clips(spark, "clustered", 2000, 2).selectExpr("clip_id + 100000 as clip_id", "label", "fold", "vec"))
    want = {r.clip_id: r.dmin for r in N.nearest_in_label(clips, DIMS).collect()}
    monkeypatch.setattr(M, "SHELF", 7)
    for parts in (3, 64):
        monkeypatch.setattr(M, "PARTS", parts)
        assert {r.clip_id: r.dmin for r in M.nearest_by_pivots(clips, DIMS).collect()} == want

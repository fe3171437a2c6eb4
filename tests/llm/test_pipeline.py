"""The pipeline and the registered queries on the smallest tables."""

import os

import pytest

import corpus_pipeline
from seqloom.llm.common import written
from seqloom.llm.queries import QUERIES, SQL
from tests.llm import helpers as H

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_thirteen_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "repeats", "best_fit_packing"]


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, seen, SF), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in seen.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count()
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in set(before) - set(after)) <= 1
        if name == "near_duplicates":
            ids = sorted(before)
            classes = H.classes_by_force([before[i] for i in ids])
            assert set(after) == {ids[c] for c in classes}
        if name == "repeats":
            ids = sorted(before)
            for i, want in zip(ids, H.repeats_by_force([before[i] for i in ids], 200)):
                assert 0 <= len(after[i].encode()) - (want[0] - want[1]) <= 6 * want[2]
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF)
    assert packed.select("doc_id").distinct().count() == seen.count()
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_pipeline_without_rows_and_with_awkward_ones(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, rows in (("none", docs.limit(0)), ("awkward", H.awkward(spark))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        # of the awkward rows only the long text passes the quality rules
        assert sorted({r.doc_id for r in out}) == ([] if name == "none" else [2])

"""Language spans: the path against plain Viterbi, held-out accuracy, scripts, mixed texts, awkward rows."""

import random
import zlib

import numpy as np
import pytest

from seqloom.llm import language_spans as S
from tests.llm import helpers as H


def _viterbi_by_force(scores, switch):
    best, back = scores[0].copy(), []
    for x in scores[1:]:
        came = [j if best[j] >= best.max() - switch else int(best.argmax()) for j in range(len(x))]
        back.append(came)
        best = np.array([max(best[j], best.max() - switch) + x[j] for j in range(len(x))])
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def _value(scores, path, switch):
    return scores[np.arange(len(path)), path].sum() - switch * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("seed", range(8))
def test_chunks_give_the_path_of_one_pass(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(2, 6))
    sizes = [0, 1, 2, S.CHUNK, S.CHUNK + 1, 3 * S.CHUNK, 1000, 0, *r.integers(0, 400, 10)]
    ends = np.cumsum(sizes)
    starts = ends - sizes
    scores = np.round(r.normal(size=(ends[-1], k)) * 2, 3)
    path = S.viterbi(scores, starts, ends, 1.5)
    for a, b in zip(starts, ends):
        if a < b:
            assert _value(scores[a:b], path[a:b], 1.5) == pytest.approx(_value(scores[a:b], _viterbi_by_force(scores[a:b], 1.5), 1.5))
            assert path[a:b].tolist() == _viterbi_by_force(scores[a:b], 1.5)


SYLLABLES = {"aa": "ka ro mi ta ne lu", "bb": "schu gel ber ung ten ach", "cc": "ция про ние ско гра вед", "dd": "про ска вел мир ощи тру"}


def _prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def _corpus(spark, n=400, seed=1):
    r = random.Random(seed)
    return H.docs_frame(spark, [_prose(r, list(SYLLABLES)[i % 4], r.randint(3, 60)) for i in range(n)]).withColumn("lang", S.F.expr("element_at(array('aa', 'bb', 'cc', 'dd'), cast(doc_id % 4 + 1 as int))"))


@pytest.fixture(scope="module")
def model(spark):
    return S.fit(_corpus(spark))


def test_held_out_accuracy(spark, model):
    docs = _corpus(spark)
    rows = S.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out) and all(0 < r.score <= 1 for r in rows)


def test_held_out_rows_and_sources_are_never_read(spark):
    docs = _corpus(spark, 120)
    other = docs.withColumn("lang", S.F.when(S._held_out(), "zz").otherwise(S.F.col("lang"))).withColumn("text", S.F.when(S._held_out(), "x").otherwise(S.F.col("text"))).withColumn("source", S.F.lit(None))
    a, b = S.fit(docs), S.fit(other)
    assert a.langs == b.langs == list(SYLLABLES) and (a.table == b.table).all()


def test_spans_of_mixed_texts(spark, model):
    r = random.Random(9)
    parts = [_prose(r, lang, 15) for lang in ("aa", "bb", "cc", "aa")]
    text = ". ".join(parts) + " 12 ИİX!"
    (row,) = S.spans(H.docs_frame(spark, [text]), model).collect()
    assert [s["lang"] for s in row.spans][:4] == ["aa", "bb", "cc", "aa"]
    assert [text[s["first"] : s["last"]] for s in row.spans][:3] == parts[:3]
    assert sum(s["letters"] for s in row.spans) == sum(c.isalpha() for c in text)
    assert model.admitted[S.SCRIPT_NAMES.index("Cyrillic")].tolist() == [False, False, True, True]
    assert S.identify(H.docs_frame(spark, ["карма " * 3, "ελληνικά"]), model).orderBy("doc_id").collect()[0].lang_pred in ("cc", "dd")


def test_awkward_rows(spark, model):
    out = {r.doc_id: r for r in S.identify(H.awkward(spark), model).collect()}
    assert S.identify(H.awkward(spark), model).count() == 8
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (0, 1, 4)) and out[2].lang_pred in SYLLABLES
    assert out[None].held_out is False
    assert S.identify(H.none(spark), S.fit(H.none(spark))).count() == 0
    blind = S.identify(H.docs_frame(spark, ["word", None]), S.fit(H.none(spark))).collect()
    assert all(r.lang_pred == "und" for r in blind)
    assert [r.spans for r in S.spans(H.docs_frame(spark, ["", None, "123"]), model).collect()] == [[], [], []]


def test_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = S.identify(docs, S.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows)

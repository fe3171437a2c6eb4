import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions import text as X
from seqloom.functions.text import edit_counts, token_norm
from seqloom.operators import gloss as G
from seqloom.plans.text import REGISTRY
from tests.oracle import compare


def slow_edits(ref, hyp):
    """Plain dynamic programme over tuples (cost, sub, del, ins)."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]
    for i, r in enumerate(ref, 1):
        new = [(i, 0, i, 0)]
        for j, h in enumerate(hyp, 1):
            c, s, d, n = row[j - 1]
            sub = (c + (r != h), s + (r != h), d, n)
            c, s, d, n = row[j]
            dele = (c + 1, s, d + 1, n)
            c, s, d, n = new[j - 1]
            ins = (c + 1, s, d, n + 1)
            new.append(min([sub, dele, ins], key=lambda x: x[0]))
        row = new
    return row[-1][1:]


def test_known_pairs():
    got = edit_counts([list("ABC"), list("ABC"), list("AC"), [], list("AB"), []], [list("AXC"), list("AC"), list("ABC"), list("AB"), [], []])
    assert got.tolist() == [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 2], [0, 2, 0], [0, 0, 0]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9)), min_size=1, max_size=6))
def test_edit_counts_match_plain_dp(pairs):
    got = edit_counts([r for r, _ in pairs], [h for _, h in pairs])
    assert [tuple(x) for x in got.tolist()] == [slow_edits(r, h) for r, h in pairs]


def test_long_texts_in_full():
    rng = np.random.default_rng(0)
    r, h = rng.integers(0, 9, 700).astype(str).tolist(), rng.integers(0, 9, 650).astype(str).tolist()
    assert tuple(edit_counts([r], [h])[0]) == slow_edits(r, h)


def test_wer_reports(spark):
    p = spark.createDataFrame([(1, list("ABC"), list("AXC")), (2, list("AB"), []), (3, [], list("A"))], "id int, ref array<string>, hyp array<string>")
    e = G.with_edit_ops(p)
    assert {r["id"]: r["wer"] for r in G.pair_wer(e).collect()} == {1: 0.333, 2: 1.0, 3: 1.0}
    c = G.corpus_wer(e).first()
    assert (c["wer"], c["sub"], c["dele"], c["ins"], c["ref_words"]) == (0.8, 1, 2, 1, 5)


@pytest.mark.parametrize("key", ["edit_ops", "wer_per_pair", "wer_corpus", "wer_report"])
def test_sharp_s_and_white_space_agree_with_sql(spark, tmp_path, key):
    texts = ["Straße 10", "STRASSE 10", "strasse", " \n", "\x0b a\x0bß ", "a SS"]
    pd.DataFrame({"conv_id": 1, "turn": range(len(texts)), "text": texts}).to_parquet(tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    ok, info = compare(spark, con, key, *REGISTRY[key], str(tmp_path))
    assert ok, info


def _same(words: str, pos: str, tense: str | None = None) -> dict:
    """Entries written like their gloss, in lower case without hyphens."""
    return {w: (w.lower().replace("-", " "), pos, tense) for w in words.split()}


LEXICON = {
    **_same("TÔI BẠN", "PRON"), **_same("HÔM-QUA", "TIME", "past"), **_same("HÔM-NAY", "TIME", "pres"), **_same("NGÀY-MAI", "TIME", "fut"), **_same("SÁNG", "TIME"),
    **_same("ĐI ĂN UỐNG HỌC", "VERB"), **_same("CHỢ HỌC-SINH", "NOUN"), **_same("MỆT", "ADJ"), **_same("KHÔNG CHƯA", "NEG"), **_same("GÌ", "WH"),
}

CASES = {
    "HÔM-QUA TÔI ĐI CHỢ": "Hôm qua tôi đã đi chợ.",
    "TÔI ĐI KHÔNG": "Tôi không đi.",
    "BẠN ĂN GÌ": "Bạn ăn gì?",
    "NGÀY-MAI TÔI HỌC": "Ngày mai tôi sẽ học.",
    "TÔI HỌC-SINH": "Tôi là học sinh.",
    "TÔI MỆT KHÔNG": "Tôi không mệt.",
    "XYZ-LẠ": "Xyz lạ.",
    "CHỢ TÔI HÔM-NAY ĐI": "Hôm nay chợ tôi đi.",
    "TÔI CHỢ KHÔNG": "Tôi là chợ không.",
    "HÔM-QUA TÔI ĐI CHỢ CHƯA KHÔNG": "Hôm qua tôi chưa đi chợ.",
    "__NOSIGN__": "",
    "HÔM-QUA SÁNG ĂN UỐNG": "Hôm qua sáng đã ăn uống.",
}


def test_sentences(spark):
    rows = [(s, i, g) for s in CASES for i, g in enumerate(s.split())]
    t = spark.createDataFrame(rows, "s string, pos int, gloss string").repartition(5)
    got = {r["s"]: r["sentence"] for r in G.translate(t, G.lexicon(spark, LEXICON), ["s"], "pos").collect()}
    assert got == CASES


def test_no_tense_option(spark):
    t = spark.createDataFrame([("a", 0, "HÔM-QUA"), ("a", 1, "ĐI")], "s string, pos int, gloss string")
    assert G.translate(t, G.lexicon(spark, LEXICON), ["s"], "pos", insert_tense=False).first()["sentence"] == "Hôm qua đi."


@pytest.mark.parametrize("raw,want", [(" Xe  đạp ", "XE-ĐẠP"), ("a\tb\nc", "A-B-C"), ("", "")])
def test_token_norm(spark, raw, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "g string").select(token_norm(F.col("g"))).first()[0] == want


def test_false_alarms(spark):
    streams = spark.createDataFrame([("a", 1500, 25.0), ("b", 1500, 25.0)], "stream_id string, n_frames long, fps double")
    em = spark.createDataFrame([("a",), ("a",), ("a",), ("zz",)], "stream_id string")
    r = G.false_alarms(em, streams).first()
    assert (r["emitted"], r["idle_minutes"], r["false_per_min"]) == (3, 2.0, 1.5)


def test_case_list_is_unique():
    assert len(set(itertools.chain(CASES))) == len(CASES)


def _changed(r, a, edits, alphabet):
    b = a.copy()
    for _ in range(edits):
        at = int(r.integers(0, max(len(b), 1)))
        b = [np.delete(b, at) if len(b) else b, np.insert(b, at, r.integers(0, alphabet)), np.concatenate([b[:at], [r.integers(0, alphabet)], b[at + 1 :]])][int(r.integers(0, 3))]
    return b.astype(np.int64)


def _table(a, b):
    return tuple(X._edit_block(np.concatenate([a, b]), np.array([0]), np.array([len(a)]), np.array([len(a)]), np.array([len(b)]))[0].tolist())


@pytest.mark.parametrize("kept", [1, 3, 256])
def test_frontiers_follow_the_ties_of_the_table(kept, monkeypatch):
    monkeypatch.setattr(X, "_KEPT", kept)
    r = np.random.default_rng(kept)
    for _ in range(400):
        alphabet = int(r.integers(1, 5))
        a = r.integers(0, alphabet, r.integers(0, 30))
        b = _changed(r, a, int(r.integers(0, 7)), alphabet) if r.random() < 0.7 else r.integers(0, alphabet, r.integers(0, 30))
        assert X.edit_frontier(a, b) == _table(a, b)


def test_large_pairs_of_any_distance():
    r = np.random.default_rng(9)
    a = r.integers(0, 40, 900)
    pairs = [(a, _changed(r, a, 30, 40)), (a, r.integers(0, 40, 700)), (a[:0], a), (a, a)]
    got = X.edit_counts([list(map(str, x)) for x, _ in pairs], [list(map(str, y)) for _, y in pairs])
    assert [tuple(g) for g in got.tolist()] == [_table(x, y) for x, y in pairs]


def test_two_million_tokens_cost_their_distance():
    r = np.random.default_rng(4)
    a = r.integers(0, 50, 2_000_000)
    b = np.insert(np.delete(a, [5, 1000, 1_500_000]), [77, 1_999_000], [99, 98])
    b[500_000] = 97
    assert X.edit_frontier(a, b) == (1, 3, 2)


def test_sweep_solves_a_group_once_for_each_change(spark, monkeypatch):
    """Edits are counted for changes of a group's accepted rows, not for every threshold; the sums are those of every threshold."""
    r = np.random.default_rng(6)
    rows = [(g, i, int(r.integers(0, 3)), int(r.integers(0, 3)), float(r.choice([0.1, 0.35, 0.35, 0.62, 0.9]))) for g in range(6) for i in range(5)] + [(9, 0, 1, 1, None)]
    scored = spark.createDataFrame(rows, "g int, i int, y int, pred int, conf double")
    grid = [round(0.05 * k, 2) for k in range(20)]
    solved = []
    monkeypatch.setattr(G, "with_edit_ops", lambda pairs, f=G.with_edit_ops: solved.append(pairs.count()) or f(pairs))
    got = {x.threshold: (x["sub"], x.dele, x.ins, x.ref_words) for x in G.threshold_sweep(scored, grid, "g", "i").collect()}
    assert solved[0] <= 7 * 5 and set(got) == set(grid)
    for t in grid:
        ops = edit_counts([[str(y) for g, _, y, _, _ in rows if g == k] for k in (*range(6), 9)], [[str(p) for g, _, _, p, c in rows if g == k and c is not None and c >= t] for k in (*range(6), 9)])
        assert got[t] == (*ops.sum(0).tolist(), len(rows))

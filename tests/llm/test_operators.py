"""Each operator against brute force or an exact round trip, and on awkward tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from seqloom.llm import common, dart_minhash, html_layout, id_coder, id_files, line_rules, multi_index, packing, prefix_free, quotations, toxicity, tree_bpe
from seqloom.llm.common import components
from seqloom.llm.vocab import piece_encoder, public_tokenizer
from tests.llm import helpers as H

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(203, 201), (202, 203), (201, 202), (None, 5), (7, 7)]
    found = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {201: 201, 202: 201, 203: 201}
    assert {k: v for k, v in found.items() if k != v} == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1. repeats


def test_repeats_equal_brute_force(spark):
    texts = H.varied_texts()
    got = prefix_free.removals(H.docs_frame(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == H.repeats_by_force(texts)


def test_repeats_of_other_lengths_equal_brute_force(spark):
    texts = H.varied_texts(60, 9)
    for length in (200, 60):
        keys, spans = prefix_free.repeats(H.docs_frame(spark, texts), length)
        spans = {r.doc_id: r.spans for r in keys.join(spans, ["k1", "k2"]).select("doc_id", "spans").collect()}
        found = [(sum(s[1::2]) - sum(s[::2]), len(s) // 2) for s in (spans.get(i) or [] for i in range(len(texts)))]
        assert found == [w[1:3] for w in H.repeats_by_force(texts, length)]


def test_repeats_stage_takes_passages_of_51_words(spark):
    """A passage of 51 words and about 250 bytes goes; columns may have the operator's own names."""
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i % 7}x{i}" for i in range(51))
    assert 200 < len(passage) < 300
    texts = [" ".join(f"a{d}y{i}" for i in range(60)) + f" {passage} " + " ".join(f"{d}b{i}" for i in range(60)) for d in range(4)] + [None, "", "short"]
    docs = H.docs_frame(spark, texts).withColumns({c: F.lit("x") for c in ("k2", "s1", "s2", "spans", "_k1", "_spans", "bad", "text_hash", "k0", "w1", "d")})
    out = {r.doc_id: r.text for r in prefix_free.without_repeats(docs).collect()}
    assert all(passage not in out[d] and f"a{d}y5" in out[d] and f"{d}b0" in out[d] for d in range(4))
    assert out[4] is None and out[5] == "" and out[6] == "short"
    assert line_rules.clean(docs).columns == docs.columns and line_rules.clean(docs).count() == 4
    kept = dart_minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 7
    assert prefix_free.without_repeats(H.none(spark)).count() == 0 and dart_minhash.without_near_duplicates(H.none(spark)).count() == 0


def test_repeats_on_awkward_rows(spark):
    got = prefix_free.removals(H.awkward(spark)).collect()
    assert len(got) == 8 and sum(r.n_bytes == 0 for r in got) == 2
    long = next(r for r in got if r.doc_id == 2)
    assert long.n_removed == 0 and len({r.kept_sha256 for r in got if r.doc_id == 3}) == 1
    assert prefix_free.removals(H.none(spark)).count() == 0


def test_repeats_stage_keeps_columns_and_characters(spark):
    passage = "é" * 150 + "passage " * 40
    docs = H.docs_frame(spark, ["ü" + passage + "ö end", "ä" + passage + "ß other"])
    out = prefix_free.without_repeats(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "üö end" and rows[1].text == "äß other" and rows[0].n_chars == len(rows[0].text)


# 2. quotations


def test_replies_follow_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow does it work?\nAlso, what of costs?"),
        (1, 1, "assistant", "user wrote:\n> How does it work?\nIt works so."),
        (1, 2, "other", "> Also, what of   costs?\n\nIt costs nothing."),
        (1, 3, "user", "assistant wrote:\n>> How does it work?\n> It works so.\nThanks!"),
        (1, 4, "x", "next after thanks"),
        (1, 5, "y", ">hello THERE.\nhi"),
        (2, 0, "user", None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, None, "> unknown"), (None, None, "u", "x > y"),
    ]
    out = quotations.reply_order(spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, row long, place long")).collect()
    one = sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)
    assert [(r.turn, r.reply_to) for r in one] == [(0, None), (1, 0), (3, 1), (4, 3), (2, 0), (5, 0)]
    assert one[1].text == "It works so." and one[2].text == "Thanks!" and one[2].max_level == 2 and one[2].n_found == 2
    assert one[4].chat == "<|other|>\nIt costs nothing.\n<|end|>\n"
    assert len(out) == len(rows) and sum(r.conv_id is None for r in out) == 2
    assert [r.text for r in out if r.conv_id is None and r.turn == 0] == [""]


def test_a_long_plain_conversation_needs_no_rounds(spark):
    docs = spark.createDataFrame([(1, i, "u", f"message {i}") for i in range(3000)], "conv_id long, turn long, role string, text string")
    out = quotations.reply_order(docs)
    assert out.where("position <> turn + 1 or depth <> 0").count() == 0
    assert quotations.reply_order(docs.limit(0)).count() == 0


def test_quotes_are_found_across_line_breaks_and_inside_lines(spark):
    first = "The first point is that nobody ever measured how long the second stage takes on a cold start of the whole machine."
    rows = [
        (1, 0, "a", first), (1, 1, "b", "Something else entirely, yes.\nyes"),
        (1, 2, "c", "> The first point is that nobody ever measured\n> how long the second stage takes on a cold\n> start of the whole machine.\n> yes\nI did."),
        (1, 3, "d", "> how long the second stage takes\nAn hour."),
        (1, 4, "e", "> nobody ever said this\n> at all\nno"),
        (2, 0, "a", "one two\nthree four five"), (2, 1, "b", "x"), (2, 2, "c", "> one two three four five\ny"),
        (3, 0, "a", "漢字仮名交文章改行"), (3, 1, "b", "x"), (3, 2, "c", "> 漢字仮名交\n> 文章改行\ny"),
    ]
    out = {(r.conv_id, r.turn): r for r in quotations.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(out[1, t].reply_to, out[1, t].n_quoted, out[1, t].n_found) for t in (2, 3, 4)] == [(0, 4, 4), (0, 1, 1), (3, 2, 0)]
    assert (out[2, 2].reply_to, out[2, 2].n_found) == (0, 1) and (out[3, 2].reply_to, out[3, 2].n_found) == (0, 2)
    assert out[1, 2].text == "I did."


def test_interleaved_threads_of_any_length_are_in_preorder(spark):
    """Every message quotes the one before the last, so each starts a branch."""
    n = 300
    rows = [(c, i, "u", (f"> line {i - 2} of conversation {c} here\n" if i > 1 else "> line 3 of conversation 1 here\n" if i == 250 else "") + f"line {i} of conversation {c} here") for c in (1, None) for i in range(n)]
    out = quotations.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in (1, None):
        one = sorted((r for r in out if r.conv_id == c), key=lambda r: r.position)
        parent = {i: None if i == 0 else max(i - 2, 0) for i in range(n)}
        children = {i: [j for j in range(n) if parent[j] == i] for i in range(n)}
        want, left = [], [(0, 0)]
        while left:
            i, depth = left.pop()
            want.append((i, parent[i], depth))
            left += [(j, depth + (j != i + 1)) for j in reversed(children[i])]
        assert [(r.turn, r.reply_to, r.depth) for r in one] == want and [r.position for r in one] == list(range(1, n + 1))


# 3. toxicity


def _labelled(spark, n=1200, seed=2):
    """Half of the toxic texts name a group; neutral texts rarely do."""
    r = random.Random(seed)
    neutral = [f"word{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        w = [r.choice(neutral) for _ in range(r.randint(5, 40))]
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["zorgly", "zorgler", "blimpic"]))
        if r.random() < (0.7 if toxic else 0.02):
            w.insert(r.randrange(len(w)), "muslims")
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic)))
    return H.docs_frame(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")


def test_classifier_is_accurate_and_steady_under_swaps(spark):
    docs, labels = _labelled(spark)
    steady = toxicity.fit(docs, labels)
    plain = toxicity.fit(docs, labels, steady=0.0)
    rows = toxicity.score(docs, steady).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.97
    change = [abs(m.score("word1 muslims word2") - m.score("word1 christians word2")) for m in (steady, plain)]
    assert change[0] < change[1] / 2
    assert steady.score("word1 muslims word2") < 0.3 < steady.score("word1 zorgly word2")
    assert toxicity.swapped({"muslims", "a"}) == {"christians", "a"}


def test_held_out_labels_are_never_read(spark):
    docs, labels = _labelled(spark, 400)
    flipped = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_toxicity_on_awkward_rows(spark):
    docs, labels = _labelled(spark, 400)
    model = toxicity.fit(docs, labels)
    out = toxicity.score(H.awkward(spark), model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out) and all(r.held_out is not None for r in out)
    kept = toxicity.without_toxic(H.awkward(spark), model)
    assert kept.columns == H.awkward(spark).columns and kept.count() == 8
    assert toxicity.score(H.none(spark), toxicity.fit(H.none(spark), labels)).count() == 0


# 4. embeddings


def test_multi_index_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = []
    for group in range(12):
        centre = r.normal(size=16)
        for _ in range(25):
            rows.append((len(rows), group % 3, [float(x) for x in centre + r.normal(size=16) * r.choice([0.01, 0.05, 0.3])]))
    rows += [(len(rows) + i, 1, rows[7][2]) for i in range(5)]
    rows += [(1000, 1, None), (1001, None, rows[0][2]), (1002, 1, [0.0] * 16), (1003, 1, [1.0, None] * 8), (1004, 1, [float("nan")] * 16), (1005, 1, []), (1006, 1, [1.0, 2.0]), (1007, 1, [2.0, 4.0]), (1008, 1, [float("inf"), 1.0])]
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, label int, embedding array<float>, node long, n long")
    got = {x.vec_id: (x.n_links, x.component_id) for x in multi_index.near_vectors(frame).collect()}
    rounded = [(i, y, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, y, v in rows]
    assert got == H.neighbours_by_force(rounded)
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_every_length_has_its_own_index(spark, monkeypatch):
    """Lengths with codebooks, lengths without, one huge vector; a hot label; links that one side alone would visit."""
    monkeypatch.setattr(multi_index, "LEAST_INDEXED", 100)
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    r = np.random.default_rng(8)
    rows = []
    for width, n in ((8, 260), (5, 120), (1, 12), (33, 20)):
        centres = r.normal(size=(n // 6 + 1, width))
        rows += [(len(rows) + i, "hot" if r.random() < 0.8 else f"l{i % 2}", (centres[r.integers(0, len(centres))] + r.normal(size=width) * r.choice([0.02, 0.1])).tolist()) for i in range(n)]
    rows += [(9000, "hot", [1.0] * 200_000), (9001, "hot", [1.0] * 199_999 + [2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id) for x in multi_index.near_vectors(frame).collect()}
    assert got == H.neighbours_by_force(rows)


def test_pairs_seen_from_one_side_count_for_both(spark, monkeypatch):
    """With a reach that misses many pairs, those seen at all are credited to both vectors, once."""
    monkeypatch.setattr(multi_index, "RECALL", 0.9)
    monkeypatch.setattr(multi_index, "LEAST_REACH", 0.0)
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    kept = {}
    monkeypatch.setattr(multi_index, "_grids", lambda *a, f=multi_index._grids: kept.setdefault("g", f(*a)))
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 8))
    x = centres[r.integers(0, 60, 900)] + r.normal(size=(900, 8)) * 0.08
    frame = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    got = {y.vec_id: y.n_links for y in multi_index.near_vectors(frame).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    grid = kept["g"][8]
    seen = grid.visited(unit, grid.cells(unit))
    near = (unit @ unit.T >= 0.98) & ~np.eye(900, dtype=bool)
    assert (near & (seen != seen.T)).any() and (near & ~(seen | seen.T)).any()
    assert [got[i] for i in range(900)] == (near & (seen | seen.T)).sum(1).tolist()


def test_a_vector_is_sent_once_to_each_row_it_visits(spark, monkeypatch):
    """Not once to each cell; a search takes a sorted stream of vectors, one long to sort by, and joins carry no lists of them."""
    monkeypatch.setattr(multi_index, "PER_CELL", 4)
    kept, plans = {}, {}
    monkeypatch.setattr(multi_index, "_grids", lambda *a, f=multi_index._grids: kept.setdefault("g", f(*a)))
    monkeypatch.setattr(multi_index, "drop_written", lambda *frames: None)

    def written(df, name, f=multi_index.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept.setdefault(name, f(df, name))

    monkeypatch.setattr(multi_index, "written", written)
    x = np.random.default_rng(4).normal(size=(2000, 8)).astype(np.float32)
    multi_index.near_vectors(spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>"))
    asks = {a.node: [(k.row, k.visits) for k in a.asks] for a in kept["assigned"].select("node", "asks").collect()}
    q, cell = kept["g"][8].visits(multi_index._unit(x.astype(float)))
    seen = {i: set() for i in range(2000)}
    for i, c in zip(q.tolist(), cell.tolist()):
        seen[i].add(c)
    assert {i: {c for _, cells in rows for c in cells} for i, rows in asks.items()} == seen
    assert all(len({r for r, _ in rows}) == len(rows) for rows in asks.values())
    assert sum(len(rows) for rows in asks.values()) < 0.5 * len(q)
    assert plans["found"].count("MapInArrow") == 1 and "collect_list" not in plans["found"] and "Sort [turn#" in plans["found"]
    final = plans["near-vectors"]
    assert "SortMergeJoin [hash#" in final and "exists(" not in final


def test_blocks_of_a_hot_row(spark, monkeypatch):
    """Rows of several blocks with and without codebooks, signed zeros, null ids beside their like, repeated rows."""
    monkeypatch.setattr(multi_index, "LEAST_INDEXED", 100)
    monkeypatch.setattr(multi_index, "BLOCK", 8)
    monkeypatch.setattr(multi_index, "BLOCK_BYTES", 0)
    r = np.random.default_rng(6)
    rows = [(i, "hot", (np.ones(6) + r.normal(size=6) * r.choice([0.02, 0.3])).tolist()) for i in range(300)]
    rows += [(300 + i, f"l{i % 2}", r.normal(size=3).tolist()) for i in range(60)]
    rows += [(400, "hot", [0.0, 1.0, 0.0]), (401, "hot", [-0.0, 2.0, 0.0]), (402, "hot", [-0.0, 1.0, -0.0])]
    rows += [(403 + i, "hot", rows[5][2]) for i in range(20)]
    expected = H.neighbours_by_force(rows)
    frame = spark.createDataFrame([*rows, (None, "hot", rows[5][2])], "vec_id long, label string, embedding array<double>")
    out = multi_index.near_vectors(frame).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in out} == expected | {None: (0, None)}
    assert len(out) == len(rows) + 1 and sum(x.kept for x in out) == len({c for _, c in expected.values()})


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars already are not linked anew; a chain takes rounds; no edge gives no row."""
    rounds = []
    monkeypatch.setattr(common, "written", lambda df, name, f=common.written: rounds.append(name) or f(df, name))

    def found(edges):
        rounds.clear()
        return dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect()), len(rounds)

    assert found([(1, 2), (3, 1), (2, 1), (7, 8), (5, 5), (None, 4)]) == ({2: 1, 3: 1, 8: 7}, 1)
    assert found([(9, 9), (None, 1)]) == ({}, 1)
    chain, n = found([(i, i + 1) for i in range(40)])
    assert chain == {i: 0 for i in range(1, 41)} and n > 1
    assert found([(2, 1), (2, 3), (4, 3)])[0] == {2: 1, 3: 1, 4: 1}


def test_recall_of_the_traversal(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = multi_index.Grid(x[:3000], 16)
    y = x + r.normal(size=x.shape) * 0.02
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = (x * y).sum(1) >= 0.98
    q, cell = grid.visits(x)
    visited = set(zip(q.tolist(), cell.tolist()))
    found = np.array([(i, c) in visited for i, c in enumerate(grid.cells(y).tolist())])
    assert near.sum() > 1000 and found[near].mean() >= 0.99
    assert len(q) < 0.5 * len(x) * 16 * 16


# 5. quality rules


def _hosts(spark):
    body = [" ".join(f"a{i}b{j}" for j in range(40)) for i in range(30)]
    texts = [f"{b}\nShared  Footer line\n{b.upper()[:60]}" for b in body[:15]] + [f"{b}\nshared footer LINE" for b in body[15:]]
    texts += ["shared footer line\n" * 12 + body[0]] + ["few words", "copy " * 40] + [body[3]] * 30
    return H.docs_frame(spark, texts)


def test_line_rules(spark):
    docs = _hosts(spark)
    out = {r.doc_id: r for r in line_rules.judge(docs).collect()}
    assert out[0].n_removed_words == 3 and out[0].kept and out[16].n_removed_words == 3
    assert not out[31].kept and out[31].base_failed
    assert out[32].base_failed and out[32].n_repeat_words == 40
    assert all(out[i].kept and out[i].n_removed_words == 0 for i in range(33, 63))  # copies aren't boilerplate
    clean = {r.doc_id: r for r in line_rules.clean(docs).collect()}
    assert "Footer" not in clean[0].text and clean[0].n_chars == len(clean[0].text) and 31 not in clean
    assert line_rules.clean(docs).columns == docs.columns


def test_shared_lines_go_however_much_of_a_page_they_are(spark):
    """40 pages of 90% shared lines are depleted; a footer goes although most texts with it are near copies."""
    shared = "\n".join(" ".join(f"nav{i}x{j}" for j in range(9)) for i in range(20))
    pages = [f"{shared}\n" + " ".join(f"own{i}x{j}" for j in range(20)) for i in range(40)]
    out = line_rules.judge(H.docs_frame(spark, pages)).collect()
    assert all(r.n_removed_words == 180 and not r.kept and not r.base_failed for r in out)
    normal = [" ".join(f"n{i}x{j}" for j in range(57)) + "\nthe shared footer" for i in range(20)]
    copied = "\n".join(" ".join(f"c{i}x{j}" for j in range(19)) for i in range(3))
    copies = [f"{copied}\nown{i}\nthe shared footer" for i in range(60)]
    rows = {r.doc_id: r for r in line_rules.judge(H.docs_frame(spark, normal + copies)).collect()}
    assert all(rows[i].n_removed_words == 3 and rows[i].kept for i in range(20))


def test_line_rules_equal_sql(spark):
    import duckdb

    shared = "\n".join(" ".join(f"nav{i}x{j}" for j in range(9)) for i in range(20))
    pages = [f"{shared}\n" + " ".join(f"own{i}x{j}" for j in range(20)) for i in range(40)]
    footers = [" ".join(f"n{i}x{j}" for j in range(57)) + "\nthe shared footer" for i in range(20)]
    docs = _hosts(spark).unionByName(H.awkward(spark)).unionByName(H.docs_frame(spark, H.varied_texts(40), 500))
    docs = docs.unionByName(H.docs_frame(spark, pages, 700, "pages")).unionByName(H.docs_frame(spark, footers, 800, "footers"))
    got = sorted(map(repr, (tuple(r) for r in line_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept").collect())))
    con = duckdb.connect()
    con.register("pdf", docs.toPandas())
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text, source from pdf")
    assert got == sorted(map(repr, con.execute(line_rules.SQL).fetchall()))
    assert line_rules.judge(H.none(spark)).count() == 0 and line_rules.clean(H.none(spark)).count() == 0


# 6. packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    r = random.Random(seed)
    capacity = r.choice([30, 100, 2048])
    counts = {k: r.randint(1, 50) for k in r.sample(range(1, capacity + 1), min(capacity, r.randint(3, 300)))}
    plan = packing.packing_plan(counts, capacity)
    bins, seen = {}, dict.fromkeys(counts, 0)
    for p in sorted(plan, key=lambda p: (p.length, p.first)):
        assert p.first == seen[p.length]
        seen[p.length] = p.last
        for i in range(p.last - p.first):
            bins.setdefault(p.sequence + i // p.per, []).append((p.offset + i % p.per * p.length, p.length))
    assert seen == counts
    for pieces in bins.values():
        pieces.sort()
        at = 0
        for offset, length in pieces:
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in pieces) <= 2
    need = -(-sum(k * n for k, n in counts.items()) // capacity)
    assert len(bins) <= 1.25 * max(need, sum(n for k, n in counts.items() if 2 * k > capacity)) + 1


def _ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids, 0]


def test_packed_pieces(spark):
    docs = H.docs_frame(spark, H.varied_texts(60)).unionByName(H.awkward(spark))
    rows = packing.pack(docs).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) % 2048 != 0
    texts = {r.doc_id: r.text for r in docs.where("doc_id > 5").collect()}
    for doc_id, text in texts.items():
        ids = np.array(_ids(text), "<u4")
        own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert packing.pack(H.none(spark)).count() == 0


# 7. byte-level BPE


def test_tree_equals_tiktoken():
    import tiktoken

    codec = tree_bpe.TreeBpe.from_file(public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, leaf_bytes=2)
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(0)
    alphabets = ["abcdefghij", "aeiou ntrs", "éèñ漢字\U0001f600ab", "0123456789", "!!--==__", "ab", "a", " \n\t", "the and ing er on"]
    for _ in range(500):
        a = r.choice(alphabets)
        text = "".join(r.choice(a) for _ in range(r.choice([0, 1, 5, 20, 60, 300])))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == whole.encode_ordinary(text)
    text = "a" * 5000 + "b" * 7 + "a" * 3001
    ids = np.frombuffer(codec.encode(text), "<u4").tolist()
    assert ids == whole.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_digests(spark):
    docs = H.awkward(spark)
    rows = tree_bpe.digests(tree_bpe.encode_documents(docs)).collect()
    assert len(rows) == 8
    long = docs.where("doc_id = 2").first().text
    assert next(r for r in rows if r.doc_id == 2).decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert next(r for r in rows if r.doc_id == 0).n_tokens == 0
    assert tree_bpe.encode_documents(H.none(spark)).count() == 0


def test_pieces_equal_whole_texts():
    encoder = piece_encoder(public_tokenizer("byte_bpe_50k.json"))
    r = random.Random(4)
    texts = ["".join(r.choice("ab é\n\t  .'s1　\xa0<|endoftext|>") for _ in range(r.randint(0, 60))) for _ in range(300)] + [None, " ", "  a", "a  ", " a b "]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [_ids(t)[:-1] for t in texts]


# 8. id files


@pytest.mark.parametrize("n", [1, 63, 64, 200, 70_000])
def test_blocks_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 65536, n), r.integers(0, 3, n), np.minimum(r.zipf(1.3, n), 50_000), np.zeros(n)):
        ids = ids.astype("<u4")
        data = id_coder.MAGIC + id_coder.encode_block(ids) + id_coder.encode_index([None, 7], [1, n - 1])
        block, (doc_ids, lengths) = id_coder.read_blocks(data)
        assert (block == ids).all() and doc_ids == [None, 7] and lengths.tolist() == [1, n - 1]
    damaged = bytearray(data)
    damaged[len(id_coder.MAGIC) + 30] ^= 1
    with pytest.raises(ValueError):
        list(id_coder.read_blocks(bytes(damaged)))


def test_predictable_ids_shrink():
    ids = np.tile(np.random.default_rng(0).integers(0, 50_000, 500), 400).astype("<u4")
    assert len(id_coder.encode_block(ids)) < len(ids) / 2


def test_id_files(spark):
    docs = H.docs_frame(spark, H.varied_texts(50), 10).unionByName(H.awkward(spark))
    rows = sorted(id_files.through_files(docs).collect(), key=lambda r: r.start)
    source = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    at = 0
    assert len(rows) == len(source)
    for r, d in zip(rows, source):
        ids = _ids(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert id_files.through_files(H.none(spark)).count() == 0


# 9. HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<title>x</title><p>One <b>two<p>three&nbsp;&amp; four", "One two\n\nthree\xa0& four"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul>", "- a\n- b\n  3. c\n  4. d\n- e"),
        ("<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>", "Cap\nName       Qty\napple pie  3"),
        ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
        ("<table><tfoot><tr><td>z</tfoot><tr><td colspan=2>wide<td>q<tr><td>a<td>b<td>c</table>", "wide  q\na  b  c\nz"),
        ("a<div hidden>no</div><div style='display: none'>no<p>no</div>b", "a\n\nb".replace("\n\n", "")),
        ("a<br>b<br><br>c<pre>\n x\n  y</pre>", "a\nb\n\nc\n\n x\n  y"),
        ('<script>var t="</p>";</script><!-- no --><a href="x>y">q</a>', "q"),
        ("<dl><dt>t<dd>d</dl><details><summary>s</summary>no</details>", "t\n  d\n\ns"),
        ("", ""), (None, ""), ("plain  text\nonly", "plain text only"), ("</b></p>x<", "x<"),
    ],
)
def test_layout(page, text):
    assert html_layout.render(page) == text


def test_letters_that_grow_in_lower_case_move_no_raw_end():
    assert html_layout.render("İ" * 20 + "<script>x</script><p>hello</p>") == "İ" * 20 + "\n\nhello"
    assert html_layout.render("İ" * 30 + "<SCRIPT>a</SCRIPT><Style>b</sTyle><textarea>İ c</TEXTAREA>d") == "İ" * 30 + "\nİ c\nd"


def test_deep_and_broken_pages(spark):
    assert html_layout.render("<div>" * 50_000 + "deep") == "deep"
    assert html_layout.render("<table>" * 3000 + "x") == "x"
    assert html_layout.render("<table>stray <b>text</b><tr><td>cell</table>") == "stray text\n\ncell"
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", None, 5), (2, None, "<p>x", 5)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.text) for r in html_layout.extract(pages).collect()) == [(1, ""), (1, ""), (2, "x")]
    assert html_layout.extract(pages.limit(0)).count() == 0


def test_elements_count_at_any_depth():
    down = "<font>" * 500
    assert html_layout.render(down + "<div hidden><p>no</p><b>no</b></div>yes<template><i>no</i></template>") == "yes"
    assert html_layout.render(f"<div hidden>{'<div>' * 300}{'</div>' * 300}no</div>yes") == "yes"
    assert html_layout.render(down + "<table><tr><td>apple pie<td>3<tr><td>tea<td>12</table>") == "apple pie  3\ntea        12"
    assert html_layout.render(down + "<ol><li>a<li>b</ol><pre>" + "<b>" * 5000 + "x\n y</pre>") == "1. a\n2. b\n\nx\n y"
    assert html_layout.render("<table><tr><td>" * 2000 + "cell") == "cell"
    lines = html_layout.render("<ul><li>x" * 300).split("\n")
    assert lines == ["  " * i + "- x" for i in range(300)]


# 10. near duplicates


def test_near_duplicates_equal_brute_force(spark):
    texts = H.varied_texts(90, 11)
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(H.docs_frame(spark, texts)).collect()}
    want = H.classes_by_force(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    other = base[:2000] + [f"v{r.randrange(10**6)}" for _ in range(1000)]
    from seqloom.llm.common import utf8_views
    import pyarrow as pa

    data, at = utf8_views(pa.array([" ".join(base), " ".join(other), "a b", ""]))
    of, h = dart_minhash.elements(data, at)
    sig = dart_minhash.signatures(of, h, 4, 1000)
    x, y = H.shingles(" ".join(base)), H.shingles(" ".join(other))
    both = sum((x & y).values())
    assert abs((sig[0] == sig[1]).mean() - both / (sum(x.values()) + sum(y.values()) - both)) < 0.06
    assert (sig[3] == 0).all() and np.bincount(of, minlength=4).tolist() == [2996, 2996, 1, 0]


def test_links_past_the_first_of_a_bucket(spark):
    """A chain whose ends are far apart is one class even if they share buckets."""
    words = [f"w{i}" for i in range(300)]
    texts = []
    for step in range(8):
        w = list(words)
        w[: step * 12] = [f"z{i}" for i in range(step * 12)]
        texts.append(" ".join(w))
    out = dart_minhash.near_duplicates(H.docs_frame(spark, texts)).collect()
    assert [r.component_id for r in out] == [0] * 8 and H.classes_by_force(texts) == [0] * 8


def test_near_duplicates_on_awkward_rows(spark):
    out = dart_minhash.near_duplicates(H.awkward(spark)).collect()
    assert len(out) == 8
    assert sorted(r.kept for r in out if r.doc_id in (3, 5)) == [False, False, True]
    assert all(r.kept for r in out if r.doc_id in (0, 1, 2, 4, None))
    left = dart_minhash.without_near_duplicates(H.awkward(spark))
    assert left.columns == H.awkward(spark).columns and left.count() == 6
    assert dart_minhash.near_duplicates(H.none(spark)).count() == 0


def test_piece_ids_equal_the_library_on_any_pieces():
    """Plain and odd pieces, letters of other scripts, contractions, special tokens as text; with a cache that is forgotten."""
    from tokenizers import Tokenizer

    from seqloom.llm.vocab import PieceEncoder, byte_letters

    library = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    own = PieceEncoder(public_tokenizer("byte_bpe_50k.json"), cache_pieces=500)
    assert own._ranked is not None and sorted(byte_letters().values()) == list(range(256))
    r = random.Random(12)
    some = ["don't", "it's,", "x.y", "été!!", "Ünïcode...", "漢字", "a1", "1234567890", "<|endoftext|>", "_x_", "'quoted'", "€5", "­", "ÿ", "×", "naïve;", "A" * 50, "...", "\U0001f600ok", "١٢"]
    for _ in range(30):
        texts = [" ".join(r.choice(some + ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéAB") for _ in range(r.randint(1, 12))) + r.choice(["", ".", ",", "!?", "#$"])]) for _ in range(r.randint(0, 60))) for _ in range(10)]
        assert [list(np.frombuffer(x, "<u4")) for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_of_any_vocabulary_round_trip():
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 2**32, 500), r.integers(60_000, 70_000, 5000), np.minimum(r.zipf(1.2, 20_000), 260_000)):
        ids = ids.astype("<u4")
        block, _ = id_coder.read_blocks(id_coder.MAGIC + id_coder.encode_block(ids) + id_coder.encode_index([1], [len(ids)]))
        assert (block == ids).all()


def test_piece_ids_across_line_ends():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    r = random.Random(5)
    for _ in range(400):
        text = "".join(r.choice(["a", "The", ".", "\n", "\n\n", " ", "  ", "é", "'s", "9", "\t", "x\ny", "<|endoftext|>", "..."]) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(piece_encoder(public_tokenizer("byte_bpe_50k.json")).encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)

"""Spelling variants against brute force and SQL; the index against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import spelling as S
from tests.llm import helpers as H


def _edit_one(r, w, letters):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])


def _vocabulary(n=400, seed=2, letters="abcdeéÿ"):
    r = random.Random(seed)
    words = {"".join(r.choice(letters) for _ in range(r.randint(5, 9))) for _ in range(n)}
    words |= {_edit_one(r, w, letters) for w in sorted(words) for _ in range(3)}
    words |= {"ción" * r.randint(2, 4) + "".join(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(200)}
    words |= {"a" * k for k in range(5, 40)} | {"ab" * 60 + x for x in ("", "a", "b", "c", "ca")} | {"ab" * 30 + "x" + "ab" * 30}
    return sorted(w for w in words if len(w) >= 5)


def _near_by_force(words):
    """Words that share a text with one letter replaced by a mark, or one with and one without a letter."""
    out = {w: set() for w in words}
    known, marked = set(words), {}
    for w in words:
        for i in range(len(w)):
            marked.setdefault(w[:i] + "?" + w[i + 1 :], []).append(w)
            if (v := w[:i] + w[i + 1 :]) in known:
                out[w].add(v)
                out[v].add(w)
    for group in marked.values():
        for w in group:
            out[w] |= set(group) - {w}
    return out


@pytest.mark.parametrize("max_list", [1, 8, 10_000])
def test_index_loses_no_pair(spark, max_list, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)
    words = _vocabulary()
    frame = spark.createDataFrame([(w, 3 + i % 5) for i, w in enumerate(words)], "word string, n long")
    found = {}
    for r in S.links(frame, max_list).collect():
        found.setdefault(r.word, set()).add((r.other, r.other_n))
    n = {w: 3 + i % 5 for i, w in enumerate(words)}
    assert found == {w: {(v, n[v]) for v in vs} for w, vs in _near_by_force(words).items() if vs}


def test_pairs_one_edit_apart():
    r = random.Random(4)
    words = _vocabulary(60)
    i, j = np.array([(r.randrange(len(words)), r.randrange(len(words))) for _ in range(20_000)]).T
    near = _near_by_force(words)
    assert S.near_pairs(words, i, j).tolist() == [words[b] in near[words[a]] for a, b in zip(i, j)]
    assert all(S.one_edit(words[a], words[b]) == (words[b] in near[words[a]]) for a, b in zip(i[:5000], j[:5000]))


def test_lists_are_more_than_an_edit_affects():
    for word in ("abcde", "aaaaa", "banana", "x" * 300):
        padded = f"^{word}$$$$"
        for size in (2, 3, 5):
            grams = [(p, padded[p : p + size], 1) for p in range(len(word) + 1)]
            kept = S.index_grams(word, grams)
            most = max(sum(p <= at < p + len(g) for p, g, _ in kept) for at in range(len(word) + 2))
            assert len(kept) > most


def _variants_by_force(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = _near_by_force(list(n))
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def test_variants_equal_brute_force_and_sql(spark):
    import duckdb

    r = random.Random(6)
    words = _vocabulary(60)
    texts = [" ".join((r.choice(words[:: r.choice([1, 5, 25])]) if r.random() < 0.9 else "Straße×ÀÇ Ēx Latin1").replace("a", r.choice("aA")) + r.choice(["", ".", "7", "_"]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    docs = H.awkward(spark).unionByName(H.docs_frame(spark, texts, 10))
    docs = docs.unionByName(docs.where("doc_id > 60"))
    got = sorted((tuple(x) for x in S.variants(docs).collect()), key=lambda x: x[0])
    assert len(got) > 100 and any(x[1] and x[2] != x[1] for x in got)
    assert got == _variants_by_force([(x.doc_id, x.text) for x in docs.collect()])
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text").toPandas())
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text from d")
    assert got == sorted(con.execute(S.SQL).fetchall(), key=lambda x: x[0])
    assert S.variants(H.none(spark)).count() == 0

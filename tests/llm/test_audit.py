"""Filter audit: the transducer and the word table against Python, all orders against brute force and SQL."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from seqloom.llm import filter_audit as A
from seqloom.llm.common import utf8_views
from tests.llm import helpers as H

LABELS = "doc_id long, quality int, toxic int, text string, part string, n long"


def _labels(spark, ids):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1]), "x", "p", 7) for i in ids if r.random() < 0.7] + [(None, 1, 1, None, None, None), (3, 1, 1, "", "", 0), (3, 0, 0, "", "", 0)]
    return spark.createDataFrame(rows, LABELS)


def _texts():
    r = random.Random(8)
    some = H.varied_texts(30) + ["Ab C\u00e9D # x", "A" * 300, "a b " * 250, "\u0085 \u00a0x y", "x" * 70 + " " + "x" * 69 + "y " + "x" * 70, "a\x0bb\x0cc\rd\te", "\U0001f600 $ A"]
    many = [" ".join(r.choice("abcdefgh") * r.randint(1, 20) for _ in range(r.randint(150, 400))) for _ in range(20)]
    return some + many + some[:10] + ["the same text"] * 8


def _facts(text):
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    return len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))


def test_transducer_is_definite():
    step, out = A.transducer()
    assert (step[0] == step[1]).all() and not (out[A.WORD] & A.START).any()


def test_measures_equal_python():
    texts = [*_texts(), "", None, "end", "q" * 100_000 + " " + "q" * 100_000, *["w"] * 5]
    data, at = utf8_views(pa.array(texts, pa.string()))
    assert [tuple(r) for r in A.measure(data, at).tolist()] == [_facts(t) for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "word_hashes", lambda data, start, length, seed: np.zeros(len(start), np.uint64))
    texts = ["aa bb aa cc bb", "aa", "abcdefghi abcdefghj abcdefghi"]
    data, at = utf8_views(pa.array(texts, pa.string()))
    assert A.measure(data, at)[:, 1].tolist() == [3, 1, 2]


def _by_force(docs, labels):
    good = {i: any(q == 1 for j, q, *_ in labels if j == i) for i, *_ in labels if i is not None}
    toxic = {i: any(t == 1 for j, _, t, *_ in labels if j == i) for i, *_ in labels if i is not None}
    out = {}
    masks = []
    for d in docs:
        w, distinct, capitals, points, symbols = _facts(d.text)
        same = any(e.doc_id is not None and d.doc_id is not None and e.doc_id < d.doc_id and (e.text or "") == (d.text or "") for e in docs)
        masks.append((d.lang or "", {"A": w < 200, "B": 100 * distinct < 50 * w, "C": 100 * capitals > 3 * points, "D": symbols > 0, "E": same}, good.get(d.doc_id, False), toxic.get(d.doc_id, False)))
    for part in {m[0] for m in masks}:
        removed = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [m for m in masks if m[0] == part]
            for step, f in enumerate(order, 1):
                own = [m for m in masks if m[0] == part and m[1][f]]
                here = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                removed[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), len(own) - len(here), sum(sum(m[1].values()) == 1 for m in own), sum(m[2] for m in here), sum(m[3] for m in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed[order[step - 1]])
    return out


def test_audit_equals_brute_force_and_sql(spark):
    import duckdb

    docs = H.awkward(spark).unionByName(H.docs_frame(spark, _texts(), 10))
    docs = docs.withColumn("lang", H.by_turns("lang", "doc_id"))
    labels = _labels(spark, range(90))
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in A.audit(docs, labels).collect()}
    assert got == _by_force(docs.collect(), [tuple(r) for r in labels.collect()])
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "lang").toPandas())
    con.register("l", labels.select("doc_id", "quality", "toxic").toPandas())
    con.execute("create view documents as select cast(doc_id as bigint) as doc_id, text, lang from d")
    con.execute("create view labels as select cast(doc_id as bigint) as doc_id, cast(quality as int) as quality, toxic from l")
    assert got == {r[:3]: list(r[3:]) for r in con.execute(A.SQL).fetchall()}


def test_no_rows(spark):
    assert A.audit(H.none(spark), _labels(spark, [])).count() == 0
    assert A.audit(H.docs_frame(spark, ["a"]), _labels(spark, []).limit(0)).count() == 600

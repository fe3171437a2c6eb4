"""Running sentences by composition: equal to whole sentences, whatever the cut; linear in the stream."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions.text import sentence
from seqloom.operators import gloss as G
from seqloom.operators.sentences import Sentence, SentenceScan, digest, from_row, to_row

WORDS = [("hôm qua", "TIME", "past"), ("ngày mai", "TIME", "fut"), ("bây giờ", "TIME", "pres"), ("sáng", "TIME", ""), ("không", "NEG", ""), ("chưa", "NEG", ""), ("đi", "VERB", ""), ("ăn", "VERB", ""),
         ("vui", "ADJ", ""), ("chợ", "NOUN", ""), ("mẹ", "NOUN", ""), ("tôi", "PRON", ""), ("gì", "WH", ""), ("ßa  b", "X", ""), ("", "NOUN", ""), (" ", "X", ""), (" \t", "NEG", "")]


def _stretches(n=400, seed=3):
    r = random.Random(seed)
    return [[r.choice(r.sample(WORDS, 6)) for _ in range(r.randint(1, 9))] for _ in range(n)]


def _sum(items):
    total = Sentence()
    for item in items:
        total = total + Sentence.of(*item)
    return total


def test_summaries_give_the_written_sentence(spark):
    many = _stretches()
    rows = [(i, [{"vi": v, "pos": p, "tense": t} for v, p, t in s]) for i, s in enumerate(many)]
    frame = spark.createDataFrame(rows, "i int, items array<struct<vi:string,pos:string,tense:string>>")
    whole = {r.i: r.s for r in frame.select("i", sentence(F.col("items")).alias("s")).collect()}
    for i, s in enumerate(many):
        words, chars, h = _sum(s).written()
        assert (chars, h) == (len(whole[i]), digest(whole[i])), (s, whole[i])


def test_any_cut_gives_the_same_summary():
    for s in _stretches(200, 5):
        whole = _sum(s)
        for cut in range(len(s) + 1):
            assert _sum(s[:cut]) + _sum(s[cut:]) == whole
        assert from_row(to_row(whole)) == whole


def _stream(spark, n, seed=1):
    r = random.Random(seed)
    names = {w: f"G{i}" for i, w in enumerate(WORDS) if w[0].strip()}
    lex = spark.createDataFrame([(g, *w) for w, g in names.items()], G.LEXICON_SCHEMA)
    glosses = [*names.values(), "__NOSIGN__", "", "new-word"]
    rows = [(k, i, r.choice(glosses) if r.random() > 0.02 else "RESET") for k in ("a", "b") for i in range(n if k == "a" else 50)]
    return spark.createDataFrame(rows, "k string, i int, gloss string"), lex


def test_scan_equals_translating_every_prefix(spark):
    tokens, lex = _stream(spark, 300)
    got = {(r.k, r.i): r for r in G.sentence_digests(G.sentence_rows(tokens, lex, F.col("gloss") == "RESET"), "k", ["i"]).collect()}
    rows = sorted((r.k, r.i, r.gloss) for r in tokens.collect())
    prefixes, part = [], {}
    for k, i, g in rows:
        part[k] = [] if g == "RESET" else [*part.get(k, []), (i, g)]
        if g not in ("RESET", "", "__NOSIGN__"):
            prefixes += [(k, i, j, h) for j, h in part[k]]
    said = G.translate(spark.createDataFrame(prefixes, "k string, at int, i int, gloss string"), lex, ["k", "at"], "i").collect()
    assert len(got) == len(said)
    for r in said:
        own = got[r.k, r["at"]]
        assert (own.n_chars, own.digest) == (len(r.sentence), digest(r.sentence))
        assert 0 <= own.place <= own.n_words


def test_a_long_sentence_costs_its_glosses():
    scan, r = SentenceScan(), random.Random(2)
    n = 100_000
    picked = [r.choice(WORDS) for _ in range(n)]
    rows = {c: np.array([w[i] for w in picked], object) for i, c in enumerate(("vi", "pos", "tense"))} | {"reset": np.zeros(n, bool)}
    took = []
    for m in (n // 4, n):
        t = time.process_time()
        state, out = scan.run(scan.start(), {k: v[:m] for k, v in rows.items()})
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] and out["n_chars"][-1] > n
    half = scan.fold(scan.fold(scan.identity(), {k: v[: n // 2] for k, v in rows.items()}), {k: v[n // 2 :] for k, v in rows.items()})
    assert scan.resume(half, scan.start()) == state

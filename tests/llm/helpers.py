"""Small tables with awkward rows, and brute-force answers."""

import hashlib
import random
import re
from collections import Counter, defaultdict

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, k1 string, kept string"


def docs_frame(spark, texts, first=0, source="s"):
    """documents with extra columns whose names the operators use inside."""
    rows = [(i + first, t, "en", source, len(t or ""), 1, "x", "k", "no") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in any column, empty and long texts, ties and a repeated row."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000))
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, long, "en", "s", len(long)), (3, "one two", "en", None, 7), (3, "one two", "en", None, 7), (None, "no id here at all", "en", "s", 5), (4, " \n\t ", None, "s", 4), (5, "one two", "en", "s", 7)]
    return spark.createDataFrame([(*r, 1, "x", "k", "no") for r in rows], DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


def varied_texts(n=80, seed=5):
    """Copies, near copies, shared passages, periodic and tiny texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    base = [" ".join(r.choice(words) for _ in range(250)) for _ in range(8)]
    out = []
    for _ in range(n):
        c, b = r.random(), r.choice(base)
        if c < 0.2:
            out.append(b)
        elif c < 0.45:
            w = b.split()
            for _ in range(r.randint(1, 8)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
        elif c < 0.65:
            i = r.randrange(len(b) - 500)
            out.append(" ".join(r.choice(words) for _ in range(60)) + b[i : i + r.randint(300, 900)] + " ".join(r.choice(words) for _ in range(60)))
        elif c < 0.75:
            out.append(r.choice(["be " * 300, "x" * 900, "é" * 201, "é" * 199, " " * 400, "", "ab! " * 130]))
        else:
            out.append(" ".join(r.choice(words) for _ in range(r.randint(1, 300))))
    return out


def repeats_by_force(texts, length=400):
    data = [t.encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(d, gone) if not x)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", text.lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes_by_force(texts, similarity=0.8):
    """The smallest index reachable through pairs of high weighted Jaccard similarity."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            both = sum((x & y).values())
            if x and y and both >= similarity * (sum(x.values()) + sum(y.values()) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def neighbours_by_force(vectors, cosine=0.98):
    """n_links and component of (id, label, vector or None), quadratically."""
    import numpy as np

    good = {i: np.array(v, float) for i, label, v in vectors if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    label = {i: y for i, y, _ in vectors}
    links = defaultdict(set)
    for i, x in good.items():
        for j, y in good.items():
            if i < j and label[i] == label[j] and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links[i].add(j)
                links[j].add(i)
    component = {i: i for i, _, _ in vectors}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            least = min(component[j] for j in (*js, i))
            if least < component[i]:
                component[i], changed = least, True
    return {i: (len(links[i]), component[i]) for i, _, _ in vectors}


def by_turns(column, key):
    """The column, but null, empty or another value in some rows."""
    from pyspark.sql import functions as F

    k = F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(5))
    return F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.lit("de")).otherwise(F.col(column))

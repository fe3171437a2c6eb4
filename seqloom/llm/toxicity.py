"""Toxicity by a classifier that is held steady under swaps of identity terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_slices, written

MAX_LABELLED = 10_000  # labelled rows the model is fitted on at most: those of smallest id hash
MAX_FEATURES = 4000
MIN_Z = 4.0  # least association with the label, in standard errors, of a feature
USUAL_ROWS = 30  # features of fewer labelled rows are scaled down
MIN_ROWS = 3  # least labelled rows with a feature
PREFIXES = (4, 5, 6)  # beginnings of words that are features beside whole words
STEADY = 5.0  # weight of the penalty on score changes
RIDGE = 0.02
THRESHOLD = 0.3
STEPS = 600

#: Terms that name groups; the terms of one tuple are exchanged for each other in order. Parameter of fit().
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("gay", "lesbian", "straight", "transgender"), ("black", "white", "asian", "latino"), ("immigrants", "refugees", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("frauen", "männer"), ("muslime", "christen", "juden"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"\w+")


def swapped(words: set[str], terms: Sequence[tuple[str, ...]] = IDENTITY_TERMS) -> set[str]:
    """The words with every identity term exchanged for the next of its tuple."""
    return set(map(_next_term(tuple(terms)).get, words, words))


def _next_term(terms: tuple[tuple[str, ...], ...]) -> dict[str, str]:
    return {t: group[(i + 1) % len(group)] for group in terms for i, t in enumerate(group)}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(words: set[str]) -> set[str]:
    """Whole words, and beginnings of longer words marked with a star."""
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + "*" for w in words if len(w) > n)
    return found


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        words = words_of(text)
        get, total = self.weights.get, self.bias
        for w in words:
            total += get(w, 0.0)
        for n in PREFIXES:
            for w in {w[:n] for w in words if len(w) > n}:
                total += get(w + "*", 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def labelled_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most `limit` rows that may be learned from, written: those of smallest hash of id and text.

    Only ids whose crc32 (of the id as text) leaves a remainder other than 2 by 4 are
    used; an id with several labels counts as toxic if one of them says so; null ids,
    labels and texts are left out.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("_l_doc"), F.col("toxic").cast("int").alias("_l_toxic")).where("_l_doc is not null and _l_toxic is not null")
    known = known.where(F.crc32(F.col("_l_doc").cast("string").cast("binary")) % 4 != 2).groupBy("_l_doc").agg(F.max("_l_toxic").alias("_l_toxic"))
    known = known.orderBy(F.xxhash64("_l_doc"), "_l_doc").limit(limit)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_d_doc"), F.col("text").alias("_d_text")).where("_d_text is not null")
    rows = rows.join(F.broadcast(known), F.col("_d_doc") == F.col("_l_doc"))  # at most `limit` ids
    few = written(rows.select("_l_doc", "_l_toxic", F.col("_d_text").alias("text"), F.xxhash64("_d_text").alias("h")), "labelled")
    # an id may have many rows: of all rows the first by hash, found without their texts
    rank = F.struct(F.xxhash64("_l_doc"), "_l_doc", "h")
    last = few.select(rank.alias("rank")).orderBy("rank").limit(limit).agg(F.max("rank")).scalar()
    some = few.where(rank <= last).dropDuplicates(["_l_doc", "h"])  # equal texts of an id once
    return some.select("text", F.col("_l_toxic").alias("toxic"))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[int(toxic > 0)].update(features(words_of(text)))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (0, 1))], ["feature", "n0", "n1"])


def fit(docs: DataFrame, labels: DataFrame, terms: Sequence[tuple[str, ...]] = IDENTITY_TERMS, limit: int = MAX_LABELLED, steady: float = STEADY) -> Model:
    """Logistic regression on words and beginnings of words, from `labels.toxic`.

    Features are those most associated with the label, and those of all identity terms.
    Beside the likelihood the fit minimises `steady` times the squared change of
    the score when a labelled text's identity terms are swapped, so that a group's name
    alone can't raise the score. The driver only gets the chosen features of at most
    `limit` rows. Without labelled rows every score is 0; with one class it is constant.
    """
    rows = labelled_rows(docs, labels, limit)
    n1, n = rows.agg(F.sum((F.col("toxic") > 0).cast("int")), F.count(F.lit(1))).first()
    n1 = int(n1 or 0)
    if n1 in (0, n):
        return Model({}, -30.0 if n1 == 0 else 30.0)
    n0 = n - n1
    counts = rows.mapInArrow(_feature_counts, "feature string, n0 bigint, n1 bigint").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n0 + n1 >= {MIN_ROWS}")
    p0, p1 = (F.col("n0") + 0.5) / (n0 + 1), (F.col("n1") + 0.5) / (n1 + 1)
    pooled = (F.col("n0") + F.col("n1") + 1) / (n + 2)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1))
    best = counts.select("feature", (F.col("n0") + F.col("n1")).alias("n"), F.abs(z).alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES)
    chosen = {r[0]: r[1] for r in best.collect()}
    names = sorted(set(chosen) | features({t for g in terms for t in g}))
    scale = np.sqrt(np.minimum(1.0, np.array([chosen.get(f, MIN_ROWS) for f in names]) / USUAL_ROWS))
    at = {f: i for i, f in enumerate(names)}
    nexts = _next_term(tuple(tuple(g) for g in terms))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            own, other, y = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                own.append(sorted(at[f] for f in features(words) if f in at))
                other.append(sorted(at[f] for f in features({nexts.get(w, w) for w in words}) if f in at) if any(w in nexts for w in words) else None)
                y.append(int(toxic > 0))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array(other, kind), pa.array(y, pa.int32())], ["own", "other", "y"])

    data = rows.mapInArrow(indexed, "own array<int>, other array<int>, y int").orderBy("y", "own").collect()
    return _solve(names, scale, data, steady)


def _solve(names: list[str], scale: np.ndarray, data: list, steady: float) -> Model:
    """Accelerated gradient descent; rarer features are scaled down, so that common beginnings explain what they can."""
    y = np.array([r[2] for r in data], float)
    row = np.repeat(np.arange(len(data)), [len(r[0]) for r in data])
    col = np.concatenate([np.array(r[0], np.int64) for r in data])
    pairs = [(i, r) for i, r in enumerate(data) if r[1] is not None]
    p_row = np.repeat(np.arange(len(pairs)), [len(r[0]) + len(r[1]) for _, r in pairs]) if pairs else np.zeros(0, np.int64)
    p_col = np.concatenate([np.array([*r[0], *r[1]], np.int64) for _, r in pairs]) if pairs else np.zeros(0, np.int64)
    p_sign = np.concatenate([np.repeat([1.0, -1.0], [len(r[0]), len(r[1])]) for _, r in pairs]) if pairs else np.zeros(0)
    n, k = len(data), len(names)
    w, bias = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    moved, moved_bias = w.copy(), bias
    widest = max(1.0, np.bincount(row, minlength=n).max() / 4)
    rate = 1 / (widest / 4 + RIDGE + 2 * steady * (np.bincount(p_row).max() if len(p_row) else 0))
    for step in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (scale * moved)[col], n) + moved_bias, -30, 30)))
        grad = scale * np.bincount(col, (p - y)[row], k) / n + RIDGE / 100 * moved
        if pairs:
            change = np.bincount(p_row, p_sign * (scale * moved)[p_col], len(pairs))
            grad += 2 * steady / n * scale * np.bincount(p_col, p_sign * change[p_row], k)
        new, new_bias = moved - rate * grad, moved_bias - rate * float((p - y).mean())
        pull = step / (step + 3)
        moved, moved_bias = new + pull * (new - w), new_bias + pull * (new_bias - bias)
        w, bias = new, new_bias
    return Model({f: float(v) for f, v in zip(names, scale * w) if v}, bias)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document (doc_id, text): doc_id, held_out, score, predicted.

    Whole texts are scored; a null or empty text gets the score of no words; repeated rows
    get a row each; an empty table gives none; other columns are ignored. The model's
    size is bounded by MAX_FEATURES and the identity terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([own.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Language spans: scripts narrow the candidates, a Viterbi path over per-word scores labels the words.

A word's score in a language is the mean-free log probability of its letter grams
there. Its script, by ranges of code points, admits only the languages seen in it.
The path through a text maximises the scores less a penalty for each switch, so single
odd words don't break a span while real changes of language do. Texts are cut into
chunks: every chunk is solved for each language it may be entered in, chunks are chained,
then each is replayed, which gives the same path as one pass over the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import drop_written, text_slices, written

PER_LANGUAGE = 4000  # texts a language's grams are counted in, about: those of smallest id hash
MOST_CELLS = 1 << 22  # gram buckets x languages: the model has 16 MB at most, whatever the number of languages
GRAMS = 5  # longest gram, word ends included
SMOOTHING = 0.5
SHARPNESS = 0.25  # grams of a word overlap, so their evidence is scaled down
LIMIT = 8.0  # a word speaks against a language by so much at most
SWITCH = 6.0  # penalty of a change of language
OTHER_SCRIPT = 50.0  # what a language loses by a word in a script it is not written in
LEAST_SHARE = 0.01  # of a language's words that must be in a script
CHUNK = 128  # words
UNKNOWN = "und"

#: First code point, last code point and name of scripts' letters.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x077F, "Arabic"), (0x0780, 0x07BF, "Thaana"), (0x08A0, 0x08FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"),
    (0x0A80, 0x0AFF, "Gujarati"), (0x0B00, 0x0B7F, "Oriya"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0D80, 0x0DFF, "Sinhala"), (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x0F00, 0x0FFF, "Tibetan"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3100, 0x312F, "Bopomofo"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0xFB50, 0xFDFF, "Arabic"), (0xFE70, 0xFEFF, "Arabic"),
)
SCRIPT_NAMES = sorted({s[2] for s in SCRIPTS}) + ["other"]
_FIRST = np.array([s[0] for s in SCRIPTS], np.uint32)
_LAST = np.array([s[1] for s in SCRIPTS], np.uint32)
_SCRIPT = np.array([SCRIPT_NAMES.index(s[2]) for s in SCRIPTS])

_WORD = re.compile(r"[^\W\d_]+")  # runs of letters
_U = np.uint64


def lowered(text: str) -> str:
    """Lower case with every letter in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """The script of each code point, as a place in SCRIPT_NAMES."""
    at = np.searchsorted(_FIRST, codes, "right") - 1
    return np.where((at >= 0) & (codes <= _LAST[np.maximum(at, 0)]), _SCRIPT[np.maximum(at, 0)], len(SCRIPT_NAMES) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def grams(words: Sequence[str], bits: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each length of gram (words, buckets), word by word; and every word's script. Words are lower-case and not empty."""
    codes = np.frombuffer(("\2" + "\3\2".join(words) + "\3").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) + 2 for w in words])
    ends = np.cumsum(size)
    out, h = [], np.zeros(len(codes), _U)
    for n in range(1, GRAMS + 1):
        h = h[: len(codes) - n + 1] * _U(0x9E3779B97F4A7C15) + codes[n - 1 :] + _U(1)
        count = np.maximum(size - n + 1, 0)
        own = np.repeat(np.arange(len(words)), count)
        at = np.repeat(ends - size, count) + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        out.append((own, (_mixed(h[at] + _U(n)) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)))
    return out, scripts_of(codes[ends - size + 1])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    bits: int
    table: np.ndarray  # (buckets, languages): mean-free log probabilities
    admitted: np.ndarray  # (scripts, languages)

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """(words, languages): 0 for the best language of a word, down to -LIMIT, and less in another script."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        if not len(words):
            return out
        found, script = grams(words, self.bits)
        for own, bucket in found:
            if len(own):
                first = np.flatnonzero(np.diff(own, prepend=-1))
                out[own[first]] += np.add.reduceat(self.table[bucket], first, axis=0)
        ok = self.admitted[script]
        out = np.where(ok, SHARPNESS * out, -np.inf)
        out = np.maximum(out - out.max(1, keepdims=True), -LIMIT)
        return np.where(ok, out, out - OTHER_SCRIPT)


def viterbi(scores: np.ndarray, starts: np.ndarray, ends: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word; text i has the words starts[i] to ends[i] - 1. Ties go to the first language, and to no switch."""
    k = scores.shape[1]
    path = np.zeros(len(scores), np.int64)
    some = np.flatnonzero(ends > starts)
    if k < 2 or not len(some):
        return path
    n_chunks = -(-(ends - starts)[some] // CHUNK)
    text = np.repeat(np.arange(len(some)), n_chunks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    begin = starts[some][text] + nth * CHUNK
    size = np.minimum(ends[some][text] - begin, CHUNK)
    # each chunk from every language it may be entered in; only texts of several chunks need it
    entered = np.zeros((len(text), k))
    several = np.flatnonzero(n_chunks[text] > 1)
    if len(several):
        order = several[np.argsort(-size[several], kind="stable")]
        best = np.full((len(order), k, k), -np.inf)
        best[:, np.arange(k), np.arange(k)] = 0
        for t in range(int(size[order[0]])):
            m = int(np.searchsorted(-size[order], -t, "left"))
            b = best[:m]
            best[:m] = np.maximum(b, b.max(2, keepdims=True) - switch) + scores[begin[order[:m]] + t][:, None, :]
        solved = np.empty((len(text), k, k))
        solved[order] = best
        value = np.zeros((len(some), k))  # a text starts in any language
        for step in range(int(n_chunks.max())):
            own = np.flatnonzero((nth == step) & (n_chunks[text] > 1))
            entered[own] = value[text[own]]
            value[text[own]] = (value[text[own]][:, :, None] + solved[own]).max(1)
    # the chunks again, from what they were entered with
    order = np.argsort(-size, kind="stable")
    value = entered[order]
    moved = np.zeros((CHUNK, len(order)), np.int32)  # the language a switch comes from
    stay = np.zeros((CHUNK, len(order), k), bool)
    for t in range(int(size[order[0]])):
        m = int(np.searchsorted(-size[order], -t, "left"))
        v = value[:m]
        moved[t, :m] = v.argmax(1)
        top = v.max(1, keepdims=True) - switch
        stay[t, :m] = v >= top
        value[:m] = np.maximum(v, top) + scores[begin[order[:m]] + t]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    last = np.full(len(some), -1)
    for step in range(int(n_chunks.max()) - 1, -1, -1):  # backwards through the chunks of all texts
        own = np.flatnonzero(nth == step)
        row = place[own]
        at = np.where(last[text[own]] >= 0, last[text[own]], value[row].argmax(1))
        for t in range(int(size[own].max()) - 1, -1, -1):
            live = size[own] > t
            path[begin[own[live]] + t] = at[live]
            kept = stay[t, row[live], at[live]]
            at[live] = np.where(kept, at[live], moved[t, row[live]])
        last[text[own]] = at
    return path


def _words(texts: Sequence[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, number of each word of all texts, offsets of the texts' words)."""
    number: dict[str, int] = {}
    of: list[int] = []
    offsets = [0]
    for text in texts:
        if text:
            of += [number.setdefault(w, len(number)) for w in _WORD.findall(lowered(text))]
        offsets.append(len(of))
    return list(number), np.array(of, np.int64), np.array(offsets)


def labelled_words(texts: Sequence[str | None], model: Model, switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language of each word, its letters, offsets of the texts' words)."""
    words, of, offsets = _words(texts)
    if not len(of):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), offsets
    letters = np.array([len(w) for w in words])
    return viterbi(model.scores(words)[of].astype(np.float64), offsets[:-1], offsets[1:], switch), letters[of], offsets


def _counts(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    size = 1 << bits
    for batch in text_slices(batches, "text"):
        langs = np.array(batch.column(1).to_pylist(), object)
        words, of, offsets = _words(batch.column(0).to_pylist())
        if not len(of):
            continue
        found, script = grams(words, bits)
        text = np.searchsorted(offsets, np.arange(len(of)), "right") - 1
        for lang in sorted(set(langs)):
            n = np.bincount(of[langs[text] == lang], minlength=len(words))
            own = total.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES), np.int64))
            for w, bucket in found:
                own[:size] += np.bincount(bucket, n[w], size).astype(np.int64)
            own[size:] += np.bincount(script, n, len(SCRIPT_NAMES)).astype(np.int64)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])


def _held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Gram counts of every language in documents (doc_id, text, lang).

    Learns from rows with a lang and a text whose crc32 of the id (as text) leaves a remainder other than
    2 by 4; of a language with more than `per_language` such rows about so many, chosen by
    hash of the id. The driver gets at most MOST_CELLS counts. Without such rows
    the model knows no language.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("bigint")).alias("h"), _held_out().alias("held_out")).where("text is not null and lang is not null and not held_out")
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size")), "languages")
    langs = sizes.count()
    bits = max(0, (MOST_CELLS // max(langs, 1)).bit_length() - 1)
    bits = min(bits, 16)
    some = rows.join(sizes, "lang").where(F.expr(f"pmod(h, size) < {int(per_language)}")).select("text", "lang")
    counts = some.mapInArrow(lambda b: _counts(b, bits), "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    drop_written(sizes)
    names = sorted(set(counts.column("lang").to_pylist()))
    size = 1 << bits
    n = np.zeros((size + len(SCRIPT_NAMES), len(names)))
    place = {name: i for i, name in enumerate(names)}
    n[counts.column("bucket").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    table = np.log(n[:size] + SMOOTHING) - np.log(n[:size].sum(0) + SMOOTHING * size)
    table = (table - table.mean(1, keepdims=True)) if names else table
    admitted = n[size:] > LEAST_SHARE * n[size:].sum(0) if names else np.zeros((len(SCRIPT_NAMES), 0), bool)
    admitted[~admitted.any(1)] = True  # a script of no language narrows nothing
    return Model(names, bits, table.astype(np.float32), admitted)


def spans(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """A row per document (doc_id, text): doc_id, spans, an array of (first, last, lang, letters) in order.

    A span [first, last) of characters goes from its first word to its last. Words are runs of letters. Texts
    without letters, null texts and a model without languages have no spans; a text
    may be of any length; repeated rows get a row each; an empty table gives none; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            path, letters, offsets = labelled_words(texts, own, switch) if own.langs else (None, None, np.zeros(len(texts) + 1, np.int64))
            out = []
            for i, text in enumerate(texts):
                a, b = offsets[i], offsets[i + 1]
                if a == b:
                    out.append([])
                    continue
                at = [m.span() for m in _WORD.finditer(lowered(text))]
                cuts = np.flatnonzero(np.diff(path[a:b], prepend=-1, append=-1))
                out.append([{"first": at[x][0], "last": at[y - 1][1], "lang": own.langs[path[a + x]], "letters": int(letters[a + x : a + y].sum())} for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, spans array<struct<first:bigint,last:bigint,lang:string,letters:bigint>>")


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """A row per document (doc_id, text): doc_id, held_out, lang_pred, score, n_spans.

    lang_pred is the language whose spans (see spans()) hold most letters, ties to the
    smallest name; score is their share of the text's letters. A null text, one without a letter
    and any text under a model without languages is UNKNOWN with a score of 0. A null doc_id is
    not held out. Repeated rows get a row each; an empty table gives none; other columns
    are ignored. The model's size is bounded (MOST_CELLS).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = max(1, len(own.langs))
        for batch in text_slices(batches, "text"):
            texts = batch.column(1).to_pylist()
            n = len(texts)
            path, letters, offsets = labelled_words(texts, own, switch) if own.langs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
            text = np.repeat(np.arange(n), np.diff(offsets))
            share = np.bincount(text * k + path, letters, n * k).reshape(n, k)
            total = share.sum(1)
            cut = np.ones(len(path), bool)
            cut[1:] = (path[1:] != path[:-1]) | (text[1:] != text[:-1])
            names = [own.langs[j] if t else UNKNOWN for j, t in zip(share.argmax(1).tolist(), total.tolist())]
            score = share.max(1) / np.maximum(total, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(np.bincount(text[cut], minlength=n))], ["doc_id", "lang_pred", "score", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, n_spans bigint")
    return found.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")

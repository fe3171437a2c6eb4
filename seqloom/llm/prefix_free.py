"""Exact repeats by prefix-free parsing: which bytes lie in a long string that also starts elsewhere.

A rolling hash over TRIGGER bytes ends phrases, so equal strings are parsed alike
wherever they stand. The dictionary (distinct phrases) settles most of the corpus: a
string that holds a phrase which occurs once can't be repeated. The parse serves only
this filter. What is left is grouped by hashes of its bytes: windows placed by a string's
first trigger come first, and single strings are compared only where all but a few of their
bytes agree already. Strings with one 128-bit hash are taken as equal: a class with two
members is a repeat. No suffix array of the dictionary or the parse is built, and
no suffixes are sorted; only hashes are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.llm.common import drop_written, text_slices, unused, utf8_views, written
from seqloom.llm.dart_minhash import _powers, _size, mixed

LENGTH = 400
STAGE_LENGTH = 200  # a passage of over 50 words is longer
TRIGGER = 16  # bytes under the rolling hash


def phrase_bytes(length: int) -> int:
    """Mean bytes between triggers: a string of `length` bytes holds about eight phrases."""
    return max(1, 12 * length // 100)


def step_bytes(length: int) -> int:
    """Strings are compared one by one only where all but so many of their bytes, placed by the first trigger, agree already."""
    return max(1, length // 25)


_U = np.uint64
_PARSED = "row bigint, doc_id bigint, k1 bigint, k2 bigint, n_bytes bigint, triggers array<int>, phrases array<bigint>"
_UNITS = "row bigint, first int, last int, name binary, place bigint"


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(_size(len(data)))
    return np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])]), down


def triggers(data: np.ndarray, at: np.ndarray, sums: np.ndarray, down: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Starts of the TRIGGER-byte strings whose hash is small; none crosses the end of a text."""
    n = len(data) - TRIGGER + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = mixed((sums[TRIGGER:] - sums[:-TRIGGER]) * down[:n], 11)
    t = np.flatnonzero(h < _U(2**64 // phrase_bytes(length)))
    return t[at[np.searchsorted(at, t, "right")] - t >= TRIGGER] if len(t) else t


def _parse(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in text_slices(batches, "text"):
        data, at = utf8_views(batch.column(3))
        data, at = data[at[0] : at[-1]], at - at[0]
        sums, down = _sums(data)
        t = triggers(data, at, sums, down, length)
        text = np.searchsorted(at, t, "right") - 1
        to = np.minimum(np.append(t[1:], 0) + TRIGGER, len(data))
        h = mixed((sums[to] - sums[t]) * down[t], 12).view(np.int64)  # of the phrase up to the next trigger's end
        n = batch.num_rows
        ends = np.searchsorted(text, np.arange(n + 1))
        t = (t - at[text]).astype(np.int32)
        inner = np.append(text[1:] == text[:-1], False) if len(t) else np.zeros(0, bool)
        n_inner = np.concatenate([[0], np.cumsum(inner)])[ends]
        cols = [
            pa.array(np.arange(row, row + n)), *batch.columns[:3], pa.array(np.diff(at)),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(t)), pa.ListArray.from_arrays(pa.array(n_inner, pa.int32()), pa.array(h[inner])),
        ]
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "k1", "k2", "n_bytes", "triggers", "phrases"])
        row += n


def possible_starts(t: np.ndarray, n_bytes: int, once: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The starts of all strings of `length` bytes that hold none of the phrases `once`, which occur nowhere else, as runs [first, last]."""
    n = n_bytes - length + 1
    if n <= 0:
        return np.zeros((0, 2), np.int64)
    t = t.astype(np.int64)
    low, high = np.maximum(t[1:][once] + TRIGGER - length, 0), np.minimum(t[:-1][once], n - 1)
    use = low <= high
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, low[use], 1)
    np.add.at(edge, high[use] + 1, -1)
    return runs(np.cumsum(edge[:-1]) == 0)


def runs(flags: np.ndarray) -> np.ndarray:
    """[first, last] of each run of true values."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1], 1)


def _regions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, found = [], []
        for i in range(batch.num_rows):
            t = batch.column(2)[i].values
            once = batch.column(3)[i].values
            r = possible_starts(t.to_numpy() if t else np.zeros(0, np.int32), batch.column(1)[i].as_py(), once.to_numpy() if once else np.zeros(0, np.int64), length)
            if len(r):
                own.append(i)
                found.append(r.reshape(-1).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(found, pa.list_(pa.int32()))], ["row", "starts"])


def units(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, bytes, int]]:
    """Runs of up to a step of starts that have the same first trigger: (first, last, name, place).

    Runs end at whole multiples of the step before the trigger, so equal strings lie in runs
    that end alike. The name stands for all bytes of the run's strings; the place for the
    bytes that every string of such a run has. Strings without a trigger share one place.
    """
    raw = memoryview(data)
    sums, down = _sums(data)
    t, step = triggers(data, np.array([0, len(data)]), sums, down, length), step_bytes(length)
    out = []
    for a, b in starts.tolist():
        i = np.arange(a, b + 1)
        k = np.searchsorted(t, i)
        first = np.append(t, len(data) + length)[k]
        away = first - i
        none = away > length - TRIGGER
        kind, first = np.where(none, -1, away // step), np.where(none, -1, first)
        new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (kind[1:] != kind[:-1])]))
        for x, y in zip(new.tolist(), [*(new[1:] - 1).tolist(), len(i) - 1]):
            begin = int(first[x]) - step * int(kind[x])
            core = raw[begin : begin + length - step + 1] if kind[x] >= 0 else b""
            place = xxhash.xxh3_64_intdigest(core, int(kind[x]) + 1)
            out.append((a + x, a + y, xxhash.xxh3_128_digest(raw[a + x : a + y + length]), place - (1 << 63)))
    return out


def _units(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        rows = []
        for row, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            rows += [(row, *u) for u in units(data, np.array(starts).reshape(-1, 2), length)]
        cols = zip(*rows) if rows else [[]] * 5
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["row", "first", "last", "name", "place"])


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Names of all strings of the runs that must be compared; equal ones of a text in one row."""
    for batch in text_slices(batches, "text"):
        names, counts, rows, at = [], [], [], []
        for row, text, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = memoryview(text.encode())
            seen: dict[bytes, list[int]] = {}
            for s in starts:
                for i in range(s["first"], s["last"] + 1):
                    seen.setdefault(xxhash.xxh3_128_digest(raw[i : i + length]), []).append(i)
            names += seen.keys()
            counts += [len(v) for v in seen.values()]
            at += seen.values()
            rows += [row] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["string", "n", "row", "at"])


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))


def repeats(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """The documents' keys (row, doc_id, k1, k2, n_bytes) and, for texts with repeats, (k1, k2, spans).

    spans lists [first, last) of the maximal runs of bytes covered by a string of `length`
    bytes that also starts elsewhere, in order. Both tables are written.
    """
    parsed = written(_keys(docs).mapInArrow(lambda b: _parse(b, length), _PARSED), "parsed")
    texts = parsed.groupBy("k1", "k2").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    texts = written(texts.join(parsed.select("row", "doc_id", "n_bytes"), "row").where(f"n_bytes >= {length}"), "texts")
    single = parsed.join(texts.select("row"), "row", "left_semi")
    phrases = single.select("row", F.posexplode("phrases").alias("j", "phrase"))
    seen = phrases.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("j").alias("j"))  # the place of a phrase that occurs once
    marks = seen.where("n = 1").groupBy("row").agg(F.collect_list("j").alias("once"))  # at most a text's phrases
    asked = single.select("row", "n_bytes", "triggers").join(marks, "row", "left").select("row", "n_bytes", "triggers", F.coalesce("once", F.array().cast("array<int>")).alias("once"))
    regions = written(asked.mapInArrow(lambda b: _regions(b, length), "row bigint, starts array<int>").join(texts.select("row", F.col("doc_id").alias("_doc"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")), "row"), "regions")
    same = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    held = written(_keys(docs).join(regions, same).select("row", "text", "starts").dropDuplicates(["row"]), "held")
    keys = written(parsed.select("row", "doc_id", "k1", "k2", "n_bytes"), "keys")
    drop_written(parsed, regions)

    found = written(held.mapInArrow(lambda b: _units(b, length), _UNITS), "units")
    classes = written(found.groupBy("name", "place").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "unit-classes")
    open_ = classes.groupBy("place").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("place")
    # one member of every class at an open place is compared string by string
    member = found.join(classes.join(open_, "place").select("name", "row"), ["name", "row"], "left_semi")
    # runs whose place is none's may repeat within themselves
    alone = found.where(F.col("last") > F.col("first")).where(F.col("place") == xxhash.xxh3_64_intdigest(b"", 0) - (1 << 63)).select("row", "first", "last")
    compare = member.select("row", "first", "last").unionByName(alone).distinct().groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    strings = written(held.select("row", "text").join(compare, "row").select("row", "text", "runs").mapInArrow(lambda b: _strings(b, length), "string binary, n bigint, row bigint, at array<int>"), "strings")
    twice = strings.groupBy("string").agg(F.sum("n").alias("n")).where("n > 1").select("string")
    alike = strings.join(twice, "string", "left_semi").select("row", F.explode("at").alias("first")).select("row", "first", F.col("first").alias("last"))
    copied = found.join(classes.where("n > 1").select("name"), "name", "left_semi").select("row", "first", "last")
    starts = copied.unionByName(alike).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, r in zip(batch.column(2).to_pylist(), batch.column(3)):
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, r.values.field("first").to_numpy(), 1)
                np.add.at(edge, r.values.field("last").to_numpy() + length, -1)
                out.append((runs(np.cumsum(edge[:-1]) > 0) + np.array([0, 1])).reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["k1", "k2", "spans"])

    some = texts.where("copies = 1").join(starts, "row").select("k1", "k2", "n_bytes", "runs").mapInArrow(merge, "k1 bigint, k2 bigint, spans array<int>")
    whole = texts.where("copies > 1").select("k1", "k2", F.array(F.lit(0), F.col("n_bytes").cast("int")).alias("spans"))
    spans = written(some.unionByName(whole), "spans")
    drop_written(texts, held, found, classes, strings)
    return keys, spans


def _cut(data: memoryview, spans: list[int]) -> bytes:
    ends = [0, *spans, len(data)]
    return b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))


def removals(docs: DataFrame) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of LENGTH bytes that also starts anywhere else, in
    the same text or another, is removed, in all places; strings are judged on the
    input and may overlap themselves. Texts are UTF-8 bytes, a null text is empty, no
    string crosses a text's end. Repeated rows are copies of each other. An empty
    table gives no row; other columns are ignored.
    """
    keys, spans = repeats(docs)
    digest = _keys(docs).join(spans.select("k1", "k2", "spans"), ["k1", "k2"], "left").select("doc_id", "text", "spans")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            data, at = utf8_views(batch.column(1))
            raw = memoryview(data)
            for i, (doc_id, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own, s = raw[at[i] : at[i + 1]], s or []
                kept = _cut(own, s)
                rows.append((doc_id, len(own), len(own) - len(kept), len(s) // 2, hashlib.sha256(kept).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return digest.mapInArrow(describe, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = STAGE_LENGTH) -> DataFrame:
    """The documents without the bytes of strings of `length` bytes that also start elsewhere; same columns, n_chars (if there) counted anew.

    A cut is moved inwards to whole characters, so up to three bytes of a repeat may
    stay at either side. Null texts stay null; repeated rows are copies of each other
    and lose their texts; an empty table gives no row; columns may have any names.
    """
    _, spans = repeats(docs, length)
    columns = docs.columns
    text = F.coalesce("text", F.lit(""))
    a, b, c, d, cuts = unused(columns, "k1", "k2", "s1", "s2", "spans")
    rows = docs.select("*", F.xxhash64(text).alias(a), F.xxhash64(F.lit(1), text).alias(b))
    s = spans.select(F.col("k1").alias(c), F.col("k2").alias(d), F.col("spans").alias(cuts))
    rows = rows.join(s, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left").select(*columns, cuts)

    def cut(value: str, spans: list[int]) -> str:
        data = value.encode()
        whole = []
        for a, b in zip(spans[::2], spans[1::2]):
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            whole += [a, b]
        return _cut(memoryview(data), whole).decode()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            texts = [cut(t, s) if s and t else t for t, s in zip(batch.column(i).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == i else batch.column(c) for c in range(batch.num_columns - 1)], columns)

    out = rows.mapInArrow(rewrite, StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

"""Quality rules with cross-document line frequency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from seqloom.llm.common import text_slices, unused, utf8_views, written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_HOST_DOCUMENTS = 10  # a line in more different documents of a host is frequent
MAX_REMOVED_PERCENT = 70  # a document that loses more of its words, or keeps fewer than MIN_WORDS, is depleted

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_STATS = "row bigint, doc_id bigint, host string, text_hash binary, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<line:binary,words:bigint>>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def line_hash(words: list[bytes]) -> bytes:
    """128 bits of the normalised line: lower-case words joined by single spaces."""
    return xxhash.xxh3_128_digest(b" ".join(words).decode("utf-8", "replace").lower().encode())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    x = np.array([ids.setdefault(w, len(ids) + 1) for w in words], np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    _, of, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = (count[of] > 1).astype(np.int64)
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in text_slices(batches, "text"):
        data, offsets = utf8_views(batch.column(2))
        first = int(offsets[0])
        part, at = data[first : offsets[-1]], offsets - first
        seen = ~_SPACE[part]
        before = np.concatenate([[False], seen[:-1]]) if len(seen) else seen
        inner = at[:-1][(at[:-1] < at[1:])]
        before[inner] = False
        n_words = _sums(seen & ~before, at)
        word_chars = _sums(seen & ((part & 0xC0) != 0x80), at)
        n_symbols = _sums(_SYMBOL[part], at)
        raw = part.tobytes()
        hashes, dup, repeat, lines = [], [], [], []
        for i in range(len(at) - 1):
            text = raw[at[i] : at[i + 1]]
            known, own, words, twice = set(), {}, [], 0
            for line in text.split(b"\n"):
                found = line.split()
                if found:
                    twice += line in known
                    known.add(line)
                    h = line_hash(found)
                    own[h] = own.get(h, 0) + len(found)
                    words += found
            hashes.append(xxhash.xxh3_128_digest(text))
            dup.append(twice)
            repeat.append(repeated_words(words))
            lines.append([{"line": h, "words": n} for h, n in own.items()])
        n = len(hashes)
        cols = [np.arange(row, row + n), batch.column(0), batch.column(1), pa.array(hashes, pa.binary()), n_words, word_chars, n_symbols, pa.array(dup, pa.int64()), pa.array(repeat, pa.int64())]
        cols = [pa.array(c) if isinstance(c, np.ndarray) else c for c in cols]
        cols.append(pa.array(lines, pa.list_(pa.struct([("line", pa.binary()), ("words", pa.int64())]))))
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])
        row += n


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """Base statistics and hashed lines of every document, written: the texts are read once and never moved."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return written(rows.mapInArrow(_stats, _STATS), "line-stats")


def boilerplate_lines(stats: DataFrame, max_documents: int = MAX_HOST_DOCUMENTS) -> DataFrame:
    """(host, line) of the lines to remove, written.

    A line is removed if more than max_documents documents with different texts hold it
    within one host (rows without a host are a host of their own), however much of
    those documents such lines make up: a document that loses too much is rejected.
    """
    held = stats.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "text_hash", F.explode("lines").alias("l"))
    held = held.select("host", "no_host", "text_hash", "l.line")
    key = ["host", "no_host", "line"]
    texts = held.groupBy(*key, "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return written(texts.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_documents).select(*key), "boilerplate")


def verdicts(stats: DataFrame, lines: DataFrame) -> DataFrame:
    """Every row of the statistics with base_failed, n_removed_words and kept."""
    held = stats.select("row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("l"))
    held = held.select("row", "host", "no_host", "l.line", "l.words").join(lines, ["host", "no_host", "line"])
    removed = held.groupBy("row").agg(F.sum("words").alias("n_removed_words"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("n_removed_words", F.lit(0))
    depleted = (F.col("n_words") - gone < MIN_WORDS) | (100 * gone > MAX_REMOVED_PERCENT * F.col("n_words"))
    return stats.drop("lines").join(removed, "row", "left").select(
        "row", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), gone.alias("n_removed_words"), (~base & ~depleted).alias("kept")
    )


def judge(docs: DataFrame, host: str = "source", max_documents: int = MAX_HOST_DOCUMENTS) -> DataFrame:
    """A row per document (doc_id, text, host column): statistics, base_failed, n_removed_words, kept.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. A null text is one without words
    and fails the base rule; a null host is a host of its own; repeated rows get a row
    each and count as one text; an empty table gives no row; other columns are ignored.
    """
    stats = document_stats(docs, host)
    return verdicts(stats, boilerplate_lines(stats, max_documents)).drop("row", "host", "text_hash")


def clean(docs: DataFrame, host: str = "source", max_documents: int = MAX_HOST_DOCUMENTS) -> DataFrame:
    """The kept documents with their boilerplate lines cut out; same columns, n_chars (if there) counted anew.

    Rows with the same doc_id, host and text share one verdict and all stay or go. Null
    and empty texts fail the base rule and go; a text of any length is read line by
    line; an empty table gives no row; columns may have any names.
    """
    columns = docs.columns
    own_hash, k_doc, k_host, k_text, gone = unused(columns, "text_hash", "k_doc", "k_host", "k_text", "bad")
    stats = document_stats(docs, host)
    lines = boilerplate_lines(stats, max_documents)
    kept = verdicts(stats, lines).where("kept")
    held = stats.select("row", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), F.explode("lines").alias("l"))
    bad = held.select("row", "host", "no_host", "l.line").join(lines, ["host", "no_host", "line"]).groupBy("row").agg(F.collect_set("line").alias("bad"))  # at most a document's lines
    one = kept.join(bad, "row", "left").select(F.col("doc_id").alias(k_doc), F.col("host").alias(k_host), F.col("text_hash").alias(k_text), F.coalesce("bad", F.array().cast("array<binary>")).alias(gone))
    one = one.dropDuplicates([k_doc, k_host, k_text])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8_views(batch.column(batch.schema.get_field_index("text")))
            raw = memoryview(data)
            own = pa.array([xxhash.xxh3_128_digest(raw[at[i] : at[i + 1]]) for i in range(batch.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, own_hash])

    rows = docs.mapInArrow(hashed, StructType([*docs.schema.fields, StructField(own_hash, BinaryType())]))
    same = F.col(k_doc).eqNullSafe(F.col("doc_id").cast("bigint")) & F.col(k_host).eqNullSafe(F.col(host).cast("string")) & (F.col(k_text) == F.col(own_hash))
    rows = rows.join(one, same)

    def cut(text: str | None, bad: set[bytes]) -> str | None:
        if text is None or not bad:
            return text
        return b"\n".join(x for x in text.encode().split(b"\n") if not (w := x.split()) or line_hash(w) not in bad).decode()

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            i = batch.schema.get_field_index("text")
            texts = [cut(t, set(b)) for t, b in zip(batch.column(i).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == i else batch.column(c) for c in range(batch.num_columns - 1)], columns)

    out = rows.select(*columns, gone).mapInArrow(rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


#: The same rules for a table `documents` in SQL.
SQL = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
win as (select r, i, list_aggregate(list_slice(ws, i, i + 7), 'string_agg', ' ') as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w)),
rep as (select r, count(distinct i + k) as n from (select r, i, count(*) over (partition by r, g) as c from win), range(0, 8) as u(k) where c > 1 group by r),
ln as (select r, source, t, pos, line, array_to_string(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: lower(x)), ' ') as norm, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as words
  from (select r, source, t, unnest(string_split(t, chr(10))) as line, unnest(range(0, len(string_split(t, chr(10))))) as pos from d)),
dup as (select r, count(*) as n from (select r, row_number() over (partition by r, line order by pos) as k from ln where words > 0) where k > 1 group by r),
freq as (select source, norm from ln where words > 0 group by source, norm having count(distinct t) > 10),
gone as (select ln.r, sum(ln.words) as n from ln join freq on ln.source is not distinct from freq.source and ln.norm = freq.norm where ln.words > 0 group by ln.r),
s as (select w.doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars, len(regexp_extract_all(w.t, '[#*$%&|<>]')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(gone.n, 0) as gone
  from w left join dup on dup.r = w.r left join rep on rep.r = w.r left join gone on gone.r = w.r)
select cast(doc_id as bigint) as doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, cast(gone as bigint) as n_removed_words,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not (n_words - gone < 20 or 100 * gone > 70 * n_words) as kept
from s
"""

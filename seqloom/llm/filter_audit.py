"""How five document filters interact in every order, from one pass of a byte transducer over each text.

The transducer is two tables over (state, byte): the state says whether the last byte
lay in a word, the output bits mark word starts, capitals, code points and symbols. Its
next state depends on the byte alone, so a whole slice of texts runs as array lookups. Word
spans go into an open-addressing table, where words count as equal only if all their bytes
are. What is left of a document is a mask of the filters it fails; orders and steps are
worked out on counts of masks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import drop_written, text_slices, utf8_views, written

FILTERS = "ABCDE"
MIN_WORDS = 200  # A
MIN_DISTINCT_PERCENT = 50  # B
MAX_CAPITAL_PERCENT = 3  # C
SYMBOLS = b"#$%&*|"  # D

GAP, WORD = 0, 1  # states
START, CAPITAL, POINT, SYMBOL = 1, 2, 4, 8  # outputs

_U = np.uint64
_MEASURES = "doc_id bigint, part string, text_hash binary, n_words bigint, n_distinct bigint, n_capitals bigint, n_points bigint, n_symbols bigint"


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, output bits), each 2 x 256: state before the byte, byte of UTF-8."""
    step = np.full((2, 256), WORD, np.uint8)
    step[:, [0x20, *range(0x09, 0x0E)]] = GAP
    out = np.zeros((2, 256), np.uint8)
    out[GAP, step[GAP] == WORD] |= START
    out[:, ord("A") : ord("Z") + 1] |= CAPITAL
    out[:, [b for b in range(256) if b & 0xC0 != 0x80]] |= POINT
    out[:, list(SYMBOLS)] |= SYMBOL
    return step, out


STEP, OUT = transducer()
_OUT_FLAT = OUT.reshape(-1)


def outputs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state after, output) of every byte; each text starts between words."""
    after = STEP[GAP][data]  # both rows are the same: the state before plays no part
    before = np.zeros(len(data), np.uint16)
    before[1:] = after[:-1]
    before[at[:-1][at[:-1] < len(data)]] = GAP
    return after, _OUT_FLAT[(before << 8) | data]


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), at))


def _blocks(data: np.ndarray, start: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each start as a number, those past `left` as zeros; data is padded by eight."""
    x = np.lib.stride_tricks.sliding_window_view(data, 8)[start].view("<u8").reshape(-1)
    short = np.minimum(left, 8).astype(_U)
    return x & np.where(short == 8, _U(2**64 - 1), (_U(1) << (short * _U(8))) - _U(1))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = _mix(seed.astype(_U) * _U(0x9E3779B97F4A7C15) + length.astype(_U))
    rest = np.arange(len(start))
    offset = 0
    while len(rest):
        h[rest] = _mix(h[rest] * _U(0xA0761D6478BD642F) + _blocks(data, start[rest] + offset, length[rest] - offset))
        offset += 8
        rest = rest[length[rest] > offset]
    return h


def same_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j have the same bytes, compared eight at a time."""
    same = length[i] == length[j]
    rest = np.flatnonzero(same)
    offset = 0
    while len(rest):
        a, b, left = i[rest], j[rest], length[i[rest]] - offset
        equal = _blocks(data, start[a] + offset, left) == _blocks(data, start[b] + offset, left)
        same[rest[~equal]] = False
        offset += 8
        rest = rest[equal & (left > 8)]
    return same


def first_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which words are their text's first with these bytes: one owner for each slot of a hash table, verified by bytes."""
    n = len(start)
    bits = max(4, int(2 * n).bit_length())
    slots = np.full(1 << bits, -1, np.int64)
    at = (word_hashes(data, start, length, text) >> _U(64 - bits)).astype(np.int64)
    first = np.zeros(n, bool)
    rest = np.arange(n)
    while len(rest):
        owner = slots[at[rest]]
        empty = rest[owner < 0]
        slots[at[empty[::-1]]] = empty[::-1]  # of several words the earliest gets the slot
        owner = slots[at[rest]]
        own = owner == rest
        first[rest[own]] = True
        rest, owner = rest[~own], owner[~own]
        known = text[rest] == text[owner]
        known[known] = same_words(data, start, length, rest[known], owner[known])
        rest = rest[~known]
        at[rest] = (at[rest] + 1) & ((1 << bits) - 1)
    return first


def measure(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(words, distinct words, capitals, code points, symbols) of every text, as columns of an array."""
    after, out = outputs(data, at)
    start = np.flatnonzero(out & START)
    text = np.searchsorted(at, start, "right") - 1
    gaps = np.append(np.flatnonzero(after == GAP), len(data))
    length = np.minimum(gaps[np.searchsorted(gaps, start)], at[text + 1]) - start
    padded = np.append(data, np.zeros(8, np.uint8))
    first = first_words(padded, start, length, text)
    n = len(at) - 1
    words, distinct = np.bincount(text, minlength=n), np.bincount(text[first], minlength=n)
    points = np.diff(at) - _per_text((out & POINT) == 0, at)
    return np.stack([words, distinct, _per_text(out & CAPITAL, at), points, _per_text(out & SYMBOL, at)], 1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split(" ")[0] for c in _MEASURES.split(", ")]
    for batch in text_slices(batches, "text"):
        data, at = utf8_views(batch.column(2))
        data, at = data[at[0] : at[-1]], at - at[0]
        raw = memoryview(data)
        hashes = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        counts = measure(data, at)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(hashes, pa.binary()), *(pa.array(np.ascontiguousarray(c), pa.int64()) for c in counts.T)], names)


def measures(docs: DataFrame, part: str = "lang") -> DataFrame:
    """A row per document: doc_id, part, text_hash, n_words, n_distinct, n_capitals, n_points, n_symbols.

    Null texts are empty, a null part is the empty string. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(_measured, _MEASURES)


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failures(docs: DataFrame, part: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(doc_id, part, fails, n), and the written rows they come from: documents counted by the mask of filters they fail, bit i for the i-th letter.

    E fails where a smaller doc_id has the same text (equal 128-bit hashes), anywhere
    in the table. A null doc_id is smaller than none and fails E never. Repeated rows have
    one doc_id and don't fail by each other. Copies are counted before rows move, and
    are joined by (text, doc_id), so a text with many copies is no hot key.
    """
    m = measures(docs, part)
    alone = (
        F.when(F.col("n_words") < MIN_WORDS, _bit("A")).otherwise(0)
        + F.when(100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"), _bit("B")).otherwise(0)
        + F.when(100 * F.col("n_capitals") > MAX_CAPITAL_PERCENT * F.col("n_points"), _bit("C")).otherwise(0)
        + F.when(F.col("n_symbols") > 0, _bit("D")).otherwise(0)
    )
    rows = written(m.select("doc_id", "part", "text_hash", alone.alias("fails")), "measures")
    texts = rows.groupBy("text_hash", "doc_id", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return texts.join(least, ["text_hash", "doc_id"], "left").select("doc_id", "part", (F.col("fails") + F.when(again, _bit("E")).otherwise(0)).alias("fails"), "n"), rows


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) of all orders."""
    return [("".join(p), k + 1, _bit(p[k]), sum(map(_bit, p[:k]))) for p in permutations(FILTERS) for k in range(len(p))]


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row per part, order of the five filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    docs has doc_id, text and the part column, labels doc_id, quality and toxic. A
    document is good or toxic if any label row of its id says 1; null ids have no labels.
    Null texts are empty (they fail A), texts of any length are measured whole,
    repeated rows count each. An empty table gives no row; other columns are ignored.

    shapley is the sum over all orders of what a step's filter removes: a document that
    fails m filters falls to each of them in one m-th of the orders.
    """
    failed, measured = failures(docs, part)
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    masks = failed.join(known, "doc_id", "left").groupBy("part", "fails").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    masks = written(masks, "masks")
    n_orders = len(list(permutations(FILTERS)))
    steps = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("own"), F.lit(e).alias("earlier")) for o, s, b, e in orders()]))
    each = masks.select("*", steps.alias("s")).select("part", "fails", "n", "good", "toxic", "s.*")
    fails, gone = F.col("fails").bitwiseAND(F.col("own")) > 0, F.col("fails").bitwiseAND(F.col("earlier")) > 0
    here = fails & ~gone
    total = lambda condition, n="n": F.sum(F.when(condition, F.col(n) if isinstance(n, str) else n).otherwise(0))
    out = each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("fails") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, F.expr(f"n * ({n_orders} div bit_count(fails))")).alias("shapley"),
    )
    drop_written(measured)
    return out


#: The same for tables `documents` and `labels` in SQL, shapley by summing over all orders.
SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
least as (select t, min(doc_id) as first from d group by t),
m as (select d.doc_id, d.part,
    case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
    + case when 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 3 * length(d.t) then 4 else 0 end
    + case when regexp_matches(d.t, '[#$%&*|]') then 8 else 0 end + case when d.doc_id > least.first then 16 else 0 end as fails
  from d join least on least.t = d.t),
l as (select doc_id, max(coalesce(cast(quality = 1 as int), 0)) as good, max(coalesce(cast(toxic = 1 as int), 0)) as toxic from labels group by doc_id),
masks as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from m left join l on l.doc_id = m.doc_id group by part, fails),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as letter, unnest([1, 2, 4, 8, 16]) as own),
o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.own, b.own, c.own, d.own, e.own] as bits from f a, f b, f c, f d, f e
  where a.own + b.own + c.own + d.own + e.own = 31 and len(list_distinct([a.own, b.own, c.own, d.own, e.own])) = 5),
s as (select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier from o, range(1, 6) as u(step)),
r as (select part, filter_order, step, own,
    sum(case when fails & (own | earlier) = 0 then n else 0 end) as kept,
    sum(case when fails & own > 0 and fails & earlier = 0 then n else 0 end) as removed,
    sum(case when fails & own > 0 and fails & earlier > 0 then n else 0 end) as redundant,
    sum(case when fails = own then n else 0 end) as unique_fails,
    sum(case when fails & own > 0 and fails & earlier = 0 then good else 0 end) as good_lost,
    sum(case when fails & own > 0 and fails & earlier = 0 then toxic else 0 end) as toxic_lost
  from masks, s group by all)
select part, filter_order, cast(step as int) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley
from r
"""

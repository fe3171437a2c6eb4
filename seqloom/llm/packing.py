"""Best-fit packing with large-item matching: documents become gapless fixed-capacity sequences."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.llm.common import drop_written, text_slices, written
from seqloom.llm.vocab import piece_encoder, public_tokenizer

CAPACITY = 2048
END_ID = 0

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


@dataclass(frozen=True)
class Placement:
    """Pieces of one length, numbered first..last-1, go `per` to a sequence from `sequence` on, side by side from `offset`."""

    length: int
    first: int
    last: int
    sequence: int
    per: int
    offset: int


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Placement]:
    """Where the pieces of every length go; works on counts of lengths only.

    Lengths above a third of the capacity are matched first: from the longest
    down, each takes the longest partner that still fits, at most two to a
    sequence. On such threshold graphs this greedy matching is a largest one. The
    other lengths, longest first, fill the tightest gap that takes them, then open
    sequences of their own. The plan's size depends on the capacity alone.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must lie in 1..{capacity}")
    used = dict.fromkeys(left, 0)
    plan: list[Placement] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, how many)
    order: list[int] = []  # the gaps in use, sorted
    opened = 0

    def put(length: int, sequence: int, bins: int, per: int, offset: int, n: int | None = None) -> None:
        n = bins * per if n is None else n
        plan.append(Placement(length, used[length], used[length] + n, sequence, per, offset))
        used[length] += n
        left[length] -= n

    def free(gap: int, sequence: int, bins: int) -> None:
        if gap > 0 and bins > 0:
            if gap not in gaps:
                bisect.insort(order, gap)
                gaps[gap] = []
            gaps[gap].append((sequence, bins))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and (not left[large[at]] or (large[at] == length and left[length] < 2)):
                at -= 1
            if at < 0:
                n = left[length]
                put(length, opened, n, 1, 0)
                free(capacity - length, opened, n)
            elif large[at] == length:
                n = left[length] // 2
                put(length, opened, n, 2, 0)
                free(capacity - 2 * length, opened, n)
            else:
                n = min(left[length], left[large[at]])
                put(length, opened, n, 1, 0)
                put(large[at], opened, n, 1, length)
                free(capacity - length - large[at], opened, n)
            opened += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                bins = -(-left[length] // (capacity // length))
                free(capacity, opened, bins)
                opened += bins
                continue
            gap = order[at]
            sequence, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            per, n = gap // length, left[length]
            whole = min(bins, n // per)
            if whole:
                put(length, sequence, whole, per, capacity - gap)
                free(gap - per * length, sequence, whole)
            if whole < bins and left[length]:  # the last pieces: one sequence takes fewer
                n = left[length]
                put(length, sequence + whole, 1, per, capacity - gap, n)
                free(gap - n * length, sequence + whole, 1)
                whole += 1
            free(gap, sequence + whole, bins - whole)
    return plan


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, part = piece_encoder(path), TaskContext.get().partitionId()
    seen: dict[int, int] = {}  # pieces of each length so far: at most `capacity` numbers
    end = np.array([END_ID], "<u4").tobytes()
    for batch in text_slices(batches, "text"):
        rows = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
            ids += end
            n = len(ids) // 4
            start, piece, length = 0, 0, (n - 1) % capacity + 1
            while start < n:
                nth = seen.get(length, 0)
                seen[length] = nth + 1
                rows.append((doc_id, piece, start, length, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)]), part, nth))
                start, piece, length = start + length, piece + 1, capacity
        names = [c.split(" ")[0] for c in PIECE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents (doc_id, text) into as few sequences as the method finds.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A document is its ids and an end id; a null or empty text is
    the end id alone. Only longer documents are cut, from their end, so the first piece
    may be shorter. Repeated rows are packed each on its own; an empty table gives no
    row; other columns are ignored.

    The pieces are numbered within their length by task and then across tasks,
    and the plan over the counts of lengths (at most `capacity` numbers,
    whatever the input) tells the place of each number. No document is moved.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizer("byte_bpe_50k.json")
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda b: _piece_rows(b, path, capacity), PIECE_SCHEMA)
    pieces = written(found, "pieces")
    counts = written(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    plan = sorted(packing_plan(totals, capacity), key=lambda p: (p.length, p.first))
    table = spark.sparkContext.broadcast(np.array([(p.length, p.first, p.sequence, p.per, p.offset) for p in plan], np.int64).reshape(-1, 5))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    based = pieces.join(counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")), ["length", "part"])
    based = based.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, first, sequence, per, offset = table.value.T
        key = lengths * (1 << 46) + first
        for batch in batches:
            length, nth = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(key, length * (1 << 46) + nth, "right") - 1
            into, within = np.divmod(nth - first[at], per[at])
            cols = [*batch.columns[:5], pa.array(sequence[at] + into), pa.array(offset[at] + within * length)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    packed = written(based.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"), "packed")
    drop_written(pieces, counts)
    return packed

"""Near duplicates by DartMinHash: weighted word shingles, sparse signatures, banded joining.

Darts fall on the plane of every element: unit cells of (weight, rank) get a
Poisson number of darts, each with a rank and a random coordinate, all from hashes of
the element and the cell, so equal elements get equal darts everywhere. A text owns
the darts below its elements' weights; for each coordinate the dart of least rank is
kept. Two texts agree in a coordinate with the probability of their weighted Jaccard
similarity. The ranks looked at shrink with the text's weight, so a signature costs
about the same for short and long texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import components, drop_written, text_slices, unused, utf8_views, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5  # a pair of similarity 0.8 shares a band with probability 0.9999
COORDINATES = BANDS * BAND_ROWS
BLOCK_BYTES = 1 << 20  # of shingles held against each other at once

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_U = np.uint64

_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[b for b in range(128) if chr(b).isalnum() or b == 95]] = True

_SIGS = "row bigint, doc_id bigint, k1 bigint, k2 bigint, n bigint, bands array<bigint>"


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64 well-mixed bits of every value."""
    x = x + _U((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B, _U), np.full(n, _B_INVERSE, _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _size(n: int) -> int:
    return max(1 << 21, 1 << int(n).bit_length())


def elements(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weighted shingles of many texts as (text, hash): the m-th copy of a shingle in a text is an element of its own.

    Words are runs of letters and digits (bytes of lower-case UTF-8 text; any
    byte above 127 counts). A text of fewer than SHINGLE words is one shingle.
    """
    word = _WORD[data]
    edge = word.copy()
    edge[1:] = word[1:] & ~word[:-1]
    edge[at[:-1][(at[:-1] < at[1:])]] = word[at[:-1][(at[:-1] < at[1:])]]
    starts = np.flatnonzero(edge)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    stop = np.append(~word, True)
    stop[at[1:]] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, "right")]
    up, down = _powers(_size(len(data)))
    total = np.concatenate([np.zeros(1, _U), np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)])])
    words = mixed((total[ends] - total[starts]) * down[starts], 1)
    text = np.searchsorted(at, starts, "right") - 1
    first = np.searchsorted(text, np.arange(len(at)))  # of each text's words
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - SHINGLE + 1, 1), 0)
    of = np.repeat(np.arange(len(n)), n)
    begin = first[:-1][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    last = first[1:][of]
    h = np.zeros(len(of), _U)
    for j in range(SHINGLE):
        here = begin + j
        h = h * _U(0xD6E8FEB86659FD93) + np.where(here < last, words[np.minimum(here, len(words) - 1)], _U(j))
    h = mixed(h, 2)
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    copy = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return of, mixed(h + copy.astype(_U) * _U(0xA0761D6478BD642F), 3)


#: Upper bounds of 64-bit hashes for 0, 1, 2, ... darts in a unit cell: the Poisson distribution of mean 1.
_POISSON = np.array([int(2**64 * min(1 - 2**-53, sum(0.36787944117144233 / f for f in fs))) for fs in ([1], [1, 1], [1, 1, 2], [1, 1, 2, 6], [1, 1, 2, 6, 24], [1, 1, 2, 6, 24, 120], [1, 1, 2, 6, 24, 120, 720], [1, 1, 2, 6, 24, 120, 720, 5040])], _U)
_NONE = _U(2**64 - 1)


def signatures(of: np.ndarray, h: np.ndarray, texts: int, k: int = COORDINATES) -> np.ndarray:
    """texts x k values of 24 bits: for each coordinate the dart of least rank. Texts without elements get zeros."""
    best = np.full(texts * k, _NONE, _U)
    weight = np.bincount(of, minlength=texts)
    reach = np.ceil(k * (np.log(k) + 4) / np.maximum(weight, 1)).astype(np.int64)  # cells of rank that leave few coordinates without a dart
    low = np.zeros(texts, np.int64)
    active = weight > 0
    while active.any():
        cells = np.where(active, reach - low, 0)
        use = active[of]
        own, at = of[use], h[use]
        n = cells[own]
        cell = np.repeat(low[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own, z = np.repeat(own, n), mixed(np.repeat(at, n) + cell.astype(_U) * _U(0xE7037ED1A0B428DB), 4)
        darts = np.searchsorted(_POISSON, z, "right")
        nth = np.arange(darts.sum()) - np.repeat(np.cumsum(darts) - darts, darts)
        own, cell = np.repeat(own, darts), np.repeat(cell, darts)
        z = mixed(np.repeat(z, darts) + nth.astype(_U) * _U(0x8EBC6AF09C88C6E3), 5)
        coordinate = ((z >> _U(40)) * _U(k)) >> _U(24)
        rank = (np.minimum(cell, 4095).astype(_U) << _U(28)) | (z & _U(0xFFFFFFF))
        value = mixed(z, 6) & _U(0xFFFFFF)
        np.minimum.at(best, own * k + coordinate.astype(np.int64), (rank << _U(24)) | value)
        open_ = (best.reshape(texts, k) == _NONE).any(1) & active & (reach < 4096)
        low, reach, active = np.where(open_, reach, low), np.where(open_, 2 * reach, reach), open_
    sig = (best & _U(0xFFFFFF)).astype(np.uint32).reshape(texts, k)
    sig[weight == 0] = 0
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    rows = sig.astype(_U).reshape(len(sig), BANDS, BAND_ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U), rows.shape[:2]).copy()
    for j in range(BAND_ROWS):
        h = mixed(h * _U(0xD6E8FEB86659FD93) + rows[:, :, j], 7)
    return h.view(np.int64)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8_views(pa.array([(t or "").lower() for t in column.to_pylist()], pa.string()))
    return data[at[0] : at[-1]], at - at[0]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in text_slices(batches, "text"):
        n = batch.num_rows
        of, h = elements(*_lowered(batch.column(3)))
        sig = signatures(of, h, n)
        weight = np.bincount(of, minlength=n)
        bands = band_hashes(sig)
        offsets = np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)
        cols = [pa.array(np.arange(row, row + n)), *batch.columns[:3], pa.array(weight), pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1)))]
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "k1", "k2", "n", "bands"])
        row += n


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        of, h = elements(*_lowered(batch.column(1)))
        ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
        sets = [np.sort(h[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])


def _keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), "text")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is high enough, written."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"), "links")


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the wanted rows (node, doc_id, k1, k2), written."""
    w = wanted.select("node", F.col("doc_id").alias("_w_doc"), F.col("k1").alias("_w1"), F.col("k2").alias("_w2"))
    same = (F.col("k1") == F.col("_w1")) & (F.col("k2") == F.col("_w2")) & F.col("doc_id").eqNullSafe(F.col("_w_doc"))
    own = _keys(docs).join(w, same).select("node", "text").dropDuplicates(["node"])  # of repeated rows one
    return written(own.mapInArrow(_shingled, "node bigint, set binary"), "shingles")


def shared_elements(x: np.ndarray, sorted_elements: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """How many of x's elements each owner of the sorted elements has."""
    low, high = np.searchsorted(sorted_elements, x, "left"), np.searchsorted(sorted_elements, x, "right")
    n = high - low
    at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.bincount(owner[at], minlength=owners)


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """Links between texts that share a bucket but no component yet, written; links that join nothing new are left out.

    In each bucket the texts outside its first component are held against all of the
    bucket, block by block and exactly: a row of the join is a pair of blocks of about
    BLOCK_BYTES, and only links come out of it.
    """
    lead = members.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.sum(F.length("set") + 64).alias("bytes")).where("least < most")
    rows = members.join(lead, "bucket").withColumn("n_blocks", F.expr(f"cast(ceil(bytes / {BLOCK_BYTES}) as bigint)"))
    rows = rows.withColumn("block", F.expr("pmod(xxhash64(node), n_blocks)"))
    packed = F.collect_list(F.struct("node", "component", "set")).alias("rows")  # about BLOCK_BYTES
    every = rows.groupBy("bucket", "block").agg(packed)
    rest = rows.where("component <> least").groupBy("bucket", "n_blocks", "block").agg(packed)
    asking = rest.select("bucket", F.col("rows").alias("x"), F.explode(F.expr("sequence(0, n_blocks - 1)")).alias("block"))
    blocks = asking.join(every.select("bucket", "block", F.col("rows").alias("y")), ["bucket", "block"]).select("x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = x.values, y.values
                sets = [np.frombuffer(v, _U) for v in y.field("set").to_pylist()]
                size = np.array([len(v) for v in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                nodes, group = y.field("node").to_pylist(), y.field("component").to_numpy().copy()
                links = []
                for node, component, own in zip(x.field("node").to_pylist(), x.field("component").to_pylist(), x.field("set").to_pylist()):
                    own = np.frombuffer(own, _U)
                    both = shared_elements(own, flat, owner, len(sets))
                    near = np.flatnonzero((both >= similarity * (len(own) + size - both)) & (group != component))
                    links += [(node, nodes[j]) for j in near[np.unique(group[near], return_index=True)[1]]]  # one a component
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return written(blocks.mapInArrow(compare, "a bigint, b bigint").distinct(), "links")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    signed = written(_keys(docs).mapInArrow(_sign, _SIGS), "signed")
    nodes = written(signed.groupBy("k1", "k2").agg(F.min("row").alias("node")), "nodes")
    texts = signed.where("n > 0").join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    buckets = written(texts.select("node", F.explode("bands").alias("bucket")), "buckets")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", "first")
    crowded = written(buckets.join(shared, "bucket"), "crowded")
    pairs = written(crowded.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    sets = _texts_of(docs, texts.select("node", "doc_id", "k1", "k2").join(crowded.select("node"), "node", "left_semi"))
    links = _verified(pairs, sets, similarity)
    linked = components(links)
    members = crowded.select("bucket", "node").join(linked, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    apart = written(members.groupBy("bucket").agg(F.min("component").alias("l"), F.max("component").alias("m")).where("l < m").select("bucket"), "apart")
    more = _across(members.join(apart, "bucket", "left_semi").join(sets, "node"), similarity)
    reached = linked if more.isEmpty() else components(links.unionByName(more))
    rows = signed.select("row", "doc_id", "k1", "k2", "n").join(nodes, ["k1", "k2"]).join(reached, "node", "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "node")).otherwise(F.col("row")).alias("component")
    rows = written(rows.select("row", "doc_id", "k1", "k2", F.col("n").alias("n_shingles"), component), "classes")
    best = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("d"), F.col("row").alias("r"))).alias("best"))
    out = rows.join(best, "component").select("doc_id", "k1", "k2", "n_shingles", F.col("best.d").alias("component_id"), (F.col("row") == F.col("best.r")).alias("kept"))
    out = written(out, "near-duplicates")
    drop_written(signed, nodes, buckets, crowded, pairs, sets, links, apart, more, rows)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id among the documents that links reach; kept marks
    one document of each component (that doc_id; the first of repeated ones). Texts
    are linked if their multisets of five-word shingles have a weighted Jaccard
    similarity of `similarity` or more; candidates come from shared bands. Null texts and
    texts without words are linked with nothing and kept. A null doc_id is the smallest.
    An empty table gives no row; other columns are ignored.

    Equal texts are merged first. In a bucket every text is checked against the
    first; texts that stay outside its component are then held against all of the
    bucket in blocks, so no link is lost and no list of pairs is formed within a group.
    """
    return _classes(docs, similarity).drop("k1", "k2")


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component (see near_duplicates), once; same columns.

    Null texts and texts without words all stay; of rows with one doc_id and text, which
    can differ in other columns only, one stays; an empty table gives no row; columns may
    have any names.
    """
    d, w1, w2, k0, k1, k2 = unused(docs.columns, "d", "w1", "w2", "k0", "k1", "k2")
    kept = _classes(docs, similarity).where("kept").select(F.col("doc_id").alias(d), F.col("k1").alias(w1), F.col("k2").alias(w2))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("*", F.col("doc_id").cast("bigint").alias(k0), F.xxhash64(text).alias(k1), F.xxhash64(F.lit(1), text).alias(k2))
    rows = rows.join(kept, (F.col(k1) == F.col(w1)) & (F.col(k2) == F.col(w2)) & F.col(k0).eqNullSafe(F.col(d)), "left_semi")
    return rows.dropDuplicates([k0, k1, k2]).select(*docs.columns)

"""Nearest training vector under the same label through pivots: triangle bounds rule out, the rest is verified.

Some training vectors of a label are its pivots. Every training vector belongs to the cell of
its nearest pivot and, by its distance from it, to a ring of that cell. For a test vector q and
a ring with distances from low to high around pivot p no member is nearer than
d(q, p) - high, low - d(q, p) or (d(q, p) - d(q, nearest pivot)) / 2. A test vector first visits
the ring of least bound, then every ring whose bound is below what it has found. The answer
is exact; what is saved depends on how clustered the vectors are.

Rings decide what is compared, parts what is sent: neighbouring rings share a part, and a test
vector goes at most once to each part, with a bit for every ring that it asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seqloom.session import shared_dir

PIVOTS = 64  # of a label at most: the square root of its training vectors where that is less
RINGS = 8  # of a cell
BLOCK = 128  # vectors whose nearest pivots are sought at once
ASKING = 512  # test vectors that go together
SHELF = 8192  # training vectors in a row
PARTS = 64  # of a label at most: so often a test vector is sent; beyond, a part holds several shelves
_CELLS = 1 << 17  # differences held at once: they stay in cache
_SLACK = 1e-9  # relative; bounds and distances are sums of rounded numbers


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mean absolute differences of all rows of x and y."""
    return np.stack([np.abs(y - one).sum(axis=1) for one in x]) / x.shape[1] if len(x) else np.zeros((0, len(y)))


def ring_bounds(to_pivots: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, rings): what no member of a ring can be nearer than."""
    d = to_pivots[:, cell]
    apart = (d - to_pivots.min(axis=1, keepdims=True)) / 2
    bound = np.maximum(np.maximum(d - high, low - d), apart)
    return np.maximum(bound - _SLACK * (d + high), 0)


def nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Each row's least mean absolute difference from a row of y."""
    step = max(1, _CELLS // max(1, y.size))
    return np.concatenate([np.abs(x[i : i + step, None] - y).sum(axis=2).min(axis=1) for i in range(0, len(x), step)]) / x.shape[1]


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Adds `block`: rows of equal labels in blocks of about that size."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    return rows.join(n, "label").withColumn("block", F.expr(f"pmod(xxhash64(vec), cast(ceil(_n / {size}) as bigint))")).drop("_n")


def nearest_by_pivots(clips: DataFrame, dims: int, pivots: int = PIVOTS) -> DataFrame:
    """clip_id, label, dmin, compared for every test clip whose label has training clips.

    clips: clip_id, label, fold, vec (``dims`` doubles); dmin is the least mean absolute difference from a
    training vector of the label, ``compared`` how many of its different training vectors were looked at.
    Equal vectors are merged first. A label of any size is spread over shelves; per label only its
    pivots and the extent of its rings (at most PIVOTS * RINGS) are ever in one row. No vector is sent
    more than PARTS times a round, however large the label is; what is compared can still grow with its square.
    """
    spark = clips.sparkSession
    shared_dir(spark)
    train = clips.filter("fold = 'train'").select("label", "vec").distinct()
    sizes = train.groupBy("label").agg(F.count("*").alias("n"))
    first = W.partitionBy("label").orderBy(F.xxhash64("vec"), "vec")
    some = train.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= pivots)
    some = some.join(sizes, "label").filter(F.col("k") <= F.greatest(F.lit(1), F.floor(F.sqrt("n"))))
    centres = some.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "vec"))).alias("p")).select("label", F.col("p.vec").alias("pivots"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = batch.column(1)[i].values
                d = distances(_vectors(v, dims), _vectors(batch.column(2)[i].values, dims))
                cols = [batch.column(0).take(pa.array([i] * len(v))), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1)), v]
                yield pa.RecordBatch.from_arrays(cols, ["label", "cell", "r", "vec"])

    kind = clips.schema["label"].dataType.simpleString()
    dealt = _dealt(train, BLOCK).groupBy("label", "block").agg(F.collect_list("vec").alias("vecs"))
    placed = dealt.join(centres, "label").select("label", "vecs", "pivots").mapInArrow(place, f"label {kind}, cell int, r double, vec array<double>").checkpoint()
    cuts = placed.groupBy("label", "cell").agg(F.percentile_approx("r", [i / RINGS for i in range(1, RINGS)], 1000).alias("cuts"))
    ringed = placed.join(cuts, ["label", "cell"]).withColumn("ring", F.size(F.filter(F.array_distinct("cuts"), lambda c: c <= F.col("r")))).drop("cuts")
    # a label's rings in order; a vector's place among the label's vectors gives its shelf, and shelves next to each other make a part
    extent = ringed.groupBy("label", "cell", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    order, label = W.partitionBy("label").orderBy("cell", "ring"), W.partitionBy("label")
    extent = extent.select("*", (F.row_number().over(order) - 1).alias("slot"), (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(label).alias("_all"))
    extent = extent.withColumn("shelves", F.expr(f"cast(ceil(_all / {SHELF}) as bigint)"))
    part = f"cast((({{}}) div {SHELF}) * least({PARTS}, shelves) div shelves as int)"
    at = "before + pmod(xxhash64(vec), n)"
    shelved = ringed.join(extent.drop("low", "high"), ["label", "cell", "ring"]).select("label", F.expr(part.format(at)).alias("part"), F.expr(f"({at}) div {SHELF}").alias("shelf"), "slot", "vec")
    shelves = shelved.groupBy("label", "part", "shelf").agg(F.collect_list(F.struct("slot", "vec")).alias("members")).checkpoint()
    ends = extent.select("label", F.struct("slot", "cell", "low", "high", F.expr(part.format("before")).alias("first"), F.expr(part.format("before + n - 1")).alias("last")).alias("ring"))
    guide = centres.join(ends.groupBy("label").agg(F.array_sort(F.collect_list("ring")).alias("rings")), "label")

    def ask(round_: int):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    tests = batch.column(1)[i].values
                    vecs = tests.field("vec")
                    rings = batch.column(3)[i].values
                    cell, low, high, first, last = (rings.field(c).to_numpy() for c in ("cell", "low", "high", "first", "last"))
                    to = distances(_vectors(vecs, dims), _vectors(batch.column(2)[i].values, dims))
                    bound = ring_bounds(to, cell, low, high)
                    # rings around the query itself come first among equal bounds
                    start = np.lexsort((np.abs(to[:, cell] - (low + high) / 2).T, bound.T), axis=0)[0]
                    if round_ == 1:
                        open_ = np.zeros(bound.shape, bool)
                    else:
                        best = np.minimum(tests.field("best").to_numpy(zero_copy_only=False), to.min(axis=1))
                        open_ = bound < best[:, None]
                    open_[np.arange(len(start)), start] = round_ == 1
                    bits = pa.array([b.tobytes() for b in np.packbits(open_, axis=1)], pa.binary())
                    asking = pa.StructArray.from_arrays([vecs, bits], ["vec", "open"])
                    for p in range(last.max() + 1):
                        who = np.flatnonzero(open_[:, (first <= p) & (p <= last)].any(axis=1))
                        if len(who):
                            lists = pa.ListArray.from_arrays(pa.array([0, len(who)], pa.int32()), asking.take(pa.array(who)))
                            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([p], pa.int32()), lists], ["label", "part", "asking"])

        return task

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asking, members = batch.column(1)[i].values, batch.column(2)[i].values
                x, y = _vectors(asking.field("vec"), dims), _vectors(members.field("vec"), dims)
                open_ = np.unpackbits(np.frombuffer(b"".join(asking.field("open").to_pylist()), np.uint8).reshape(len(x), -1), axis=1)
                slot = members.field("slot").to_numpy()
                order = np.argsort(slot, kind="stable")
                slots, at = np.unique(slot[order], return_index=True)
                y = y[order]
                d, n = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
                for s, a, b in zip(slots, at, [*at[1:], len(y)]):
                    who = np.flatnonzero(open_[:, s])
                    if len(who):
                        d[who] = np.minimum(d[who], nearest(x[who], y[a:b]))
                        n[who] += b - a
                met = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(met), i))), asking.field("vec").take(met), pa.array(d).take(met), pa.array(n).take(met)], ["label", "vec", "d", "n"])

    def visit(tests: DataFrame, round_: int) -> DataFrame:
        """(label, vec, d, n) of the rings asked in this round."""
        packed = _dealt(tests, ASKING).groupBy("label", "block").agg(F.collect_list(F.struct("vec", "best")).alias("tests"))
        asked = packed.join(guide, "label").select("label", "tests", "pivots", "rings")
        asked = asked.mapInArrow(ask(round_), f"label {kind}, part int, asking array<struct<vec: array<double>, open: binary>>")
        pairs = asked.join(shelves, ["label", "part"]).select("label", "asking", "members")
        return pairs.mapInArrow(least, f"label {kind}, vec array<double>, d double, n bigint").groupBy("label", "vec").agg(F.min("d").alias("d"), F.sum("n").alias("n"))

    tests = clips.filter("fold = 'test'").select("label", "vec").distinct().join(sizes.select("label"), "label", "left_semi").withColumn("best", F.lit(float("inf")))
    one = visit(tests, 1).checkpoint()
    two = visit(one.select("label", "vec", F.col("d").alias("best")), 2)
    best = one.unionByName(two).groupBy("label", "vec").agg(F.min("d").alias("dmin"), F.sum("n").alias("compared"))
    return clips.filter("fold = 'test'").select("clip_id", "label", "vec").join(best, ["label", "vec"]).select("clip_id", "label", "dmin", "compared")

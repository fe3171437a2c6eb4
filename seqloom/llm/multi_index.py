"""Near-duplicate embeddings through an inverted multi-index.

The two halves of the unit vectors have a codebook each; their product is a grid of
cells. A vector visits cells in order of how far it lies at least from them: in each
half the distance to the plane that parts its own codeword from another bounds the
move into that codeword's region. The traversal stops at the bound that reaches the
wanted recall; what the visited cells hold is verified by exact cosines. A pair that
only one of its vectors visits is credited to both.

The cells of one codeword of the first half are a row of the grid. A vector is sent
once to each row that it visits, with the visited cells of that row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import components, drop_written, written

COSINE = 0.98
SAMPLE = 20_000  # vectors the codebooks are fitted on: those of smallest id hash
PER_CELL = 64  # codewords a half = sqrt(vectors / PER_CELL)
MAX_CODEWORDS = 2048  # cells keep PER_CELL vectors up to 268 million of one length; beyond, they grow
LEAST_INDEXED = 512  # vectors of a length that get codebooks; fewer are one cell, compared in blocks
MOST_INDEXED = 32  # lengths with codebooks: the commonest
RECALL = 0.9999  # of vectors moved in a random direction to just the wanted cosine
LEAST_REACH = 0.25  # of the squared radius, so that moves along few directions are found as well
BLOCK = 256  # vectors of a row of cells, or of a length without codebooks, that are held together
BLOCK_BYTES = 1 << 21  # of doubles: short vectors come in larger blocks, of 16 * BLOCK at most
TILE = 1 << 20  # cosines held at once


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def codebook(x: np.ndarray, k: int, seed: int = 7, rounds: int = 10) -> np.ndarray:
    """k codewords by Lloyd's iterations; empty ones stay where they are."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Grid:
    """Two codebooks and the reach of the traversal."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float = COSINE, recall: float | None = None):
        self.half = sample.shape[1] // 2
        self.books = [codebook(np.ascontiguousarray(part), k) for part in self._halves(sample)]
        self.gaps = [2 * np.sqrt(_distances(c, c)) for c in self.books]
        radius2 = 2 - 2 * cosine
        rng = np.random.default_rng(11)
        x = sample[rng.choice(len(sample), min(4000, len(sample)), replace=False)]
        move = rng.normal(size=x.shape)
        move -= (move * x).sum(1)[:, None] * x
        move /= np.maximum(np.linalg.norm(move, axis=1), 1e-30)[:, None]
        moved = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * move
        a, b = self.bounds(x)
        i, j = np.divmod(self.cells(moved), len(self.books[1]))
        n = np.arange(len(x))
        self.reach = float(min(radius2, max(np.quantile(a[n, i] + b[n, j], RECALL if recall is None else recall), LEAST_REACH * radius2))) + 1e-12

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        i, j = (_distances(p, c).argmin(1) for p, c in zip(self._halves(x), self.books))
        return i * len(self.books[1]) + j

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Least squared move of each half into every codeword's region."""
        out = []
        for part, c, gap in zip(self._halves(x), self.books, self.gaps):
            d = _distances(part, c)
            own = d.argmin(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                out.append(np.where(gap[own] > 0, (d - d[np.arange(len(d)), own][:, None]) / gap[own], 0) ** 2)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visits: of each row and column the nearest cells until the bounds exceed the reach."""
        a, b = self.bounds(x)
        rows, first = np.nonzero(a <= self.reach)
        order = np.argsort(b, axis=1)
        near = np.take_along_axis(b, order, 1)
        n = (near[rows] <= self.reach - a[rows, first][:, None]).sum(1)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(rows, n)
        return q, np.repeat(first, n) * b.shape[1] + order[q, at]

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """The cells' codewords of the first half."""
        return cells // len(self.books[1])

    def visited(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """(vectors, cells): whether each vector visits each of the cells."""
        a, b = self.bounds(x)
        i, j = np.divmod(cells, b.shape[1])
        return b[:, j] <= self.reach - a[:, i]


def _numbers(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length in double precision; doubles are scaled so that no square overflows or vanishes, floats can't."""
    flat = vectors.flatten()
    x = flat.to_numpy().reshape(len(vectors), -1).astype(np.float64)
    return x if pa.types.is_float32(flat.type) else x / np.abs(x).max(1)[:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _grids(groups: DataFrame, cosine: float) -> dict[int, Grid]:
    """A grid for each common length, from a bounded sample of its vectors."""
    sizes = groups.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_INDEXED).orderBy(F.desc("n"), "width").limit(MOST_INDEXED).collect()
    grids = {}
    for width, n in sizes:
        sample = groups.where(F.col("width") == width).select("embedding").orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()
        x = _unit(_numbers(sample.column(0).combine_chunks()))
        grids[width] = Grid(x, int(np.clip(np.sqrt(n / PER_CELL), 2, min(MAX_CODEWORDS, len(x)))), cosine)
    return grids


def _lists(values: pa.Array, starts: np.ndarray) -> pa.ListArray:
    """The values cut into lists that begin at starts."""
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)


class Members:
    """A block of a row: its vectors in the order of their cells."""

    def __init__(self, parts: list[pa.RecordBatch]):
        block = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        cell = block.column("cell").to_numpy()
        order = np.argsort(cell, kind="stable")
        self.x = _numbers(block.column("embedding"))[order]
        self.norm = np.linalg.norm(self.x, axis=1)
        self.node, self.copies = (block.column(c).to_numpy()[order] for c in ("node", "copies"))
        self.cells, first = np.unique(cell[order], return_index=True)
        self.span = np.append(first, len(order))

    def links(self, asking: pa.RecordBatch, grid: Grid | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(node, n, least) of vectors that have links to the others in the visited cells, found on either side."""
        x = _numbers(asking.column("embedding"))
        norm = np.linalg.norm(x, axis=1)
        node, copies, home = (asking.column(c).to_numpy() for c in ("node", "copies", "cell"))
        visits = asking.column("visits")
        asked, who = visits.flatten().to_numpy(), np.repeat(np.arange(len(x)), pa.compute.list_value_length(visits).to_numpy())
        order = np.argsort(asked, kind="stable")
        asked, who = asked[order], who[order]
        for k, (begin, end) in enumerate(zip(np.searchsorted(asked, self.cells), np.searchsorted(asked, self.cells, "right"))):
            own = slice(self.span[k], self.span[k + 1])
            y, b, cb = self.x[own], self.node[own], self.copies[own]
            step = max(1, TILE // len(y))
            for at in range(begin, end, step):
                i = who[at : min(at + step, end)]
                linked = (x[i] @ y.T) / (norm[i][:, None] * self.norm[own][None, :]) >= cosine
                linked &= node[i][:, None] != b[None, :]
                if not linked.any():
                    continue
                i, j = i[linked.any(1)], np.flatnonzero(linked.any(0))
                part = linked[linked.any(1)][:, j]
                # members that visit an asking vector's cell find the pair from there themselves
                back = grid.visited(_unit(y[j]), home[i]).T if grid else np.ones(part.shape, bool)
                left, right = _least(part, node[i], b[j])
                yield node[i], part @ cb[j], left
                yield b[j], copies[i] @ (part & ~back), right


def _least(part: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest node of each one's component, for linked nodes left and right."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(part, right[None, :], top).min(1))
        new_right = np.minimum(right, np.where(part, new_left[:, None], top).min(0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """A row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors of equal, non-null labels and lengths are linked if their cosine is
    `cosine` or more. n_links counts the other rows linked directly, component_id is the
    smallest vec_id that links reach, kept tells whether it is the row's own. Null or
    empty vectors, zero vectors and those with null or non-finite components link with
    nothing, nor does a null vec_id. Repeated rows are vectors of their own. Each length is
    indexed on its own, so a very long vector costs itself alone. An empty table
    gives no row; other columns are ignored.

    Equal vectors are merged before the search and counted by their number. All are
    indexed; only the codebooks come from a sample of at most SAMPLE vectors a length. A
    label's vectors in a row of the grid are held in blocks, and a task searches a block
    for all vectors that visit its row, which pass by in batches.
    """
    spark = vectors.sparkSession
    element = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    # array_contains is null if nan isn't found and a component is null, array_min and array_max are null if there is none; lambdas take longer
    sound = F.expr(f"""vec_id is not null and label is not null and not array_contains(embedding, {element}('nan'))
        and array_min(embedding) > {element}('-infinity') and array_max(embedding) < {element}('infinity') and (array_min(embedding) < 0 or array_max(embedding) > 0)""")
    groups = rows.where(sound).groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    groups = written(groups.withColumn("width", F.size("embedding")), "vectors")
    if groups.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    grids = spark.sparkContext.broadcast(_grids(groups, cosine))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, embedding = batch.column("width").to_numpy(), batch.column("embedding")
            row, cell = np.zeros(len(width), np.int32), np.zeros(len(width), np.int32)
            asked = [np.empty((3, 0), np.int32)]  # vector, row, cell of all visits
            for w in np.unique(width):
                own, grid = np.flatnonzero(width == w), grids.value.get(int(w))
                if grid is None:
                    asked.append(np.stack([own, row[own], cell[own]]))
                    continue
                for at in range(0, len(own), 4096):
                    some = own[at : at + 4096]
                    x = _unit(_numbers(embedding.take(pa.array(some))))
                    cell[some] = grid.cells(x)
                    row[some] = grid.rows(cell[some])
                    q, c = grid.visits(x)
                    asked.append(np.stack([some[q], grid.rows(c), c]))
            asked = np.concatenate(asked, axis=1).astype(np.int32)
            q, r, c = asked[:, np.lexsort(asked[::-1])]
            first = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(r, prepend=-1) != 0))
            of_row = pa.StructArray.from_arrays([pa.array(r[first]), _lists(pa.array(c), first)], ["row", "visits"])
            asks = _lists(of_row, np.searchsorted(q[first], np.arange(len(width))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row), pa.array(cell), asks], [*batch.schema.names, "row", "cell", "asks"])

    key = ["row", "label", "width"]
    columns = groups.select("node", "copies", "label", "width", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema)
    assigned = written(columns.mapInArrow(assign, f"{kinds}, row int, cell int, asks array<struct<row:int,visits:array<int>>>"), "assigned")
    full = f"greatest({BLOCK}, least({16 * BLOCK}, {BLOCK_BYTES} / (8 * width)))"
    blocks = assigned.groupBy(*key).agg(F.expr(f"cast(ceil(count(1) / {full}) as int)").alias("blocks")).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    blocks = written(blocks.withColumn("id", F.monotonically_increasing_id()), "blocks")
    vector = ["node", "copies", "cell", "embedding"]
    members = assigned.withColumn("hash", F.xxhash64("node")).join(blocks, key).where("block = pmod(hash, blocks)")
    members = members.select(F.expr("2 * id").alias("turn"), *vector, F.lit(None).cast("array<int>").alias("visits"))
    asking = assigned.select("label", "width", *vector, F.inline("asks")).join(blocks, key)
    asking = asking.select(F.expr("2 * id + 1").alias("turn"), *vector, "visits")
    searches = members.unionByName(asking).repartition(F.expr("turn div 2")).sortWithinPartitions("turn")  # a block's members, then those who ask

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, members = None, [], None
        for batch in batches:
            turn, out = batch.column("turn").to_numpy(), []
            begins = np.flatnonzero(np.diff(turn, prepend=-1))
            for begin, end in zip(begins, [*begins[1:], len(turn)]):
                run = batch.slice(begin, end - begin)
                block, asks = divmod(int(turn[begin]), 2)
                if block != held:
                    held, parts, members = block, [], None
                if not asks:
                    parts.append(run)
                elif parts:
                    members = members or Members(parts)
                    out.extend(members.links(run, grids.value.get(members.x.shape[1]), cosine))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "n", "least"])

    found = searches.mapInArrow(search, "node bigint, n bigint, least bigint")
    found = written(found.groupBy("node", "least").agg(F.sum("n").alias("n")), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    reached = components(found.select("node", "least"), "node", "least")
    named = groups.join(counts, "node", "left").join(reached, "node", "left")
    # joined on a hash and the label; whole vectors are compared by range, as an equality would be one more key to sort by
    named = named.select(F.xxhash64("embedding").alias("g_hash"), F.col("label").alias("g_label"), F.col("embedding").alias("g_embedding"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    all_rows = rows.withColumn("hash", F.xxhash64("embedding"))
    same = F.col("vec_id").isNotNull() & (F.col("hash") == F.col("g_hash")) & (F.col("label") == F.col("g_label")) & F.col("embedding").between(F.col("g_embedding"), F.col("g_embedding"))
    result = all_rows.join(named, same, "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    result = written(result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "near-vectors")
    drop_written(groups, assigned, blocks, found)
    return result

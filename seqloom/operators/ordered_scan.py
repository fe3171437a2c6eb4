"""Order-dependent recurrences over streams of any length.

Rows are range-partitioned by (stream, order), so a very long stream is spread
over many tasks. Each partition is first folded to a small summary of what it
does to an incoming state; the summaries (one per partition) are chained, and
every partition is then replayed from its true entry state. The result equals
one sequential pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.session import shared_dir


class Scan(Protocol):
    """A recurrence: ``columns`` in, ``outputs`` (name, type) out."""

    columns: list[str]
    outputs: list[tuple[str, T.DataType]]

    def start(self) -> Any: ...

    def run(self, state: Any, rows: dict[str, np.ndarray]) -> tuple[Any, dict[str, Any]]:
        """State after the rows and one output value per row."""

    def identity(self) -> Any: ...

    def fold(self, summary: Any, rows: dict[str, np.ndarray]) -> Any:
        """Summary extended by rows, without knowing the entry state."""

    def resume(self, summary: Any, state: Any) -> Any:
        """State after a summarised run entered with ``state``."""


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Half-open bounds of equal neighbouring keys."""
    if not len(keys):
        return []
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]))


def _rows(batch: pd.DataFrame, columns: list[str], a: int, b: int) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy()[a:b] for c in columns}


def _summarise(scan: Scan, key: str):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = tail = None
        seen = False
        head, state = scan.identity(), None
        for batch in batches:
            keys = batch[key].to_numpy()
            runs = _runs(keys)
            if not runs:
                continue
            if not seen:
                seen, part, first = True, int(batch["_part"].iloc[0]), keys[0]
                tail = first
            a, b = runs[0]
            if keys[a] == first:
                head = scan.fold(head, _rows(batch, scan.columns, a, b))
            a, b = runs[-1]
            if keys[a] != first:  # only the last stream can go on in the next partition
                state = state if keys[a] == tail else scan.start()
                state, _ = scan.run(state, _rows(batch, scan.columns, a, b))
            tail = keys[a]
        if seen:
            yield pd.DataFrame({"part": [part], "blob": [pickle.dumps((first, tail, head, state))]})

    return task


def _replay(scan: Scan, key: str, entry: dict[int, Any], names: list[str]):
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, state, seen = None, None, False
        for batch in batches:
            keys = batch[key].to_numpy()
            pieces: dict[str, list] = {n: [] for n, _ in scan.outputs}
            for a, b in _runs(keys):
                if not seen:
                    seen = True
                    state = entry.get(int(batch["_part"].iloc[0]), None)
                    state = scan.start() if state is None else state
                elif keys[a] != tail:
                    state = scan.start()
                tail = keys[a]
                state, out = scan.run(state, _rows(batch, scan.columns, a, b))
                for n in pieces:
                    pieces[n].append(np.asarray(out[n]))
            if len(keys):
                yield batch[names].assign(**{n: np.concatenate(p) for n, p in pieces.items()})

    return task


def ordered_scan(df: DataFrame, key: str, order: list[str], scan: Scan) -> DataFrame:
    """Adds (or replaces) the scan's outputs on each row of ``df``, per key in ``order``.

    ``order`` must be unique within a key. The sorted rows are checkpointed to
    the shared folder: both passes must see the same partitions even if an
    executor is lost in between.
    """
    shared_dir(df.sparkSession)
    placed = (
        df.repartitionByRange(key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    need = placed.select("_part", key, *scan.columns)
    rows = need.mapInPandas(_summarise(scan, key), "part int, blob binary").collect()  # one per partition
    entry: dict[int, Any] = {}
    last_key = last_state = None
    for r in sorted(rows, key=lambda x: x["part"]):
        first, tail, head, state = pickle.loads(bytes(r["blob"]))
        goes_on = last_key is not None and first == last_key
        state_in = last_state if goes_on else scan.start()
        if goes_on:
            entry[r["part"]] = state_in
        last_key, last_state = tail, (scan.resume(head, state_in) if first == tail else state)
    new = [T.StructField(n, t) for n, t in scan.outputs]
    kept = [f for f in df.schema.fields if f.name not in {n.name for n in new}]
    return placed.mapInPandas(_replay(scan, key, entry, [f.name for f in kept]), T.StructType(kept + new))


class Counter:
    """Number of flagged rows before (exclusive) each row of its stream."""

    def __init__(self, flag: str, output: str):
        self.columns = [flag]
        self.outputs = [(output, T.LongType())]
        self.flag, self.output = flag, output

    def start(self):
        return 0

    def run(self, state, rows):
        f = rows[self.flag].astype(np.int64)
        total = np.cumsum(f) + state
        return int(total[-1]), {self.output: total - f}

    def identity(self):
        return 0

    def fold(self, summary, rows):
        return summary + int(rows[self.flag].astype(np.int64).sum())

    def resume(self, summary, state):
        return state + summary

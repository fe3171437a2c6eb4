"""Structured Streaming twins of the live operators.

State transitions are the scans of operators.segments, so a stream and its
batch replay agree row for row. Per stream the state is a few numbers and, for
emissions, the bounded frame buffer; streams without a buffer share keyed state by shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from seqloom.functions import layout as L
from seqloom.operators import sentences
from seqloom.operators.segments import EnergyScan, RateScan, SegmentScan, wrist_columns
from seqloom.operators.sentences import SentenceScan
from seqloom.session import pickled_by_value

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_keyed_state(spark: SparkSession) -> None:
    """transformWithState needs the RocksDB provider; keeps one already chosen."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        spark.conf.set(PROVIDER, ROCKSDB)


def _columns(pdf: pd.DataFrame, names: list[str]) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in names}


class InOrderProcessor(StatefulProcessor):
    """Holds each key's rows until the watermark passes them and hands them on in order.

    Rows of a later batch may belong before rows of an earlier one; below the
    watermark none can follow any more. The held rows, at most those of the watermark's
    delay, are typed list state; a timer at the last one releases what no later
    input of the key would.
    """

    def __init__(self, key: str, order: list[str], schema: T.StructType):
        self.key, self.order, self.schema = key, [MICROS, *order[1:]], schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def released(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def settled(self, key, watermark: int) -> Iterator[pd.DataFrame]:
        """What the passing of time alone brings, once all rows up to the watermark (in ms) are out."""
        return iter(())

    def _advance(self, key, parts: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        if self.held.exists():
            parts = [pd.DataFrame(list(self.held.get()), columns=names), *parts]
        parts = [p[names] for p in parts if len(p)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True)
            due = pdf[MICROS] <= watermark * 1000
            wait = pdf[~due]
            if len(wait):
                self.held.put([tuple(_plain(v) for v in row) for row in wait.itertuples(index=False)])
                self.handle.registerTimer(int(wait[MICROS].max()) // 1000 + 1)
            else:
                self.held.clear()
            if due.any():
                yield from self.released(key, pdf[due].sort_values(self.order, kind="stable", ignore_index=True))
        yield from self.settled(key, watermark)

    def close(self) -> None:
        pass


MICROS = "event_micros"


def _plain(v):
    """A cell as plain Python, for typed state."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    return v.item() if isinstance(v, np.generic) else v


def _in_order(frames: DataFrame, key: str, order: tuple[str, ...], payload: list[str], watermark: str):
    """The rows grouped by key, with the event time in microseconds, and the schema that is held."""
    f = frames.withColumn(MICROS, F.unix_micros(order[0]))
    by_name = {x.name: x for x in f.schema.fields}
    schema = T.StructType([T.StructField(c, by_name[c].dataType) for c in dict.fromkeys([MICROS, *order[1:], *payload])])
    return f.withWatermark(order[0], watermark).groupBy(key), schema, by_name


SHARDS = 256  # keys of the state; a finished checkpoint keeps its number
_CHUNK = 10_000  # held rows in one element of the state


def _as_arrays(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema.fields])


class ShardProcessor(StatefulProcessor):
    """Holds the rows of a shard of streams until the watermark passes them and runs a scan over each stream's in order.

    A call into keyed state costs milliseconds, far more than a stream's few rows, so one call serves
    all streams of a shard. Held rows and the streams' states are typed columns. Order and
    timers are as in InOrderProcessor.
    """

    def __init__(self, key: str, order: list[str], schema: T.StructType, scan, state: T.StructType, to_row: Callable = tuple, from_row: Callable = tuple):
        self.key, self.order, self.schema, self.scan = key, [MICROS, *order[1:]], schema, scan
        self.kind, self.to_row, self.from_row = T.StructType([schema[key], *state.fields]), to_row, from_row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _as_arrays(self.schema))
        self.states = handle.getValueState("states", _as_arrays(self.kind))

    def step(self, stream, state, rows: dict[str, np.ndarray]) -> tuple:
        """The state after the rows of one stream (None: none yet) and their outputs, each named column an array."""
        state, out = self.scan.run(self.scan.start() if state is None else state, rows)
        return state, [{self.order[-1]: rows[self.order[-1]], **{c: rows[c] for c in self.scan.columns}, **out}]

    def settled(self, states: dict, watermark: int) -> Iterator[tuple]:
        """(stream, its new state, outputs) that the passing of time alone brings, once all rows up to the watermark (in ms) are out."""
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._advance(list(rows), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def _load(self) -> dict:
        if not self.states.exists():
            return {}
        streams, *columns = self.states.get()
        return dict(zip(streams, map(self.from_row, zip(*columns))))

    def _save(self, states: dict) -> None:
        columns = zip(*map(self.to_row, states.values()))
        self.states.update((list(states), *([_plain(v) for v in c] for c in columns)))

    def _advance(self, parts: list[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        names = self.schema.names
        old = [pd.DataFrame(dict(zip(names, map(list, chunk)))) for chunk in self.held.get()] if self.held.exists() else []
        parts = [p[names] for p in (*old, *parts) if len(p)]
        states, changed, found = self._load(), False, []
        if parts:
            pdf = pd.concat(parts, ignore_index=True)
            due = (pdf[MICROS] <= watermark * 1000).to_numpy()
            wait = pdf[~due]
            if len(wait):
                self.held.put([tuple([_plain(v) for v in wait[c].iloc[at : at + _CHUNK]] for c in names) for at in range(0, len(wait), _CHUNK)])
                self.handle.registerTimer(int(wait[MICROS].max()) // 1000 + 1)
            elif old:
                self.held.clear()
            if due.any():
                for stream, rows in self._streams(pdf[due]):
                    states[stream], out = self.step(stream, states.get(stream), rows)
                    found += [(stream, o) for o in out]
                changed = True
        for stream, state, out in self.settled(states, watermark):
            states[stream], changed = state, True
            found += [(stream, o) for o in out]
        if changed:
            self._save(states)
        if found:
            n = [len(o[self.order[-1]]) for _, o in found]
            streams = [stream for (stream, _), k in zip(found, n) for _ in range(k)]
            yield pd.DataFrame({self.key: streams, **{c: np.concatenate([o[c] for _, o in found]) for c in found[0][1]}})

    def _streams(self, pdf: pd.DataFrame) -> Iterator[tuple]:
        """Each stream of the rows and its columns in order."""
        code, streams = pd.factorize(pdf[self.key], use_na_sentinel=False)
        pdf = pdf.assign(**{self.key: code}).sort_values([self.key, *self.order], kind="stable")
        columns, ends = _columns(pdf, self.schema.names), np.cumsum(np.bincount(code, minlength=len(streams)))
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
            stream = None if pd.isna(streams[i]) else _plain(streams[i])
            yield stream, {c: v[a:b] for c, v in columns.items() if c != self.key}


def _sharded(frames: DataFrame, key: str, order: tuple[str, ...], payload: list[str], watermark: str, shards: int):
    """The rows grouped by shard of their streams, and as in _in_order."""
    shard = F.when(F.col(key).isNull(), F.lit(shards).cast("long")).otherwise(F.pmod(F.xxhash64(key), F.lit(shards)))
    return _in_order(frames.withColumn("stream_shard", shard), "stream_shard", order, [key, *payload], watermark)


def segment_stream(
    frames: DataFrame, key: str = "stream_id", order: tuple[str, ...] = ("ts", "frame_idx"), rules: L.SegmentRules = L.SegmentRules(), watermark: str = "1 hour", shards: int = SHARDS
) -> DataFrame:
    """Streaming rows (key, ts, frame id, energy, hands) to segment events.

    Rows are taken in event-time order whatever batch they come in; an event comes out
    once the watermark has passed its row. Rows older than the watermark are dropped by
    Spark and counted in the query's progress.
    """
    out = _scan_stream(frames, key, order, SegmentScan(rules), "seen long, code int", tuple, tuple, watermark, shards)
    return out.drop(*SegmentScan.columns)


class FlushProcessor(ShardProcessor):
    """Segment events; a segment left open by more than `idle` microseconds without a row is closed after its last row."""

    def __init__(self, key: str, order: list[str], schema: T.StructType, rules: L.SegmentRules, idle: int):
        state = T.StructType([T.StructField("seen", T.LongType()), T.StructField("code", T.IntegerType()), T.StructField("last", T.LongType()), T.StructField("last_id", schema[order[-1]].dataType)])
        super().__init__(key, order, schema, SegmentScan(rules), state)
        self.idle = idle

    def _closed(self, state: tuple) -> tuple[tuple, list[dict]]:
        """The state without its open segment, and that segment's event."""
        seen, code, last, last_id = state
        n = int(self.scan.frames[code])
        if not n:
            return state, []
        event = "flush_end" if n >= self.scan.rules.min_len else "flush_discard"
        row = {self.order[-1]: np.array([last_id]), "event": np.array([event], object), "seg_len": np.array([n], np.int32), "frame_no": np.array([seen - 1], np.int64)}
        return (seen, 0, last, last_id), [row]

    def step(self, stream, state, rows: dict[str, np.ndarray]) -> tuple:
        micros, ids = rows[MICROS], rows[self.order[-1]]
        found = []
        if state is None:
            state = (*self.scan.start(), int(micros[0]), _plain(ids[0]))
        cuts = np.flatnonzero(np.diff(micros, prepend=state[2]) > self.idle).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(micros)]):
            if a in cuts:
                state, closed = self._closed(state)
                found += closed
            if a < b:
                (seen, code), out = self.scan.run((state[0], state[1]), {c: rows[c][a:b] for c in self.scan.columns})
                state = (int(seen), int(code), int(micros[b - 1]), _plain(ids[b - 1]))
                found.append({self.order[-1]: ids[a:b], **out})
        return state, found

    def settled(self, states: dict, watermark: int) -> Iterator[tuple]:
        live = {k: s for k, s in states.items() if self.scan.frames[s[1]]}
        over = [k for k, s in live.items() if watermark * 1000 > s[2] + self.idle]
        for k in over:
            yield k, *self._closed(live.pop(k))
        if live:  # the first to be over; it sets the next one
            self.handle.registerTimer((min(s[2] for s in live.values()) + self.idle) // 1000 + 1)


def segment_flush_stream(
    frames: DataFrame, key: str = "stream_id", order: tuple[str, ...] = ("ts", "frame_idx"), rules: L.SegmentRules = L.SegmentRules(), idle_seconds: int = 60, watermark: str = "1 hour", shards: int = SHARDS
) -> DataFrame:
    """segment_stream with a flush: a segment still open when its stream has had no row for more than idle_seconds ends with its last row.

    The flush is a row of its own beside that row's event: flush_end, or flush_discard for a segment too short.
    It comes out with the stream's next row, or by a timer when the watermark is past the idle time.
    """
    use_keyed_state(frames.sparkSession)
    groups, held, by_name = _sharded(frames, key, order, SegmentScan.columns, watermark, shards)
    schema = T.StructType([by_name[key], by_name[order[-1]]] + [T.StructField(n, t) for n, t in SegmentScan.outputs])
    with pickled_by_value():
        return groups.transformWithStateInPandas(FlushProcessor(key, list(order), held, rules, idle_seconds * 1_000_000), schema, "Append", "EventTime")


def _scan_stream(rows: DataFrame, key: str, order: tuple[str, ...], scan, state: str, to_row: Callable, from_row: Callable, watermark: str, shards: int) -> DataFrame:
    use_keyed_state(rows.sparkSession)
    groups, held, by_name = _sharded(rows, key, order, scan.columns, watermark, shards)
    schema = T.StructType([by_name[c] for c in (key, order[-1], *scan.columns)] + [T.StructField(n, t) for n, t in scan.outputs])
    with pickled_by_value():
        return groups.transformWithStateInPandas(ShardProcessor(key, list(order), held, scan, T.StructType.fromDDL(state), to_row, from_row), schema, "Append", "EventTime")


def sentence_stream(rows: DataFrame, key: str, order: tuple[str, ...], watermark: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Streaming rows of gloss.sentence_rows to the running sentence's words, length, digest and the gloss's place, after each gloss.

    The state of a stream is one summary of constant size, however long its sentence grows.
    """
    out = _scan_stream(rows, key, order, SentenceScan(), sentences.STATE, sentences.to_row, sentences.from_row, watermark, shards)
    return out.filter(~F.col("reset")).drop("vi", "pos", "tense", "reset")


def _rate_row(state: tuple) -> tuple:
    return float(state[0]), int(state[1])


def rate_stream(rows: DataFrame, key: str, order: tuple[str, ...], watermark: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """Streaming rows to the frame-rate meter after each row (see segments.RateScan); NaN before the second row."""
    timed = rows.withColumn("us", F.unix_micros(order[0]))
    return _scan_stream(timed, key, order, RateScan(), "rate double, last long", _rate_row, tuple, watermark, shards).drop("us")


def split_late(path: str, ts: str, delay_seconds: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that parts rows by the watermark before Spark could drop them.

    A row is late if its time is not after the latest time of all earlier batches less the delay. Late rows go to
    {path}/late, the others to {path}/on_time; both and the batch's latest time are written under the
    batch's id, so a replayed batch replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tops = [r[0] for r in spark.read.schema("batch_id long, top long").parquet(f"{path}/tops").where(F.col("batch_id") < batch_id).agg(F.max("top")).collect()] if batch_id else []
        micros = F.unix_micros(ts)
        late = micros <= tops[0] - delay_seconds * 1_000_000 if tops and tops[0] is not None else F.lit(False)
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch={batch_id}")
        top = batch.agg(F.lit(batch_id).cast("long").alias("batch_id"), F.max(micros).alias("top"))
        top.write.mode("overwrite").parquet(f"{path}/tops/part={batch_id}")

    return write


class LiveProcessor(InOrderProcessor):
    """Energy, segmenter and frame buffer in one step; emits a finished
    segment's frames, ready for the window builder."""

    def __init__(self, key: str, order: list[str], schema: T.StructType, payload: list[str], rules: L.SegmentRules):
        super().__init__(key, order, schema)
        self.payload, self.rules = payload, rules
        self.energy, self.segments = EnergyScan(), SegmentScan(rules)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "blob binary")
        self.buffer = handle.getListState("buffer", T.StructType([self.schema[c] for c in self.payload]))

    def released(self, key, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        e, s = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else (self.energy.start(), self.segments.start())
        buffer = pd.DataFrame(list(self.buffer.get()) if self.buffer.exists() else [], columns=self.payload)
        before = len(buffer)
        e, out = self.energy.run(e, _columns(pdf, self.energy.columns))
        s, ev = self.segments.run(s, {"energy": out["energy"], "hands": pdf["hands"].to_numpy()})
        self.state.update((pickle.dumps((e, s)),))
        frames = pd.concat([buffer, pdf[self.payload]], ignore_index=True) if before else pdf[self.payload]
        self.buffer.put([tuple(_plain(v) for v in row) for row in frames.tail(self.rules.buffer).itertuples(index=False)])
        for i in np.flatnonzero(ev["event"] == "end"):
            seen = int(ev["frame_no"][i]) + 1
            n = max(1, min(seen, self.rules.buffer, int(ev["seg_len"][i]) + self.rules.pre_roll))
            stop = before + i + 1
            piece = frames.iloc[stop - n : stop].reset_index(drop=True)
            seg_id = pdf[self.order[-1]].iloc[i]
            yield piece.assign(**{self.key: key[0], "seg_id": seg_id, "n": n, "frame_idx": np.arange(n, dtype=np.int32)})


PAYLOAD = ["pose", "lhand", "rhand", "face", "pose_ok", "lhand_ok", "rhand_ok", "fps"]


def segment_frame_stream(frames: DataFrame, key: str, order: tuple[str, ...], rules: L.SegmentRules = L.SegmentRules(), watermark: str = "1 hour") -> DataFrame:
    """Streaming landmark frames to the frames of finished segments.

    ``frames``: key, the order columns (first an event time), the landmark
    columns, pose_vis and dt.
    """
    use_keyed_state(frames.sparkSession)
    f = wrist_columns(frames).withColumn("hands", F.col("lhand_ok") | F.col("rhand_ok"))
    groups, held, by_name = _in_order(f, key, order, [*dict.fromkeys([*PAYLOAD, *EnergyScan().columns, "hands"])], watermark)
    schema = T.StructType(
        [by_name[c] for c in PAYLOAD]
        + [by_name[key], T.StructField("seg_id", by_name[order[-1]].dataType), T.StructField("n", T.IntegerType()), T.StructField("frame_idx", T.IntegerType())]
    )
    proc = LiveProcessor(key, list(order), held, PAYLOAD, rules)
    with pickled_by_value():
        return groups.transformWithStateInPandas(proc, schema, "Append", "EventTime")


def closing_rows(frames: DataFrame, key: str, ts: str, name, after: str = "3 hours") -> DataFrame:
    """The last row again under a key of its own and far later: written behind a
    finished recording it moves the watermark past all rows, so that a replay releases
    them. (Nulls are avoided: a null in one key's rows was seen to blank others' values.)"""
    last = frames.agg(F.max_by(F.struct(*frames.columns), ts).alias("last")).select("last.*")
    types = {f.name: f.dataType for f in frames.schema.fields}
    return last.withColumn(ts, F.col(ts) + F.expr(f"interval {after}")).withColumn(key, F.lit(name).cast(types[key]))


def each_batch(classify: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: a batch's finished segments go through the batch
    operators and are written under their batch id, so a replayed batch
    overwrites itself instead of appearing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        classify(batch).write.mode("overwrite").json(f"{path}/batch={batch_id}")

    return write


def run_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes everything now available into parquet and reads it back."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)

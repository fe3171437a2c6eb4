"""A block coder for token ids: mixed order-0 to order-2 predictions drive a range coder.

A block's ids are dealt to lanes (consecutive stretches); at every step all lanes
code their next id with the same model, which then learns from all of them at once,
so the arithmetic runs on whole arrays. Each lane is its own range-coder stream.
A block starts with a fresh model and carries the crc32 of its ids and of its payload.

Ids of 65,536 and more are coded as two planes of 16 bits, each with a model of its own.

File: MAGIC, then blocks, then one index block. Block: 4-byte tag, header
<n_ids, n_lanes, payload bytes, crc32 of the payload, crc32 of the ids> (5 x u4),
payload = words per lane (u2), then the lanes' words (u4), all little-endian; with two
planes the payload is <bytes of the first> (u4), then the low and the high plane's.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"SLIDS2\r\n"
BLOCK, PLANES, INDEX = b"BLK2", b"PLN2", b"IDX1"
LANES = 8192
LANE_IDS = 512
BLOCK_IDS = LANES * LANE_IDS
ID_BITS = 16  # of a plane
_ALL = 1 << ID_BITS  # values of a plane and order-0 slots
_UNIT = 64  # shares of the three orders
_T2_BITS = 20
_WORD = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


class _Model:
    """Adaptive state of one block; all arithmetic is in integers.

    A context's entry is its predicted id times four plus the prediction's confidence.
    """

    def __init__(self) -> None:
        self.t1, self.t2 = np.zeros(_ALL, np.int32), np.zeros(1 << _T2_BITS, np.int32)
        self.outcomes = np.zeros((32, 3), np.int64)
        self.outcomes[:] = (4, 2, 2)
        self.counts = np.zeros(_ALL, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n = self.n_waiting = self.steps = 0
        self._order0()
        self._mix()

    def _order0(self) -> None:
        """Quantised frequencies of the ids seen so far; slot _ALL of the arrays is 'a new id'."""
        seen = np.flatnonzero(self.counts)
        escape = max(16, min(_ALL // 2, _ALL * len(seen) // (4 * self.n + 1))) if len(seen) else _ALL
        room = _ALL - escape - len(seen)
        if room < 0:
            escape, room = _ALL - len(seen), 0
        f = 1 + self.counts[seen] * room // max(1, self.n)
        self.f0 = np.zeros(_ALL + 1, np.uint64)
        self.c0 = np.zeros(_ALL + 1, np.uint64)
        total = int(f.sum()) if len(seen) else 0
        self.f0[seen] = f
        self.c0[seen] = np.cumsum(f) - f
        self.f0[_ALL], self.c0[_ALL] = _ALL - total, total
        self.slot = np.full(_ALL, _ALL, np.int64)
        self.slot[:total] = np.repeat(seen, f)

    def _mix(self) -> None:
        """Shares of orders 2 and 1 (the rest is order 0's) for each state of confidence."""
        o = self.outcomes
        total = o.sum(1)
        s = np.arange(32)
        k2, k1, same = s >> 3, (s >> 1) & 3, s & 1
        s2 = np.where(k2 > 0, np.clip(o[:, 0] * _UNIT // total, 1, _UNIT - 4), 0)
        s1 = np.where((k1 > 0) & ~((same == 1) & (k2 > 0)), np.clip(o[:, 1] * _UNIT // total, 1, _UNIT - 4), 0)
        s1 = np.minimum(s1, _UNIT - 2 - s2)
        s0 = _UNIT - s2 - s1
        self.first, self.second = s2.astype(np.int32), (s2 + s1).astype(np.int32)
        # of outcome o in state s at 3 * s + o: where its part begins, and its width (of one order-0 slot for the last)
        self.begin = (np.stack([0 * s2, s2, s2 + s1], 1) << ID_BITS).reshape(-1).astype(np.uint64)
        self.width = np.stack([s2 << ID_BITS, s1 << ID_BITS, s0], 1).reshape(-1).astype(np.uint64)

    def predict(self, a: np.ndarray, b: np.ndarray):
        """For contexts (b, a), a the last id: table slot, entries, predictions, three times the state."""
        h = ((a * 40503 + b * 30029 + (b >> 5)) ^ (a << 3)) & ((1 << _T2_BITS) - 1)
        e2, e1 = self.t2[h], self.t1[a]
        p2, p1 = e2 >> 2, e1 >> 2
        state = ((e2 & 3) << 3) | ((e1 & 3) << 1) | (p1 == p2)
        return h, e2, e1, p2, p1, state

    def learn(self, a: np.ndarray, seen: tuple, ids: np.ndarray, coded: np.ndarray) -> None:
        """coded is three times the state plus the outcome."""
        h, e2, e1, p2, p1, _ = seen
        fresh = (ids << 2) | 1
        for table, at, e, p in ((self.t2, h, e2, p2), (self.t1, a, e1, p1)):
            k = e & 3
            table[at] = np.where(p == ids, e + (k < 3), np.where(k > 1, e - 1, fresh))  # of lanes in one context the last counts
        self.outcomes += np.bincount(coded, minlength=96).reshape(32, 3)
        self.steps += 1
        if self.steps < 16 or self.steps % 4 == 0:
            self._mix()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting * 4 >= self.n:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=_ALL)
            self.n += self.n_waiting
            self.waiting, self.n_waiting = [], 0
            self._order0()


def _advance(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Lanes whose range fell below a word; a range that straddles a word boundary is cut first."""
    need = np.flatnonzero(rng <= _LOW)
    if len(need):
        lo, r = low[need], rng[need]
        cut = (lo ^ (lo + r - np.uint64(1))) >> _WORD != 0
        rng[need] = np.where(cut, (~lo + np.uint64(1)) & _LOW, r)
    return need


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.words, self.n = np.zeros((lanes, 2 * steps + 1), np.uint32), np.zeros(lanes, np.int64)

    def _emit(self, lanes: np.ndarray) -> None:
        self.words[lanes, self.n[lanes]] = (self.low[lanes] >> _WORD).astype(np.uint32)
        self.n[lanes] += 1

    def code(self, lanes, start: np.ndarray, width: np.ndarray, bits: int) -> None:
        low, rng = self.low[lanes], self.rng[lanes]
        r = rng >> np.uint64(bits)
        low, rng = low + r * start, r * width
        need = _advance(low, rng)
        self.low[lanes], self.rng[lanes] = low, rng
        if len(need):
            own = need if isinstance(lanes, slice) else lanes[need]
            self._emit(own)
            self.low[own] <<= _WORD
            self.rng[own] <<= _WORD

    def end(self) -> bytes:
        self.low += _LOW  # the word above low lies within the range
        self._emit(np.arange(len(self.low)))
        kept = np.arange(self.words.shape[1]) < self.n[:, None]
        return self.n.astype("<u2").tobytes() + self.words[kept].astype("<u4").tobytes()


class _Reader:
    def __init__(self, payload: bytes, lanes: int):
        n = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
        self.words = np.concatenate([np.frombuffer(payload, "<u4", offset=2 * lanes), np.zeros(2, "<u4")]).astype(np.uint64)
        self.at, self.end = np.cumsum(n) - n, np.cumsum(n)
        self.low, self.rng, self.value = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(lanes, np.uint64)
        every = np.arange(lanes)
        for _ in range(2):
            self._take(every)

    def _take(self, lanes: np.ndarray) -> None:
        at, end = self.at[lanes], self.end[lanes]
        word = np.where(at < end, self.words[np.minimum(at, len(self.words) - 1)], np.uint64(0))
        self.value[lanes] = (self.value[lanes] << _WORD) | word
        self.at[lanes] = at + 1

    def peek(self, lanes, bits: int) -> np.ndarray:
        self._r = self.rng[lanes] >> np.uint64(bits)
        return np.minimum((self.value[lanes] - self.low[lanes]) // self._r, np.uint64((1 << bits) - 1))

    def drop(self, lanes, start: np.ndarray, width: np.ndarray) -> None:
        low, rng = self.low[lanes] + self._r * start, self._r * width
        need = _advance(low, rng)
        self.low[lanes], self.rng[lanes] = low, rng
        if len(need):
            own = need if isinstance(lanes, slice) else lanes[need]
            self._take(own)
            self.low[own] <<= _WORD
            self.rng[own] <<= _WORD


_BITS = ID_BITS + 6  # order-0 slots times shares
_EVERY = slice(None)
_16 = np.uint64(16)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // 64))
    return lanes, -(-n // lanes)


def _encode_plane(ids: np.ndarray) -> tuple[int, bytes]:
    n = len(ids)
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model, out = _Model(), _Writer(lanes, steps)
    a = b = np.zeros(lanes, np.int32)
    for x in grid:
        seen = model.predict(a, b)
        _, e2, e1, _, _, state = seen
        # an entry predicts x if it is x * 4 and a confidence of 1 to 3
        least = (x << 2) + 1
        hit2, hit1 = (e2 - least).view(np.uint32) < 3, (e1 - least).view(np.uint32) < 3
        outcome = np.where(hit2, 0, 2 - hit1.astype(np.int32))
        coded = 3 * state + outcome
        start, width = model.begin[coded], model.width[coded]
        rest = np.flatnonzero(outcome == 2)
        own = x[rest]
        slot = np.where(model.f0[own] > 0, own, _ALL)
        start[rest] += model.c0[slot] * width[rest]
        width[rest] *= model.f0[slot]
        out.code(_EVERY, start, width, _BITS)
        new = rest[slot == _ALL]
        if len(new):
            out.code(new, x[new].astype(np.uint64), np.ones(len(new), np.uint64), ID_BITS)
        model.learn(a, seen, x, coded)
        a, b = x, a
    return lanes, out.end()


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most BLOCK_IDS ids below 2**32."""
    ids = np.asarray(ids, "<u4")
    if len(ids) and int(ids.max()) >= _ALL:
        lanes, low = _encode_plane(ids & (_ALL - 1))
        _, high = _encode_plane(ids >> ID_BITS)
        tag, payload = PLANES, struct.pack("<I", len(low)) + low + high
    else:
        tag, (lanes, payload) = BLOCK, _encode_plane(ids)
    return tag + struct.pack("<5I", len(ids), lanes, len(payload), zlib.crc32(payload), zlib.crc32(ids.tobytes())) + payload


def _decode_plane(n: int, lanes: int, payload: bytes) -> np.ndarray:
    steps = -(-n // lanes)
    grid = np.zeros((steps, lanes), np.int32)
    model, src = _Model(), _Reader(payload, lanes)
    a = b = np.zeros(lanes, np.int32)
    for t in range(steps):
        seen = model.predict(a, b)
        _, _, _, p2, p1, state = seen
        v = src.peek(_EVERY, _BITS)
        unit = (v >> _16).astype(np.int32)
        outcome = (unit >= model.first[state]).astype(np.int32) + (unit >= model.second[state])
        coded = 3 * state + outcome
        start, width = model.begin[coded], model.width[coded]
        rest = np.flatnonzero(outcome == 2)
        slot = model.slot[(v[rest] - start[rest]) // width[rest]]
        start[rest] += model.c0[slot] * width[rest]
        width[rest] *= model.f0[slot]
        src.drop(_EVERY, start, width)
        x = np.where(outcome == 0, p2, p1)
        x[rest] = slot
        new = rest[slot == _ALL]
        if len(new):
            raw = src.peek(new, ID_BITS)
            src.drop(new, raw, np.ones(len(new), np.uint64))
            x[new] = raw.astype(np.int32)
        grid[t] = x
        model.learn(a, seen, x, coded)
        a, b = x, a
    return grid.T.reshape(-1)[:n].astype("<u4")


def decode_block(tag: bytes, n: int, lanes: int, payload: bytes) -> np.ndarray:
    if tag == BLOCK:
        return _decode_plane(n, lanes, payload)
    (size,) = struct.unpack("<I", payload[:4])
    return _decode_plane(n, lanes, payload[4 : 4 + size]) | (_decode_plane(n, lanes, payload[4 + size :]) << np.uint32(ID_BITS))


def encode_index(doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The closing block of a file: the documents' ids and lengths."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<i8").tobytes()
    packed = zlib.compress(table, 6)
    return INDEX + struct.pack("<5I", len(doc_ids), 0, len(packed), zlib.crc32(packed), zlib.crc32(table)) + packed


def read_blocks(data: bytes) -> Iterator[np.ndarray | tuple[list[int | None], np.ndarray]]:
    """The ids of each block, then the index (doc ids, lengths). Raises ValueError on damage."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not an id file")
    at, view = len(MAGIC), memoryview(data)
    while True:
        tag = bytes(view[at : at + 4])
        if tag not in (BLOCK, PLANES, INDEX):
            raise ValueError("the file ends early or is damaged")
        n, lanes, size, crc_payload, crc_ids = struct.unpack("<5I", view[at + 4 : at + 24])
        payload = view[at + 24 : at + 24 + size]
        at += 24 + size
        if zlib.crc32(payload) != crc_payload:
            raise ValueError("a block's checksum is wrong")
        if tag != INDEX:
            ids = decode_block(tag, n, lanes, payload)
            if zlib.crc32(ids.tobytes()) != crc_ids:
                raise ValueError("decoded ids differ from those written")
            yield ids
        else:
            table = zlib.decompress(payload)
            doc_ids = np.frombuffer(table, "<i8", n, n).tolist()
            yield [d if k else None for d, k in zip(doc_ids, table[:n])], np.frombuffer(table, "<i8", n, 9 * n)
            return

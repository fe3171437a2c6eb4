"""Byte-level BPE by tree reduction: halves are encoded, then joined at their boundary.

A list of tokens is the encoding of its bytes exactly if every two neighbours are:
if encoding the bytes of the pair gives the pair again. So encodings form a monoid:
to join two of them, a window around the boundary is encoded anew and grows until
the pairs at its two edges are stable; tokens outside it can't change any more.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import text_slices
from seqloom.llm.vocab import public_tokenizer

LEAF_BYTES = 8  # spans of up to so many bytes are merged directly
CACHE_MATCHES = 400_000  # matches remembered by a Python worker; only speed depends on it
PAIRS = 500_000  # pairs of tokens remembered likewise
SPANS = 200_000  # short spans remembered likewise
LONG_MATCH = 200  # longer matches aren't remembered


class TreeBpe:
    """Encoder and decoder over tiktoken-style ranks (bytes -> id; the id is the merge rank)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_bytes: int = LEAF_BYTES):
        import regex

        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.matches = regex.compile(pattern).findall
        self.leaf_bytes = max(1, leaf_bytes)
        self._known: dict[str, bytes] = {}
        self._stable: dict[tuple[int, int], bool] = {}
        self._spans: dict[bytes, list[int]] = {}

    @classmethod
    def from_file(cls, path: str, pattern: str, leaf_bytes: int = LEAF_BYTES) -> TreeBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return cls(ranks, pattern, leaf_bytes)

    def _merge(self, data: bytes) -> list[int]:
        """The plain rule: merge the neighbours of lowest rank, leftmost first, until none is left."""
        if len(data) > 64:
            return self._merge_long(data)
        known = self._spans.get(data)
        if known is not None:
            return known
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        known = [self.ranks[p] for p in parts]
        if len(self._spans) >= SPANS:
            self._spans.clear()
        self._spans[data] = known
        return known

    def _merge_long(self, data: bytes) -> list[int]:
        """The same rule with a heap of neighbours, for windows that had to grow."""
        n, rank = len(data), self.ranks.get
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(data[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        while heap:
            _, i, to = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != to:
                continue  # one of the two has been merged since
            end[i], end[j] = to, 0
            if to < n:
                before[to] = i
                offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[data[i : end[i]]] for i in range(n) if end[i]]

    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are where they meet."""
        pair = (left, right)
        known = self._stable.get(pair)
        if known is None:
            if len(self._stable) >= PAIRS:
                self._stable.clear()
            known = self._stable[pair] = self._merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring spans from theirs."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            window = self._merge(b"".join([self.tokens[t] for t in left[len(left) - a :] + right[:b]]))
            left_done = a >= len(left) or self.stable(left[-a - 1], window[0])
            right_done = b >= len(right) or self.stable(window[-1], right[b])
            if left_done and right_done:
                return left[: len(left) - a] + window + right[b:]
            a, b = min(len(left), a * (1 + (not left_done))), min(len(right), b * (1 + (not right_done)))

    def encode_span(self, data: bytes) -> list[int]:
        """Halves are encoded on their own and joined; the depth is logarithmic in the length."""
        if len(data) <= self.leaf_bytes:
            return self._merge(data)
        half = len(data) // 2
        return self.join(self.encode_span(data[:half]), self.encode_span(data[half:]))

    def encode_match(self, match: str) -> bytes:
        data = match.encode()
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.encode_span(data), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text, each match on its own, as little-endian unsigned 32-bit integers."""
        found = self.matches(text)
        get = self._known.get
        values = list(map(get, found))
        for i, v in enumerate(values):
            if v is None:
                v = self._known.get(found[i])
                if v is None:
                    v = self.encode_match(found[i])
                    if len(found[i]) <= LONG_MATCH:
                        if len(self._known) >= CACHE_MATCHES:
                            self._known.clear()
                        self._known[found[i]] = v
                values[i] = v
        return b"".join(values)

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids: halves are decoded and concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join([self.tokens[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@functools.lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> TreeBpe:
    return TreeBpe.from_file(path, pattern)


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes each whole text of (doc_id, text) and decodes the ids again: rows (doc_id, ids, decoded).

    `ids` holds little-endian unsigned 32-bit integers, `decoded` the bytes they stand
    for. A null or empty text gives empty values; repeated rows give repeated rows; an
    empty table gives none; other columns are ignored. Special tokens are ordinary text.
    """
    import public_tokenizers

    path = path or public_tokenizer("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in text_slices(batches, "text"):
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            back = [codec.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents()'s rows."""
    return encoded.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


__all__ = ["TreeBpe", "digests", "encode_documents"]

"""Ids of whole texts by the tokenizers library, with a bounded memory of pieces between spaces."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Sequence

import numpy as np

CACHE_PIECES = 500_000  # pieces remembered by a Python worker (about 100 MB); only speed depends on it
# White space other than the plain space: a text that holds any is cut with a pattern instead of str.split.
_RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0                　"
SPACE = "\u0120"  # how byte-level vocabularies write a space
_CUT = re.compile(r"(?<=\S) (?=\S)")


def public_tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """The text cut at lone spaces between two visible characters; the spaces are left out.

    A byte-level pre-tokenizer always starts a new match at such a space, so
    the ids of a text are those of its pieces (each but the first after a space).
    """
    if "  " in text or "\n " in text or " \n" in text or any(c in text for c in _RARE):
        return _CUT.split(text)
    return text.split(" ")


#: Fixed value: the pre-tokenizing pattern of byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ\n]+")  # pieces that all libraries cut into the same matches: ASCII but for apostrophes, Latin letters, line ends


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow U+0100 in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def ranked_encoding(path: str):
    """The vocabulary of a tokenizers file as merge ranks for tiktoken, which encodes many short pieces quicker; None if ids aren't in merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    letters, added = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])) or any(c not in letters for t in vocab for c in t):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class _Numbers(dict):
    """Numbers pieces in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


class PieceEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit integers.

    Pieces are numbered once; their ids lie in one array, from which texts are put together.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["RAYON_NUM_THREADS"] = "1"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        size = self._tokenizer.get_vocab_size()
        after_space = [i for i in range(size) if (self._tokenizer.id_to_token(i) or "").startswith(SPACE)]
        self._after_space = np.zeros(size, bool)
        self._after_space[after_space] = True
        self._ranked = ranked_encoding(path)
        # tokens that merges of their own letters don't lead to: tiktoken would take them whole
        ids = [(i, self._tokenizer.decode([i], skip_special_tokens=False)) for i in self._ranked._mergeable_ranks.values()] if self._ranked else []
        ids = [(i, t) for i, t in ids if _PLAIN.fullmatch(t[1:] if t[:1] == " " else t)]
        self._odd = {t for (i, t), e in zip(ids, self._tokenizer.encode_batch_fast([t for _, t in ids], add_special_tokens=False)) if e.ids != [i]}
        self._cache_pieces = cache_pieces
        self._forget()

    def _forget(self) -> None:
        self._number = _Numbers()
        self._at, self._size, self._flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _split(self, ids: np.ndarray, n: int) -> np.ndarray | None:
        """Sizes of n pieces' ids: a piece starts with the only id of its that starts with a space."""
        starts = np.flatnonzero(self._after_space[ids])
        return np.diff(np.append(starts, len(ids))) if len(starts) == n and (not n or starts[0] == 0) else None

    def _ids(self, wanted: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the pieces as they stand after a space."""
        plain = np.fromiter(map(_PLAIN.fullmatch, wanted), object, len(wanted)).astype(bool) if self._ranked else np.zeros(len(wanted), bool)
        if self._odd:
            plain &= np.fromiter((not any(t in " " + p for t in self._odd) for p in wanted), bool, len(wanted))
        out, sizes = [np.zeros(0, "<u4")] * 2, [np.zeros(0, np.int64)] * 2
        for kind in (0, 1):
            own = [p for p, k in zip(wanted, plain.tolist()) if k == kind]
            found, lengths = [], []
            for at in range(0, len(own), 4096):
                some = own[at : at + 4096]
                text = "".join(" " + p for p in some)
                ids = self._ranked.encode_to_numpy(text, disallowed_special=()) if kind else np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                size = self._split(ids, len(some))
                if size is None:
                    each = [e.ids for e in self._tokenizer.encode_batch_fast([" " + p for p in some], add_special_tokens=False)]
                    ids, size = np.array([i for e in each for i in e], "<u4"), np.array([len(e) for e in each])
                found.append(ids)
                lengths.append(size)
            if own:
                out[kind], sizes[kind] = np.concatenate(found).astype("<u4"), np.concatenate(lengths)
        # back into the order in which they were wanted
        place = np.concatenate([np.flatnonzero(~plain), np.flatnonzero(plain)])
        at = len(out[0])
        size, start = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        both = np.concatenate(sizes)
        size[place] = both
        start[place] = np.cumsum(both) - both
        return np.concatenate(out)[_ranges(start, size)], size

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        if len(self._number) > self._cache_pieces:
            self._forget()
        known, get = len(self._number), self._number.__getitem__
        heads, numbers = [], []
        for text in texts:
            cut = pieces(text or "")
            heads.append(cut[0])
            numbers.append(np.fromiter(map(get, itertools.islice(cut, 1, None)), np.int64, len(cut) - 1))
        ends = np.cumsum([len(x) for x in numbers])
        if len(self._number) > known:
            ids, size = self._ids(list(itertools.islice(self._number, known, None)))
            self._at = np.concatenate([self._at, len(self._flat) + np.cumsum(size) - size])
            self._size = np.concatenate([self._size, size])
            self._flat = np.concatenate([self._flat, ids])
        of = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        size = self._size[of]
        data = self._flat[_ranges(self._at[of], size)].tobytes()
        stops = 4 * np.append(0, np.cumsum(size))[[0, *ends]]
        first = self._tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        return [np.array(h.ids, "<u4").tobytes() + data[a:b] for h, a, b in zip(first, stops[:-1].tolist(), stops[1:].tolist())]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of every range, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker and vocabulary."""
    return PieceEncoder(path)

"""Running sentences by composition: what a gloss adds to the sentence so far costs the gloss alone.

A stretch of glosses is summarised by seven facts: its time words, its first negation, the
tense and question it brings, and its other words in three parts: before the first
verb or adjective, from there to the first verb, from the first verb on. Each part
is known with and without copulas, as word count, length and digest of its text, so the
sentence of two stretches follows from their summaries in constant time, and a summary
has a constant size whatever the length of the stretch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import types as T

#: Base and modulus of the digest: sum of code point times BASE to the number of characters after it.
BASE, MODULUS = 1_000_003, 2_147_483_647
COPULA = "là"
MARKS = {"past": "đã", "fut": "sẽ"}  # fixed values

_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def digest(text: str) -> int:
    h = 0
    for c in text:
        h = (h * BASE + ord(c)) % MODULUS
    return h


@dataclass(frozen=True)
class Text:
    """Words joined by single spaces, without the words: how many, how long, their digest, and the first of them."""

    words: int = 0
    chars: int = 0
    hash: int = 0
    first: str = ""

    @staticmethod
    def of(word: str | None) -> Text:
        clean = _SPACE.sub(" ", word or "").strip(" ")
        return Text(1, len(clean), digest(clean), clean) if clean else _EMPTY

    def __add__(self, other: Text) -> Text:
        if not other.words or not self.words:
            return self if self.words else other
        hash_ = (self.hash * pow(BASE, other.chars + 1, MODULUS) + 32 * pow(BASE, other.chars, MODULUS) + other.hash) % MODULUS
        return Text(self.words + other.words, self.chars + 1 + other.chars, hash_, self.first)


_EMPTY = Text()
_COPULA = Text.of(COPULA)
_MARKS = {k: Text.of(v) for k, v in MARKS.items()}


@dataclass(frozen=True)
class Part:
    """Neighbouring words: their text, that with copulas, whether the first can take one and the last can call for one."""

    plain: Text = _EMPTY
    linked: Text = _EMPTY
    items: int = 0
    noun: bool = False
    calls: bool = False

    def __add__(self, other: Part) -> Part:
        if not other.items or not self.items:
            return self if self.items else other
        linked = self.linked + _COPULA + other.linked if self.calls and other.noun else self.linked + other.linked
        return Part(self.plain + other.plain, linked, self.items + other.items, self.noun, other.calls)


_NOTHING = Part()


@dataclass(frozen=True)
class Sentence:
    """Summary of a stretch of glosses; + puts another stretch after it."""

    times: Text = _EMPTY
    negation: str | None = None
    tense: str | None = None
    question: bool = False
    before: Part = _NOTHING  # the first verb or adjective
    middle: Part = _NOTHING  # from there up to the first verb
    after: Part = _NOTHING  # from the first verb on

    @staticmethod
    def of(vi: str | None, pos: str | None, tense: str | None) -> Sentence:
        if pos == "TIME":
            return Sentence(times=Text.of(vi), tense=tense or None)
        if pos == "NEG":
            return Sentence(negation=vi or "")
        part = Part(Text.of(vi), Text.of(vi), 1, pos == "NOUN", pos in ("NOUN", "PRON"))
        if pos == "VERB":
            return Sentence(after=part)
        if pos == "ADJ":
            return Sentence(middle=part)
        return Sentence(before=part, question=pos == "WH")

    def __add__(self, other: Sentence) -> Sentence:
        before, middle, after = self.before, self.middle, self.after
        if after.items:
            after = after + other.before + other.middle + other.after
        elif middle.items:
            middle, after = middle + other.before + other.middle, other.after
        else:
            before, middle, after = before + other.before, other.middle, other.after
        return Sentence(
            self.times + other.times, other.negation if self.negation is None else self.negation, self.tense or other.tense,
            self.question or other.question, before, middle, after,
        )

    def _pieces(self) -> list[Text]:
        verb = self.after.items > 0
        mark = _MARKS.get(self.tense or "", _EMPTY) if verb and self.negation is None else _EMPTY
        parts = [p.plain if verb else p.linked for p in (self.before, self.middle, self.after)]
        return [self.times, parts[0], Text.of(self.negation), parts[1], mark, parts[2]]

    def written(self) -> tuple[int, int, int]:
        """(words, characters, digest) of the written sentence; nothing is written without a word."""
        whole = _EMPTY
        for piece in self._pieces():
            whole = whole + piece
        if not whole.words:
            return 0, 0, 0
        rest = (whole.hash - ord(whole.first[0]) * pow(BASE, whole.chars - 1, MODULUS)) % MODULUS
        capital, end = whole.first[0].upper(), "?" if self.question else "."
        hash_ = (digest(capital) * pow(BASE, whole.chars - 1, MODULUS) + rest) % MODULUS
        return whole.words, whole.chars - 1 + len(capital) + 1, (hash_ * BASE + ord(end)) % MODULUS

    def place(self, pos: str | None, blank: bool, first_negation: bool) -> int:
        """Where the stretch's last gloss stands among the written words, from 1; 0 if it is not written."""
        if blank or (pos == "NEG" and not first_negation):
            return 0
        n = [p.words for p in self._pieces()]
        if pos == "TIME":
            return n[0]
        if pos == "NEG":
            return n[0] + n[1] + n[2]
        return sum(n) if self.after.items or self.middle.items else n[0] + n[1]


def _row(value) -> tuple:
    """The fields of a summary, in order, without nesting."""
    out = []
    for f in fields(value):
        v = getattr(value, f.name)
        out += _row(v) if isinstance(v, (Text, Part)) else [v]
    return tuple(out)


_TEXT = [("words", "long"), ("chars", "long"), ("hash", "long"), ("first", "string")]
_PART = [(f"plain_{n}", t) for n, t in _TEXT] + [(f"linked_{n}", t) for n, t in _TEXT] + [("items", "long"), ("noun", "boolean"), ("calls", "boolean")]
#: Typed columns of a summary, for keyed state.
STATE = ", ".join(
    [f"times_{n} {t}" for n, t in _TEXT] + ["negation string", "tense string", "question boolean"] + [f"{p}_{n} {t}" for p in ("before", "middle", "after") for n, t in _PART]
)


def to_row(s: Sentence) -> tuple:
    """The summary as a row of STATE, without nulls: no negation is '', any other starts with '='."""
    row = list(_row(s))
    row[4], row[5] = "" if s.negation is None else "=" + s.negation, s.tense or ""
    return tuple(row)


def from_row(row) -> Sentence:
    v = list(row)
    part = lambda at: Part(Text(*v[at : at + 4]), Text(*v[at + 4 : at + 8]), int(v[at + 8]), bool(v[at + 9]), bool(v[at + 10]))
    return Sentence(Text(*v[:4]), v[4][1:] if v[4] else None, v[5] or None, bool(v[6]), part(7), part(18), part(29))


class SentenceScan:
    """The sentence after every gloss of a stream, as its number of words, length, digest and the gloss's place in it.

    Rows have vi, pos, tense ('' for none) and `reset`: a reset row clears the sentence and holds no gloss.
    Control glosses are left out before.
    """

    columns = ["vi", "pos", "tense", "reset"]
    outputs = [("n_words", T.LongType()), ("n_chars", T.LongType()), ("digest", T.LongType()), ("place", T.LongType())]

    def start(self) -> Sentence:
        return Sentence()

    def _step(self, state: Sentence, vi, pos, tense, reset) -> tuple[Sentence, int]:
        if reset:
            return Sentence(), 0
        first = state.negation is None
        state = state + Sentence.of(vi, pos, tense)
        return state, state.place(pos, not Text.of(vi).words, first)

    def _each(self, rows):
        return zip(*(_objects(rows[c]) for c in self.columns))

    def run(self, state, rows):
        out = [[], [], [], []]
        for row in self._each(rows):
            state, place = self._step(state, *row)
            for column, v in zip(out, (*state.written(), place)):
                column.append(v)
        named = {n: np.array(c, np.int64) for (n, _), c in zip(self.outputs, out)}
        return state, named

    def identity(self):
        return (False, Sentence())

    def fold(self, summary, rows):
        cleared, state = summary
        for vi, pos, tense, reset in self._each(rows):
            cleared = cleared or bool(reset)
            state, _ = self._step(state, vi, pos, tense, reset)
        return cleared, state

    def resume(self, summary, state):
        cleared, own = summary
        return own if cleared else state + own


def _objects(column: np.ndarray) -> list:
    """Plain values, with None for every kind of missing value."""
    return [None if v is None or v != v else v for v in column.tolist()]

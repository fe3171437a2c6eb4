"""Token columns, edit operations and sentence rules."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with ``value`` evaluated once per row.

    Spark re-evaluates a column expression wherever a lambda mentions it.
    """
    return F.transform(F.array(value), body)[0]


def token_norm(c: Column) -> Column:
    """Trimmed, white-space runs as '-', upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", "-"))


def tokens(text: Column) -> Column:
    """White-space tokens in upper case; blank text has none."""
    clean = F.upper(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"\s+"))


# A cell packs cost, the move's rank among equal costs, substitutions and
# deletions, so the smaller number is the better move; insertions follow from the cost.
_COST, _RANK, _SUB, _DEL = 1 << 42, 1 << 40, 1 << 20, 1
_NO_RANK = ~(3 << 40)
_CELLS = 1 << 17  # cells per diagonal and block: a block stays in cache
_SMALL = 1 << 18  # pairs of more cells are solved by their distance, not their size
_FIELD = 1 << 20  # more tokens would carry into the next field of a cell
_KEPT = 256  # frontiers between two that are kept for the way back
_SLIDES = 1 << 20  # tokens compared at once


def edit_counts(refs: list, hyps: list) -> np.ndarray:
    """(substitutions, deletions, insertions) per pair of token lists.

    Ties prefer match/substitution, then deletion, then insertion. Small pairs of
    like size are solved together, one anti-diagonal at a time; large ones each on its
    own by furthest-reaching diagonals, whatever their length, unless they turn out too
    far apart for that and fit the table.
    """
    n = np.array([len(r) for r in refs], np.int64)
    m = np.array([len(h) for h in hyps], np.int64)
    out = np.zeros((len(refs), 3), np.int64)
    flat = [t for r in refs for t in r] + [t for h in hyps for t in h]
    codes = pd.factorize(np.array(flat, dtype=object))[0] if flat else np.zeros(0, np.int64)
    r_at = np.concatenate([[0], np.cumsum(n)])
    h_at = n.sum() + np.concatenate([[0], np.cumsum(m)])
    small = n * m <= _SMALL
    for i in np.flatnonzero(~small):
        most = int(np.sqrt(float(n[i]) * m[i])) // 5 if max(n[i], m[i]) < _FIELD else None  # beyond, the table is quicker
        found = edit_frontier(codes[r_at[i] : r_at[i] + n[i]], codes[h_at[i] : h_at[i] + m[i]], most)
        small[i] = found is None
        out[i] = found or 0
    order = np.argsort(n + m, kind="stable")
    order = order[small[order]]
    start = 0
    while start < len(order):
        size = max(1, _CELLS // int(n[order[start : start + 512]].max() + 1))
        block = order[start : start + min(size, 512)]
        start += len(block)
        out[block] = _edit_block(codes, r_at[block], h_at[block], n[block], m[block])
    return out


def _edit_block(codes, r_at, h_at, n, m) -> np.ndarray:
    rows, width, height = len(n), int(n.max()), int(m.max())
    ref = np.full((rows, width + 1), -1, np.int64)
    hyp = np.full((rows, height + 1), -2, np.int64)
    for b in range(rows):
        ref[b, 1 : n[b] + 1] = codes[r_at[b] : r_at[b] + n[b]]
        hyp[b, 1 : m[b] + 1] = codes[h_at[b] : h_at[b] + m[b]]
    last = np.zeros((rows, width + 1), np.int64)
    older = np.zeros_like(last)
    final = np.zeros(rows, np.int64)
    for k in range(1, width + height + 1):
        now = np.zeros_like(last)
        lo, hi = max(1, k - height), min(k - 1, width)
        if lo <= hi:
            back = hyp[:, k - hi : k - lo + 1][:, ::-1]
            sub = older[:, lo - 1 : hi] + (ref[:, lo : hi + 1] != back) * (_COST + _SUB)
            dele = last[:, lo - 1 : hi] + (_COST + _RANK + _DEL)
            ins = last[:, lo : hi + 1] + (_COST + 2 * _RANK)
            now[:, lo : hi + 1] = np.minimum(np.minimum(sub, dele), ins) & _NO_RANK
        if k <= height:
            now[:, 0] = k * _COST
        if k <= width:
            now[:, k] = k * (_COST + _DEL)
        done = n + m == k
        final[done] = now[done, n[done]]
        older, last = last, now
    cost, s, d = final >> 42, (final >> 20) & 0xFFFFF, final & 0xFFFFF
    return np.stack([s, d, cost - s - d], axis=1)


def _slide(ref: np.ndarray, hyp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """i moved on along each diagonal as far as ref[i] equals hyp[j]; compares ever more tokens of ever fewer diagonals."""
    i, j = i.copy(), j.copy()
    left = np.minimum(len(ref) - i, len(hyp) - j)
    live = np.flatnonzero(left > 0)
    width = 8
    while len(live):
        for at in range(0, len(live), max(1, _SLIDES // width)):
            some = live[at : at + max(1, _SLIDES // width)]
            step = np.arange(width)
            a, b = np.minimum(i[some][:, None] + step, len(ref) - 1), np.minimum(j[some][:, None] + step, len(hyp) - 1)
            same = (ref[a] == hyp[b]) & (step < left[some][:, None])
            run = np.where(same.all(1), width, same.argmin(1))
            i[some] += run
            j[some] += run
            left[some] = np.where(run == width, left[some] - width, 0)
        live = live[left[live] > 0]
        width = min(4 * width, _SLIDES)
    return i


def _next_frontier(ref: np.ndarray, hyp: np.ndarray, d: int, last: np.ndarray) -> np.ndarray:
    """The furthest row of every diagonal -d..d (column minus row) reached with d edits; last is that of d - 1. -1 where none is."""
    n, m = len(ref), len(hyp)
    wide = np.full(2 * d + 3, -1, np.int64)  # last on diagonals -d-1..d+1
    wide[2:-2] = last
    k = np.arange(-d, d + 1)
    sub, ins, dele = wide[1:-1], wide[:-2], wide[2:]
    i = np.maximum(np.where(sub >= 0, sub + 1, -1), np.maximum(ins, np.where(dele >= 0, dele + 1, -1)))
    i = np.minimum(i, np.minimum(n, m - k))
    ok = (i >= 0) & (i + k >= 0)
    out = np.full(len(k), -1, np.int64)
    out[ok] = _slide(ref, hyp, i[ok], (i + k)[ok])
    return out


def edit_frontier(ref: np.ndarray, hyp: np.ndarray, most: int | None = None) -> tuple[int, int, int] | None:
    """(substitutions, deletions, insertions) of one pair of code arrays, by furthest-reaching diagonals; None if they are more than `most`.

    Takes time with the square of the distance and the length of the matches. Of the
    frontiers every _KEPT-th is kept; those between are found again on the way back. Costs
    never fall along a diagonal, so a frontier tells whether a cell costs at most d, and the
    way back follows the same ties as the full table.
    """
    n, m = len(ref), len(hyp)
    goal = m - n
    now = _slide(ref, hyp, np.zeros(1, np.int64), np.zeros(1, np.int64)) if n and m else np.zeros(1, np.int64)
    kept, d = {0: now}, 0
    while not (abs(goal) <= d and now[goal + d] >= n):
        if most is not None and max(d, abs(goal)) >= most:
            return None
        d += 1
        now = _next_frontier(ref, hyp, d, now)
        if d % _KEPT == 0:
            kept[d] = now
    block: dict[int, np.ndarray] = {}

    def frontier(at: int) -> np.ndarray:
        nonlocal block
        if at not in block:
            first = at - at % _KEPT
            block = {first: kept[first]}
            for x in range(first + 1, at + 1):
                block[x] = _next_frontier(ref, hyp, x, block[x - 1])
        return block[at]

    i, j, counts = n, m, [0, 0, 0]
    for cost in range(d, 0, -1):
        best = frontier(cost - 1)
        reach = lambda k: best[k + cost - 1] if abs(k) < cost else -1  # noqa: E731, B023  furthest row on diagonal k with one edit less
        k = j - i
        back = _slide(ref[:i][::-1], hyp[:j][::-1], np.zeros(1, np.int64), np.zeros(1, np.int64))[0] if i and j else 0
        i, j = i - back, j - back  # over the matches that end here
        if i and j and reach(k) >= i - 1:
            counts[0] += 1
            i, j = i - 1, j - 1
        elif i and reach(k + 1) >= i - 1:
            counts[1] += 1
            i -= 1
        else:
            counts[2] += 1
            j -= 1
    return tuple(counts)


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("sub", "dele", "ins")]))
def edit_ops(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(edit_counts(list(ref), list(hyp)), columns=["sub", "dele", "ins"])


def sentence(items: Column, insert_tense: bool = True) -> Column:
    """Array of {vi, pos, tense} in signing order to one written sentence.

    Time words go first; only the first negation stays, before the first
    verb/adjective (else last); a copula joins noun phrases when there is no
    verb; the first time word with a tense marks the first verb unless negated.
    """

    def is_pos(*pos: str) -> Callable[[Column], Column]:
        return lambda x: F.coalesce(x.getField("pos"), F.lit("")).isin(*pos)

    def not_pos(*pos: str) -> Callable[[Column], Column]:
        return lambda x: ~is_pos(*pos)(x)

    def first_of(a: Column, *pos: str) -> Column:
        return F.array_position(F.transform(a, is_pos(*pos)), True).cast("int")

    def place_negation(rest: Column, negs: Column) -> Column:
        at = first_of(rest, "VERB", "ADJ")
        first = F.slice(negs, 1, 1)
        return let(
            at,
            lambda i: F.when(F.size(negs) == 0, rest)
            .when(i > 0, F.concat(F.slice(rest, F.lit(1), i - 1), first, F.slice(rest, i, F.size(rest))))
            .otherwise(F.concat(rest, first)),
        )

    none = F.array().cast("array<string>")

    def words(s: Column) -> Column:
        def word(x: Column, i: Column) -> Column:
            before = F.get(s.seq, i - 1)
            copula = (i > 0) & is_pos("NOUN", "PRON")(before) & is_pos("NOUN")(x) & (s.verb == 0)
            mark = F.when((i == s.verb - 1) & ~s.neg, s.mark).otherwise(none)
            return F.concat(F.when(copula, F.array(F.lit("là"))).otherwise(none), mark, F.array(x.getField("vi")))

        return F.flatten(F.transform(s.seq, word))

    def finish(t: Column, wh: Column) -> Column:
        return F.when(t == "", "").otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)), F.when(wh, "?").otherwise(".")))

    def build(all_items: Column) -> Column:
        times = F.filter(all_items, is_pos("TIME"))
        rest = F.filter(all_items, not_pos("TIME", "NEG"))
        negs = F.filter(all_items, is_pos("NEG"))
        tense = F.get(F.filter(times, lambda x: F.coalesce(x.getField("tense"), F.lit("")) != ""), F.lit(0)).getField("tense")
        mark = F.when(tense == "past", F.array(F.lit("đã"))).when(tense == "fut", F.array(F.lit("sẽ"))).otherwise(none)
        seq = F.concat(times, place_negation(rest, negs))
        state = let(
            seq,
            lambda q: F.struct(
                q.alias("seq"),
                first_of(q, "VERB").alias("verb"),
                (F.size(negs) > 0).alias("neg"),
                (mark if insert_tense else none).alias("mark"),
                F.exists(q, is_pos("WH")).alias("wh"),
            ),
        )
        return let(
            state,
            lambda s: let(F.trim(F.regexp_replace(F.array_join(words(s), " "), r"\s+", " ")), lambda t: finish(t, s.wh)),
        )

    return F.when(F.size(items) == 0, "").otherwise(let(items, build))

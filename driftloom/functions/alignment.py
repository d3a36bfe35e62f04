"""Global alignment of different strings onto a reference of fixed width."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The scores of a match, a mismatch, and the first and each further letter of a gap.
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -5, -1


#: Cells of all tables that are filled at once, and the value of a state that can't be reached.
CELLS = 1 << 24
_LOST = -(1 << 28)
_PAIR, _EXTRA, _GAP = 0, 1, 2


#: Of each state, in which order equal ways to it are preferred.
_ORDER = np.array([(_PAIR, _EXTRA, _GAP), (_PAIR, _GAP, _EXTRA), (_PAIR, _EXTRA, _GAP)])


def _first_best(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest values, and which of the three has them first."""
    best = np.maximum(np.maximum(a, b), c)
    later = a != best
    return best, later.view(np.uint8) + (later & (b != best)).view(np.uint8)


def aligned_batch(sequences: list[str], reference: str) -> list[str]:
    """The letters of each sequence at the places of ``reference``, ``-`` where a gap stands.

    The best global alignments with affine gaps; among equal ones a pair goes before a letter left out of
    the sequence, and that before a gap in it, seen from the end. A cell needs only the two diagonals
    before its own, so the same diagonal of all sequences is filled at once, and all are traced at once.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    n, m, count = len(reference), int(sizes.max(initial=0)), len(sequences)
    letters = np.zeros((m + 1, count), np.int32)
    for k, s in enumerate(sequences):
        letters[: len(s), k] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<i4")
    backward = letters[::-1]
    target = np.frombuffer(reference.encode("utf-32-le", "surrogatepass"), "<i4")[:, None]
    # short tables fit half as many bytes
    kind, least = (np.int16, -(1 << 14)) if 6 * (n + m + 2) < 1 << 13 else (np.int32, _LOST)
    lost = lambda: np.full((n + 1, count), least, kind)
    # states of a diagonal by the place in the reference: a pair, a letter left out, a gap
    older, old = [lost() for _ in range(3)], [lost() for _ in range(3)]
    old[_PAIR][0] = 0
    ways = np.zeros((n + m + 1, 3, n + 1, count), np.uint8)
    ends = np.full((3, count), least, kind)
    for d in range(n + m + 1):
        if d:
            now = [lost() for _ in range(3)]
            low, high = max(0, d - m), min(n, d)
            a, b = max(low, 1), min(high, d - 1) + 1
            if a < b:  # cells with a letter of both
                best, ways[d, _PAIR, a:b] = _first_best(*(older[s][a - 1 : b - 1] for s in (_PAIR, _EXTRA, _GAP)))
                own = backward[m + 1 - d + a : m + 1 - d + b]
                now[_PAIR][a:b] = best + np.where(target[a - 1 : b - 1] == own, kind(MATCH), kind(MISMATCH))
            if low < b:  # a letter of the sequence is left out
                now[_EXTRA][low:b], ways[d, _EXTRA, low:b] = _first_best(old[_PAIR][low:b] + kind(OPEN), old[_GAP][low:b] + kind(OPEN), old[_EXTRA][low:b] + kind(EXTEND))
            if a < high + 1:  # a gap in the sequence
                now[_GAP][a : high + 1], ways[d, _GAP, a : high + 1] = _first_best(old[_PAIR][a - 1 : high] + kind(OPEN), old[_EXTRA][a - 1 : high] + kind(OPEN), old[_GAP][a - 1 : high] + kind(EXTEND))
            older, old = old, now
        done = np.flatnonzero(sizes + n == d)
        for s in range(3):
            ends[s, done] = old[s][n, done]
    out = np.full((count, n), ord("-"), np.int32)
    i, j = np.full(count, n), sizes.copy()
    state = _ORDER[_PAIR][_first_best(ends[_PAIR], ends[_EXTRA], ends[_GAP])[1]]
    live = np.arange(count)
    while len(live := live[(i[live] > 0) | (j[live] > 0)]):
        now = state[live]
        state[live] = _ORDER[now, ways[i[live] + j[live], now, i[live], live]]
        paired = live[now == _PAIR]
        out[paired, i[paired] - 1] = letters[j[paired] - 1, paired]
        i[live] -= now != _EXTRA
        j[live] -= now != _GAP
    return [row.tobytes().decode("utf-32-le", "surrogatepass") for row in out]


def aligned(sequence: str, reference: str) -> str:
    """One sequence, as ``aligned_batch`` aligns it."""
    return aligned_batch([sequence], reference)[0]


def project(rows: DataFrame, reference: str) -> DataFrame:
    """``sequence`` and ``projected`` of every different sequence that isn't null; each is aligned once, in Arrow batches."""

    @F.pandas_udf("string")
    def onto(sequences: pd.Series) -> pd.Series:
        out = np.empty(len(sequences), object)
        # sequences of near lengths together, as many as CELLS allows
        order = np.argsort(sequences.str.len().to_numpy(), kind="stable")
        at = 0
        while at < len(order):
            longest = len(sequences.iloc[order[min(at + 511, len(order) - 1)]])
            step = int(np.clip(CELLS // (3 * (len(reference) + 1) * (len(reference) + longest + 1)), 1, 512))
            own = order[at : at + step]
            out[own] = aligned_batch([sequences.iloc[k] for k in own], reference)
            at += step
        return pd.Series(out)

    return rows.select("sequence").where("sequence is not null").distinct().withColumn("projected", onto("sequence"))

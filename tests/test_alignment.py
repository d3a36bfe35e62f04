"""Alignments by diagonals against tables filled cell by cell."""

import itertools
import random

import pytest

from driftloom.functions import alignment
from driftloom.functions.alignment import EXTEND, MATCH, MISMATCH, OPEN

LOST = float("-inf")


def plain(sequence, reference):
    """Score and projected letters from full tables, a pair before a left-out letter before a gap."""
    n, m = len(reference), len(sequence)
    best = {}
    for i, j in itertools.product(range(n + 1), range(m + 1)):
        at = lambda s, a, b: best.get((s, a, b), LOST)  # noqa: B023, E731
        if i == j == 0:
            best["pair", 0, 0] = 0
            continue
        if i and j:
            best["pair", i, j] = max(at(s, i - 1, j - 1) for s in ("pair", "extra", "gap")) + (MATCH if reference[i - 1] == sequence[j - 1] else MISMATCH)
        if j:
            best["extra", i, j] = max(at("pair", i, j - 1) + OPEN, at("gap", i, j - 1) + OPEN, at("extra", i, j - 1) + EXTEND)
        if i:
            best["gap", i, j] = max(at("pair", i - 1, j) + OPEN, at("extra", i - 1, j) + OPEN, at("gap", i - 1, j) + EXTEND)
    at = lambda s, a, b: best.get((s, a, b), LOST)
    out, i, j = ["-"] * n, n, m
    state = max(("pair", "extra", "gap"), key=lambda s: at(s, n, m))
    top = at(state, n, m)
    while i or j:
        score = at(state, i, j)
        if state == "pair":
            out[i - 1] = sequence[j - 1]
            i, j = i - 1, j - 1
            state = max(("pair", "extra", "gap"), key=lambda s: at(s, i, j))
        elif state == "gap":
            i -= 1
            state = next(s for s, c in (("pair", OPEN), ("extra", OPEN), ("gap", EXTEND)) if at(s, i, j) + c == score)
        else:
            j -= 1
            state = next(s for s, c in (("pair", OPEN), ("gap", OPEN), ("extra", EXTEND)) if at(s, i, j) + c == score)
    return top, "".join(out)


def best_score(sequence, reference):
    """The best score of all ways to pair increasing places, counted out one by one."""
    n, m, top = len(reference), len(sequence), LOST
    runs = lambda left: OPEN + EXTEND * (left - 1) if left else 0
    for k in range(min(n, m) + 1):
        for a in itertools.combinations(range(n), k):
            for b in itertools.combinations(range(m), k):
                score = sum(MATCH if reference[x] == sequence[y] else MISMATCH for x, y in zip(a, b))
                edges_a, edges_b = [-1, *a, n], [-1, *b, m]
                score += sum(runs(y - x - 1) for x, y in zip(edges_a, edges_a[1:])) + sum(runs(y - x - 1) for x, y in zip(edges_b, edges_b[1:]))
                top = max(top, score)
    return top


def test_batches_equal_tables_filled_cell_by_cell():
    r = random.Random(3)
    for letters in ("AC", "ACGT", "é\U0001f600B"):
        for n in (0, 1, 5, 12):
            reference = "".join(r.choice(letters) for _ in range(n))
            sequences = ["".join(r.choice(letters) for _ in range(r.randrange(18))) for _ in range(25)] + ["", reference]
            assert alignment.aligned_batch(sequences, reference) == [plain(s, reference)[1] for s in sequences]
    assert alignment.aligned_batch([], "AC") == []


def test_the_optimum_is_that_of_all_alignments():
    r = random.Random(5)
    for _ in range(40):
        a, b = ("".join(r.choice("AC") for _ in range(r.randrange(6))) for _ in range(2))
        assert plain(a, b)[0] == best_score(a, b)


@pytest.mark.parametrize("cells", [1 << 24, 4000])
def test_each_different_sequence_is_aligned_once(spark, monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    r = random.Random(7)
    rows = ["".join(r.choice("ACGT") for _ in range(r.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in [*rows, *rows[:9], None]], "sequence string")
    got = {x["sequence"]: x["projected"] for x in alignment.project(df, "ACGTTGCA").collect()}
    assert got == {s: plain(s, "ACGTTGCA")[1] for s in rows}

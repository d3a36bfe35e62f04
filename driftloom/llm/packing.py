"""Best-fit packing of token pieces by minimum bin slack (operator 8).

Pieces of one length are interchangeable, so the plan is made on the histogram of lengths, which has
at most ``capacity`` entries whatever the input. Each pattern starts with the longest length left; a
bitset of reachable sums over the other lengths finds the fullest combination for the rest of the bin,
and the pattern is removed as often as the histogram allows. Pieces are then dealt to the bins by
their rank within their length, which tasks count on their own and a small table makes global.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .scratch import Scratch

CAPACITY = 2048
_SHIFT = 1 << 44


def fullest(rest: int, left: list[int], lengths: list[int]) -> dict[int, int]:
    """Counts by length of the combination of available lengths with the largest sum up to ``rest``."""
    mask = (1 << (rest + 1)) - 1
    reach, steps = 1, []
    for size in lengths:
        if size > rest:
            continue
        have, take = min(left[size], rest // size), 1
        while have > 0:
            n = min(take, have)
            steps.append((reach, size, n))
            reach |= reach << (n * size) & mask
            have -= n
            take *= 2
        if reach >> rest & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, size, n in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + n
            at -= n * size
    return used


def longest(rest: int, left: list[int], lengths: list[int]) -> dict[int, int]:
    """Counts by length of what fits into ``rest``, the longest piece first."""
    used = {}
    for size in lengths:
        if n := min(left[size], rest // size):
            used[size] = n
            rest -= n * size
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns: how many bins, and how many pieces of each length in one of them.

    Filling bins to the brim may use up the short pieces too early. Where taking the longest piece that
    fits needs fewer bins, these are the plan.
    """
    return min((_patterns(histogram, capacity, fill) for fill in (fullest, longest)), key=lambda made: sum(times for times, _ in made))


def _patterns(histogram: dict[int, int], capacity: int, fill: Callable[[int, list[int], list[int]], dict[int, int]]) -> list[tuple[int, dict[int, int]]]:
    left = [0] * (capacity + 1)
    for size, n in histogram.items():
        left[size] = n
    lengths = [s for s in range(capacity, 0, -1) if left[s]]
    out = []
    while lengths:
        top = lengths[0]
        left[top] -= 1
        used = fill(capacity - top, left, lengths)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[s] // n for s, n in used.items())
        for s, n in used.items():
            left[s] -= n * times
        out.append((times, used))
        lengths = [s for s in lengths if left[s]]
    return out


def _dealt(patterns: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length * shift + first rank, pieces in a bin, first bin, offset), in order of the first column."""
    rows, next_rank, bins = [], {}, 0
    for times, used in patterns:
        offset = 0
        for size, n in sorted(used.items(), reverse=True):
            rows.append((size * _SHIFT + next_rank.get(size, 0), n, bins, offset))
            next_rank[size] = next_rank.get(size, 0) + n * times
            offset += n * size
        bins += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Pack all pieces of ``docs`` (``doc_id``, ``text``) into sequences of at most ``capacity`` tokens.

    A null or empty text is one piece, its end token. Repeated rows are packed each. An empty table
    gives an empty one. Only doc_id and text are read, so other columns may have any name.
    """
    scratch = Scratch(spark, "pack")
    made = scratch.keep(bpe.pieces(docs, vocabulary, capacity, end_id), "pieces")
    sizes = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = scratch.keep(sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = _dealt(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            key = size * _SHIFT + rank
            first, n, bins, offset = table[np.searchsorted(table[:, 0], key, "right") - 1].T
            nth = key - first
            cols = [batch.column(i) for i in range(5)] + [pa.array(bins + nth // n), pa.array(offset + nth % n * size)]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = made.join(sizes.select("part", "length", "base"), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

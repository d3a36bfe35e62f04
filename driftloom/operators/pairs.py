"""Weighted summaries of each query's distances to a panel, without a row for a pair.

Blocks of queries meet blocks of references inside tasks, as large ones as a task can hold: what is dealt
out is a copy of a block for each block that it meets. What leaves a task is a summary of each query for
each block: sums, extremes, and some points of the weighted distribution, most of them around the wanted
quantiles, with the weight up to and before each. Summaries are merged by query. Where hidden values
could still be the wanted quantile, the blocks are compared again and only the interval around it is
summed up. A panel of one block shows its quantiles at once. Distances and weights are whole numbers
inside, so sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Queries and references of a block, and points of a distribution that leave a block.
QUERIES = 4096
REFERENCES = 65_536
POINTS = 128
DIGITS = 6
ROUNDS = 8
QUANTILES = {"p50": 0.5, "p10": 0.1, "p90": 0.9}
#: Distances that a task holds at a time, and references that are compared in one step.
HELD = 1 << 21
STEP = 4096

_LEAST, _MOST = -(1 << 62), 1 << 62
_PART = "key string, query_id long, target int, n long, weight long, moment decimal(38,0), low long, high long, below long, points array<struct<d:long,upto:long,before:long>>"

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _summed_squares(gaps: Iterator[np.ndarray], total: np.ndarray) -> np.ndarray:
    for gap in gaps:
        total += gap * gap
    return total


def euclidean(queries: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distances of all rows of one matrix to all of another that round to the same DIGITS digits as sums of squares from the first component on.

    Products give all of them; those that are so near to half a unit, or so small, that the error of a
    product could change the digits are summed up one by one.
    """
    size, unit = queries.shape[1], 10.0**DIGITS
    left, right = (queries * queries).sum(1), (references * references).sum(1)
    scale = float(left.max(initial=0.0) + right.max(initial=0.0))
    squares = left[:, None] + right - 2.0 * (queries @ references.T)
    least = 1e-6 * scale
    # both ways of summing are off by at most this, with room
    error = 8 * (size + 4) * 2.0**-53 * scale
    found = np.sqrt(np.maximum(squares, 0.0))
    units = found * unit
    slack = unit * error / (2 * least**0.5) + 2.0**-48 * unit * (2 * scale) ** 0.5 if scale else 0.0
    unsure = np.abs(units - np.floor(units) - 0.5) <= slack
    unsure |= squares <= least
    rows, columns = np.nonzero(unsure)
    for a in range(0, len(rows), STEP):
        r, c = rows[a : a + STEP], columns[a : a + STEP]
        found[r, c] = np.sqrt(_summed_squares((queries[r, k] - references[c, k] for k in range(size)), np.zeros(len(r))))
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(distance: Distance, queries: np.ndarray, references: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances in whole units, some queries at a time, with the place of the first."""
    some = max(1, HELD // max(1, len(references)))
    for first in range(0, len(queries), some):
        own = queries[first : first + some]
        out = np.empty((len(own), len(references)), np.int64)
        for a in range(0, len(references), STEP):
            out[:, a : a + STEP] = np.rint(distance(own, references[a : a + STEP]) * 10**DIGITS)
        yield first, out


def _sorted(units: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row in order, and the weights in that order."""
    bits = int(weights.max()).bit_length()
    if units.min() >= 0 and weights.min() >= 0 and int(units.max()).bit_length() + bits < 63:
        both = units << bits | weights
        both.sort(axis=1)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(units, axis=1, kind="stable")
    return np.take_along_axis(units, order, 1), weights[order]


def _places(d: np.ndarray, upto: np.ndarray, shares: list[float], points: int, alone: bool) -> np.ndarray:
    """Places of a sorted row whose values are shown: the last one, those around each quantile, and if there are other blocks some of all."""
    found = [np.array([len(d) - 1])]
    for share in shares:
        at = min(int(np.searchsorted(upto, share * int(upto[-1]) - 1e-12)), len(d) - 1)
        found.append(np.array([at, max(0, int(np.searchsorted(d, d[at])) - 1)]))
        if not alone:
            # the quantile of all blocks is about as far from this one's as chance puts it
            span = 1 + 4 * (share * (1 - share) * len(d)) ** 0.5
            found.append(np.clip(np.linspace(at - span, at + span, max(1, points // 4)).astype(np.int64), 0, len(d) - 1))
    if not alone:
        found.append(np.linspace(0, len(d) - 1, max(1, points // 4)).astype(np.int64))
    return np.unique(np.concatenate(found))


def _summed(distance: Distance, points: int, asked: pa.Table, held: pa.Table) -> pa.Table:
    """Summaries of the queries of a block over a block of references: of all, or inside each query's intervals."""
    schema = pa.schema([("key", pa.string()), ("query_id", pa.int64()), ("target", pa.int32()), ("n", pa.int64()), ("weight", pa.int64()), ("moment", pa.decimal128(38, 0)), ("low", pa.int64()), ("high", pa.int64()), ("below", pa.int64()), ("points", pa.list_(pa.struct([(c, pa.int64()) for c in ("d", "upto", "before")])))])
    if not asked.num_rows or not held.num_rows:
        return schema.empty_table()
    weights, alone = held["weight"].combine_chunks().to_numpy().astype(np.int64), held["blocks"][0].as_py() == 1
    total, shares, key = sum(weights.tolist()), list(QUANTILES.values()), asked["key"][0].as_py()
    ids, intervals = asked["query_id"].to_pylist(), asked["intervals"].to_pylist() if "intervals" in asked.column_names else None
    rows, shown = [], []
    for first, units in _units(distance, _matrix(asked["v"]), _matrix(held["v"])):
        if intervals is None:
            ordered, own = _sorted(units, weights)
            sums = np.cumsum(own, axis=1)
            short = int(ordered[:, -1].max()) * total < 1 << 62
            for i, (d, w, upto) in enumerate(zip(ordered, own, sums)):
                moment = int(d @ w) if short else sum(int(x) * int(y) for x, y in zip(d, w))
                values = np.unique(d[_places(d, upto, shares, points, alone)])
                before = np.searchsorted(d, values)
                shown.append((values, upto[np.searchsorted(d, values, side="right") - 1], np.where(before > 0, upto[before - 1], 0)))
                rows.append((key, ids[first + i], -1, len(d), total, moment, int(d[0]), int(d[-1]), 0))
            continue
        for i, d in enumerate(units):
            for t in intervals[first + i]:
                inside = np.flatnonzero((d > t["low"]) & (d <= t["high"]))
                below = int(weights[d <= t["low"]].sum())
                values, place = np.unique(d[inside], return_inverse=True)
                sums = np.bincount(place, weights[inside], minlength=len(values)).astype(np.int64) if total < 1 << 53 else np.array([int(weights[inside][place == j].sum()) for j in range(len(values))], np.int64)
                upto = below + np.cumsum(sums)
                at = np.unique(np.linspace(0, len(values) - 1, min(points, len(values))).astype(np.int64)) if len(values) else np.zeros(0, np.int64)
                shown.append((values[at], upto[at], (upto - sums)[at]))
                rows.append((key, ids[first + i], t["target"], len(d), total, 0, int(d.min()), int(d.max()), below))
    flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*shown)]
    ends = np.cumsum([0, *(len(x[0]) for x in shown)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in flat], ["d", "upto", "before"]))
    return pa.Table.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows), schema)), lists], schema=schema)


def located(blocks: list[tuple[int, list[dict]]], share: float, total: int) -> tuple[int, int, bool]:
    """The interval (low, high] that holds the least value with ``share`` of the weight up to it, and whether that is ``high``.

    Each block has the weight below its interval and points of what is inside, the last value among them.
    """
    return _located([(below, *(np.array([p[c] for p in points], np.int64) for c in ("d", "upto", "before"))) for below, points in blocks], share, total)


def _located(blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], share: float, total: int) -> tuple[int, int, bool]:
    values = np.unique(np.concatenate([b[1] for b in blocks]))
    sure, could, hidden = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    for below, d, upto, before in blocks:
        if not len(d):
            sure += below
            could += below
            continue
        at = np.searchsorted(d, values, side="right")
        mine = np.where(at > 0, upto[at - 1], below)
        sure += mine
        shown = (at > 0) & (d[at - 1] == values)
        could += np.where(shown | (at == len(d)), mine, before[np.minimum(at, len(d) - 1)])
        # values of this block that lie before a point and are not shown
        first = np.searchsorted(d, values, side="left")
        known = np.where(first > 0, upto[first - 1], below)
        hidden |= (first < len(d)) & (before[np.minimum(first, len(d) - 1)] > known)
    wanted = share * total - 1e-12
    at = int(np.searchsorted(sure, wanted))  # grows with the values
    high = int(values[at])
    earlier = np.flatnonzero(could[:at] < wanted)
    low = int(values[earlier[-1]]) if len(earlier) else _LEAST
    return low, high, bool((len(earlier) == at) and not hidden[at])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The found quantile of each query and target, or the interval to look through next."""
    for batch in batches:
        blocks = batch.column(4)
        below, points = blocks.flatten().field("below").to_numpy(), blocks.flatten().field("points")
        starts, ends = blocks.offsets.to_numpy() - blocks.offsets[0].as_py(), points.offsets.to_numpy() - points.offsets[0].as_py()
        flat = [points.flatten().field(c).to_numpy() for c in ("d", "upto", "before")]
        out = []
        for i, (key, query, targets, weight) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)))):
            own = [(int(below[j]), *(c[ends[j] : ends[j + 1]] for c in flat)) for j in range(starts[i], starts[i + 1])]
            for target in targets:
                low, high, done = _located(own, list(QUANTILES.values())[target], weight)
                out.append((key, query, target, weight, low, high, done))
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["key", "query_id", "target", "weight", "low", "high", "done"])


def summaries(queries: DataFrame, references: DataFrame, distance: Distance = euclidean) -> DataFrame:
    """``key``, ``query_id``, ``mean``, ``p50``, ``p10``, ``p90``, ``least``, ``most`` and ``panel_size`` of each query.

    ``queries`` has key (the panel's name), query_id and v; ``references`` has key, reference_id, v and a whole
    ``weight``. Each query is held against all references of its key; a query without any has no row.
    Distances have DIGITS digits. Quantiles are the least distance with that share of the weight up to it.
    """
    # what is compared is much more than what is read: tasks are not put together by the size of their rows
    tasks = 4 * int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = written(references.select("key", F.xxhash64("reference_id").alias("h"), F.col("weight").cast("long").alias("weight"), "v"), "references")
    # a row for each panel
    sizes = written(held.groupBy("key").agg(F.ceil(F.count("*") / REFERENCES).cast("int").alias("blocks")), "panels")
    held = held.join(F.broadcast(sizes), "key").withColumn("block", F.pmod("h", "blocks").cast("int")).drop("h")
    grouped = queries.groupBy("key").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    asked = queries.join(F.broadcast(grouped), "key").select("key", "query_id", "v", F.pmod(F.xxhash64("query_id"), "groups").cast("int").alias("group"))
    open_ = asked = written(asked, "queries")
    points = POINTS

    def summed(asked: pa.Table, held: pa.Table) -> pa.Table:
        return _summed(distance, points, asked, held)

    sums, found = None, None
    for i in range(ROUNDS):
        own = open_.join(F.broadcast(sizes), "key").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").repartition(tasks, "key", "group", "block")
        meeting = open_.select("key", F.col("group").alias("meets")).distinct()
        other = held.join(F.broadcast(meeting), "key").repartition(tasks, "key", "meets", "block")
        parts = written(own.groupBy("key", "group", "block").cogroup(other.groupBy("key", "meets", "block")).applyInArrow(summed, _PART), "summaries")
        if i == 0:
            sums = parts.groupBy("key", "query_id").agg(
                F.sum("n").alias("panel_size"), F.sum("weight").alias("weight"), F.sum("moment").alias("moment"), F.min("low").alias("least"), F.max("high").alias("most")
            )
        # a summary for each block of the panel, of about POINTS points
        ways = parts.groupBy("key", "query_id", "target").agg(F.sum("weight").alias("weight"), F.collect_list(F.struct("below", "points")).alias("blocks"))
        targets = F.when(F.col("target") < 0, F.array(*[F.lit(t) for t in range(len(QUANTILES))])).otherwise(F.array("target"))
        ways = ways.select("key", "query_id", targets.alias("targets"), "weight", "blocks")
        state = written(ways.mapInArrow(_merged, "key string, query_id long, target int, weight long, low long, high long, done boolean"), "quantiles")
        own = state.where("done").select("key", "query_id", "target", "high")
        found = own if found is None else found.unionByName(own)
        rest = state.where("not done")
        if rest.isEmpty():
            break
        intervals = rest.groupBy("key", "query_id").agg(F.collect_list(F.struct("target", "low", "high")).alias("intervals"))
        open_ = asked.join(intervals, ["key", "query_id"])
    else:
        raise RuntimeError(f"intervals are not settled after {ROUNDS} rounds")
    scale = float(10**DIGITS)
    wide = found.groupBy("key", "query_id").agg(*[(F.max(F.when(F.col("target") == i, F.col("high"))) / scale).alias(name) for i, name in enumerate(QUANTILES)])
    mean = F.call_function("div", 2 * F.col("moment") + F.col("weight"), 2 * F.col("weight")) / scale
    return sums.join(wide, ["key", "query_id"]).select("key", "query_id", mean.alias("mean"), *QUANTILES, (F.col("least") / scale).alias("least"), (F.col("most") / scale).alias("most"), "panel_size")

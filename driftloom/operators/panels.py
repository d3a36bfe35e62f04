"""Reference panels: time strata, seats for each, and weighted farthest-point coresets."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from datetime import date
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.simplex import over
from ..sources.shared import written

#: Leading strains of a window and stratum that leave a pass; the next ones are taken from them while no other strain can be ahead.
KEPT = 32

#: A strain with its weight and date, and the places of the windows and strata that it is a candidate of.
_STATE = "query_id long, sequence string, date date, weight double, groups array<int>"
_LEADERS = "group int, query_id long, sequence string, date date, weight double, nearest double, score double"
_DAY0 = date(1970, 1, 1)


def seats(sizes: dict[int, int], panel: int, strata: int) -> dict[int, int]:
    """Seats of each stratum: dealt round by round, and those that small strata can't take to the largest rests.

    A stratum with a rest of r asks for a further seat r times, with r, r - 1, … for its urgency; the
    most urgent askings are met, the earlier stratum first among equals.
    """
    dealt = {s: min(n, (panel - s + strata - 1) // strata) for s, n in sizes.items()}
    spare = min(panel, sum(sizes.values())) - sum(dealt.values())
    asking = ((sizes[s] - taken - i, -s) for s, taken in dealt.items() for i in range(min(sizes[s] - taken, spare)))
    met = Counter(-s for _, s in heapq.nlargest(spare, asking))
    return {s: taken + met[s] for s, taken in dealt.items()}


def panel(strains: DataFrame, cutoffs: DataFrame, size: int, months: int = 6, years: int = 3, outlying: float = 0.25) -> DataFrame:
    """A panel for each cutoff: strains (query_id, sequence, date, weight; equal lengths) in strata of ``months``.

    Seats are dealt by the strata's sizes, a row each. In every stratum strains are taken one at a time, from
    all its strains: first the heaviest, then the one whose distance to the nearest taken one, times the root
    of its weight, is largest; in the last rounds, a share of ``outlying``, the distance alone counts. Among
    equals the heavier, then the earlier one comes first. ``reference_weight`` is the weight of the strains
    nearest to a taken one, the first taken among equals, as a share of the panel. Only leading strains reach
    the driver, KEPT of a window and stratum in each pass. ``query_id`` is a key.
    """
    strata = _strata(size, months, years)
    windows, calendar = _calendar(cutoffs, months, years, strata)
    by_day: dict[date, list[int]] = {}
    for w, own in calendar.items():
        for day, s in own.items():
            by_day.setdefault(day, []).append(windows.index(w) * strata + s)
    # a row for each day of the windows
    days = strains.sparkSession.createDataFrame(list(by_day.items()), "date date, groups array<int>")
    rows = strains.join(F.broadcast(days), "date").select("query_id", "sequence", "date", F.col("weight").cast("double").alias("weight"), "groups")
    return _chosen(written(rows, "panel"), windows, strata, size, outlying)


def past_panel(instances: DataFrame, cutoffs: DataFrame, size: int, months: int = 6, years: int = 3, outlying: float = 0.25) -> DataFrame:
    """A panel for each cutoff from what was observed before it: instances (query_id, sequence, date), one for each observation.

    A strain weighs as often as it was observed in the ``years`` before the recent half-year, and has
    the date of its last observation there; strains observed in the recent half-year are left out.
    """
    strata = _strata(size, months, years)
    windows, calendar = _calendar(cutoffs, months, years, strata)
    ends = {r["window_id"]: r["recent_end"] for r in cutoffs.select("window_id", "recent_end").collect()}
    # first and last day and the day after the past of each window, and the strata of its past by day
    spans = [((min(calendar[w]) - _DAY0).days, (max(calendar[w]) - _DAY0).days + 1, (ends[w] - _DAY0).days, np.array([calendar[w][d] for d in sorted(calendar[w])], np.int32)) for w in windows]
    if not spans:
        return _chosen(instances.sparkSession.createDataFrame([], _STATE), windows, strata, size, outlying)
    seen = instances.select("query_id", "sequence", "date").where(F.col("date").between(min(min(c) for c in calendar.values()), max(ends.values())))
    # the days of a strain meet in one task, each once from every batch
    dealt = seen.mapInArrow(_days, "query_id long, sequence string, date date, n long").repartition("query_id", "sequence")
    by_day = dealt.groupBy("query_id", "sequence", "date").agg(F.sum("n").alias("n"))
    strains = by_day.groupBy("query_id", "sequence").agg(F.collect_list(F.struct("date", "n")).alias("seen"))
    return _chosen(written(strains.mapInArrow(partial(_weighed, spans, strata), _STATE), "panel"), windows, strata, size, outlying)


def _strata(size: int, months: int, years: int) -> int:
    strata = -(-12 * years // months)
    if size < strata:
        raise ValueError("the panel needs a seat for each stratum")
    return strata


def _calendar(cutoffs: DataFrame, months: int, years: int, strata: int) -> tuple[list[int], dict[int, dict[date, int]]]:
    """The windows in order, and the stratum of each day of their past: a row for each window and day."""
    spans = cutoffs.select("window_id", F.add_months("recent_start", -12 * years).alias("past_start"), F.col("recent_start").alias("past_end"))
    days = spans.select("window_id", "past_start", F.explode(F.sequence("past_start", F.date_sub("past_end", 1))).alias("date"))
    stratum = F.least(F.floor(F.months_between("date", "past_start") / months), F.lit(strata - 1)).cast("int")
    calendar: dict[int, dict[date, int]] = {}
    for r in days.select("window_id", "date", stratum.alias("stratum")).collect():
        calendar.setdefault(r["window_id"], {})[r["date"]] = r["stratum"]
    return sorted(calendar), calendar


def _days(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each strain of a batch was observed on a day."""
    for batch in batches:
        counts = pa.Table.from_batches([batch]).group_by(["query_id", "sequence", "date"], use_threads=False).aggregate([([], "count_all")])
        yield from counts.rename_columns(["query_id", "sequence", "date", "n"]).to_batches()


def _weighed(spans: list[tuple], strata: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strains with the days of their observations as candidates: a row for each weight and last date that windows see."""
    for batch in batches:
        seen, n = batch.column(2), batch.num_rows
        rows = np.repeat(np.arange(n), np.diff(seen.offsets.to_numpy()))
        day, often = seen.flatten().field("date").cast(pa.int32()).to_numpy(), seen.flatten().field("n").to_numpy()
        found = []
        for w, (first, end, recent_end, stratum) in enumerate(spans):
            past = (day >= first) & (day < end)
            now = (day >= end) & (day <= recent_end)
            weight = np.bincount(rows[past], often[past], minlength=n)
            last = np.full(n, first, day.dtype)
            np.maximum.at(last, rows[past], day[past])
            own = np.flatnonzero((weight > 0) & (np.bincount(rows[now], minlength=n) == 0))
            found.append((own, last[own], weight[own], w * strata + stratum[last[own] - first]))
        row, last, weight, group = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((group, weight, last, row))
        row, last, weight, group = row[order], last[order], weight[order], group[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (last[1:] != last[:-1]) | (weight[1:] != weight[:-1])][: len(row)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(group.astype(np.int32)))
        at = pa.array(row[starts])
        columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(last[starts].astype(np.int32)).cast(pa.date32()), pa.array(weight[starts]), lists]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "sequence", "date", "weight", "groups"])


def _words(texts: list[bytes] | pa.Array) -> np.ndarray:
    """Sequences of one length as rows of 8-byte words, filled up with zeros."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.binary())
    n, ends = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    sizes = np.diff(ends)
    size = int(sizes[0]) if n else 0
    if (sizes != size).any():
        raise ValueError("sequences have different lengths")
    letters = np.zeros((n, -(-size // 8) * 8), np.uint8)
    if size:
        letters[:, :size] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, size)
    return letters.view(np.uint64)


def _apart(words: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Places at which rows differ from one: bytes of their exclusive or that aren't zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    found = np.zeros(len(words), np.int64)
    for k in range(words.shape[1]):
        x = words[:, k] ^ centre[k]
        found += np.bitwise_count((((x & low) + low) | x) & ~low)
    return found


def _nearest(words: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distance of the nearest centre, and its place, the first one among equals."""
    nearest, owner = np.full(len(words), np.inf), np.zeros(len(words), np.int64)
    for i, centre in enumerate(centres):
        apart = _apart(words, centre)
        nearer = apart < nearest
        nearest[nearer], owner[nearer] = apart[nearer], i
    return nearest, owner


def _members(batch: pa.RecordBatch, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The groups of ``wanted`` that have rows in a batch, and these rows."""
    lists = batch.column(4)
    rows, groups = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    here = np.isin(groups, wanted)
    rows, groups = rows[here], groups[here]
    order = np.argsort(groups, kind="stable")
    rows, groups = rows[order], groups[order]
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]][: len(groups)])
    for a, b in zip(starts, np.append(starts[1:], len(groups))):
        yield int(groups[a]), rows[a:b]


def _leaders(about: dict[int, tuple], kept: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leading strains of each group of a task: ``about`` has a group's centres, whether distances count alone, and the taken ids."""
    wanted, lead = np.array(sorted(about)), {}
    known = {g: (_words(c), plain, np.array(sorted(ids), np.int64)) for g, (c, plain, ids) in about.items()}
    for batch in batches:
        if not batch.num_rows:
            continue
        words, ids, weights = _words(batch.column(1)), batch.column(0).to_numpy(), batch.column(3).to_numpy()
        days = batch.column(2).cast(pa.int32()).to_numpy()
        for g, rows in _members(batch, wanted):
            centres, plain, taken = known[g]
            near = _nearest(words[rows], centres)[0]
            score = np.zeros(len(rows)) if not len(centres) else near if plain else near * np.sqrt(weights[rows])
            held = lead.get(g)
            fit = np.flatnonzero(score >= held[0][-1]) if held and len(held[0]) == kept else np.arange(len(rows))
            fit = fit[~np.isin(ids[rows[fit]], taken)]
            if not len(fit):
                continue
            r = rows[fit]
            new = (score[fit], weights[r], days[r], ids[r], near[fit], None)
            order = np.lexsort((new[3], new[2], -new[1], -new[0]))[:kept]
            new = (*(c[order] for c in new[:5]), np.array(batch.column(1).take(pa.array(r[order])).to_pylist(), object))
            if held:
                new = tuple(np.concatenate(c) for c in zip(held, new))
                order = np.lexsort((new[3], new[2], -new[1], -new[0]))[:kept]
                new = tuple(c[order] for c in new)
            lead[g] = new
    for g, (score, weight, day, ids, near, text) in lead.items():
        columns = [pa.array(np.full(len(ids), g, np.int32)), pa.array(ids), pa.array(text, pa.string()), pa.array(day.astype(np.int32)).cast(pa.date32()), pa.array(weight), pa.array(near), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, ["group", "query_id", "sequence", "date", "weight", "nearest", "score"])


def _masses(centres: dict[int, list[bytes]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weight of the strains of a task that are nearest to each centre of their group."""
    known, mass = {g: _words(c) for g, c in centres.items()}, {g: np.zeros(len(c)) for g, c in centres.items()}
    wanted = np.array(sorted(centres))
    for batch in batches:
        if not batch.num_rows:
            continue
        words, weights = _words(batch.column(1)), batch.column(3).to_numpy()
        for g, rows in _members(batch, wanted):
            mass[g] += np.bincount(_nearest(words[rows], known[g])[1], weights[rows], minlength=len(known[g]))
    for g, own in mass.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), g, np.int32)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["group", "owner", "mass"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for batch in batches:
        groups, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        total.update(dict(zip(groups.tolist(), n.tolist())))
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["group", "n"])


def _taken(leaders: list, whole: bool, centres: list[bytes], wanted: int, last: int) -> list:
    """The next strains of a group from the leading ones of a pass, best first; ``whole`` if there are no others.

    Pulls only fall as strains are taken: a strain that is still ahead of where the last leading one was
    is ahead of all that the pass left out. The pass holds for one way of pulling.
    """
    rank = lambda score, r: (score, r["weight"], -(r["date"] - _DAY0).days, -r["query_id"])
    if not centres:
        return leaders[:1]
    plain, n = len(centres) >= wanted - last, len(centres)
    floor = rank(leaders[-1]["score"], leaders[-1]) if leaders else ()
    words, near, out = _words([r["sequence"].encode() for r in leaders]), np.array([r["nearest"] for r in leaders]), []
    left = list(range(len(leaders)))
    while left and n + len(out) < wanted and (n + len(out) >= wanted - last) == plain:
        ranks = {i: rank(near[i] if plain else near[i] * np.sqrt(leaders[i]["weight"]), leaders[i]) for i in left}
        best = max(left, key=ranks.get)
        if not whole and ranks[best] < floor:
            break
        out.append(leaders[best])
        left.remove(best)
        near = np.minimum(near, _apart(words, words[best]))
    return out


def _chosen(state: DataFrame, windows: list[int], strata: int, size: int, outlying: float) -> DataFrame:
    """The panels of candidates, a strain once for each weight and date."""
    spark = state.sparkSession
    pools = {r["group"]: r["n"] for r in state.select("groups").mapInArrow(_sizes, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).collect()}
    wanted: dict[int, int] = {}
    for w in range(len(windows)):
        own = {s: pools[w * strata + s] for s in range(strata) if w * strata + s in pools}
        wanted |= {w * strata + s: n for s, n in seats(own, size, strata).items() if n}
    chosen: dict[int, list] = {g: [] for g in wanted}
    few = [g for g, n in wanted.items() if pools[g] <= n]
    if few:
        named = F.array(*[F.lit(g) for g in few])
        rows = state.where(F.arrays_overlap("groups", named)).withColumn("group", F.explode(F.array_intersect("groups", named)))
        for r in rows.collect():  # at most as many as there are seats
            chosen[r["group"]].append(r)
    last = {g: min(n - 1, int(round(n * outlying))) for g, n in wanted.items()}
    centres = {g: [] for g in wanted if g not in few}
    while due := [g for g in centres if len(chosen[g]) < wanted[g]]:
        about = {g: (centres[g], len(chosen[g]) >= wanted[g] - last[g], [r["query_id"] for r in chosen[g]]) for g in due}
        found = _pass(state, about)
        for g in due:
            if g not in found:  # ids that are there twice are taken once
                wanted[g] = len(chosen[g])
                continue
            chosen[g] += _taken(found[g], len(found[g]) < KEPT, centres[g], wanted[g], last[g])
            centres[g] = [r["sequence"].encode() for r in chosen[g]]
    mass: dict[tuple[int, int], float] = {}
    if centres:
        sums = state.mapInArrow(partial(_masses, centres), "group int, owner int, mass double").groupBy("group", "owner").agg(F.sum("mass").alias("mass"))
        mass = {(r["group"], r["owner"]): r["mass"] for r in sums.collect()}
    out = []
    for g, c in chosen.items():
        own = [float(r["weight"]) if g in few else mass.get((g, i), 0.0) for i, r in enumerate(c)]
        out += [(windows[g // strata], g % strata, r["query_id"], r["date"], float(r["weight"]), m / sum(own)) for r, m in zip(c, own)]
    found = spark.createDataFrame(out, "window_id int, stratum int, query_id long, date date, weight double, reference_weight double")
    total = F.sum("reference_weight").over(over("window_id"))
    return found.withColumn("reference_weight", F.col("reference_weight") / total)


def _pass(state: DataFrame, about: dict[int, tuple]) -> dict[int, list]:
    """The leading strains of each group, best first; fewer than KEPT are all that aren't taken yet."""
    order = over("group").orderBy(F.desc("score"), F.desc("weight"), "date", "query_id")
    lead = state.mapInArrow(partial(_leaders, about, KEPT), _LEADERS).withColumn("place", F.row_number().over(order)).where(F.col("place") <= KEPT)
    found: dict[int, list] = {}
    for r in sorted(lead.collect(), key=lambda r: r["place"]):  # at most KEPT for each window and stratum
        found.setdefault(r["group"], []).append(r)
    return found

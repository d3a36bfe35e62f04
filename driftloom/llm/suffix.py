"""Removal of repeated byte strings by suffix order and longest previous factors (operator 10).

Every window of ``window`` bytes selects the ``gram``-byte string of the smallest hash in it, its
anchor; equal windows select equal anchors. Windows whose anchor occurs once cannot repeat. The others
of one anchor form a region of the text; equal regions (by BLAKE2 of their bytes) are counted and stand
once, at their first place. Regions that share anchors meet in a shard, where the suffixes at all window
starts are sorted by prefix doubling (tripling where three ranks fit a key) up to the length of a
window, ties by place. The ranks of every step stay, and give the common length of any two suffixes.
The previous and the next smaller position of every entry in that order hold its earlier matches, and
the longer of the two is its longest previous factor; a window is a later copy where that reaches the
window. Where no copy is to stay, the entry that has an equal one after it goes as well.

Equal windows have their anchor at the same place, so windows of an anchor are told apart by that place
in a few classes; all windows of a class in a region hold the same bytes, its core. Only windows whose core
stands in another region of their anchor as well can repeat, and only they are put in order.

An anchor with very many different regions would make a shard grow with the input. Its windows are
grouped in Spark by their bytes instead (those whose hash occurs once are left out before), which
names the same first places: the least position of a class of equal windows has no previous factor.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .substring import keyed, spans
from .textkernel import Texts, blocks, byte_windows, least_places

WINDOW = 400
GRAM = 32
#: Bytes of regions for each shard, about, and different regions of an anchor from which they are hot.
SHARD_BYTES = 600_000
HOT_REGIONS = 4_000
#: Classes of windows by the place of their anchor.
CLASSES = 4
#: Texts whose anchors are selected at once: arrays of eight bytes for each of theirs stay in a core's cache.
BLOCK_BYTES = 100_000


def _selected(texts: Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside a text, the anchor place of each, and the hashes at all places."""
    values = byte_windows(texts.data, gram)
    at = least_places(values, window - gram + 1)
    inside = np.zeros(len(texts.data) + 1, np.int64)
    long = np.flatnonzero(np.diff(texts.offsets) >= window)
    np.add.at(inside, texts.offsets[long], 1)
    np.add.at(inside, texts.offsets[long + 1] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    return start, at[start], values


def _anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in blocks(batch.column(2), BLOCK_BYTES):
                _, at, values = _selected(texts, window, gram)
                own = at[np.flatnonzero(np.diff(at, prepend=-1))]
                row = np.searchsorted(texts.offsets, own, "right") - 1
                take = pa.array(a + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(own - texts.offsets[row]), pa.array(values[own].view(np.int64))], ["k", "t", "place", "hash"])

    return rows.select("k", "t", "text").mapInArrow(run, "k long, t long, place long, hash long")


def _regions(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """The stretch of text of all windows that share one marked anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(3)
            flat, edges = places.values.to_numpy(), places.offsets.to_numpy()
            for a, b, texts in blocks(batch.column(2), BLOCK_BYTES):
                start, at, values = _selected(texts, window, gram)
                count = np.diff(edges[a : b + 1])
                marks = flat[edges[a] : edges[b]] + np.repeat(texts.offsets[:-1], count)
                head = np.flatnonzero(np.diff(at, prepend=-1))
                tail = np.append(head[1:], len(at)) - 1
                own = np.isin(at[head], marks)
                lo, hi, anchor = start[head[own]], start[tail[own]], at[head[own]]
                row = np.searchsorted(texts.offsets, lo, "right") - 1
                content = [texts.data[x:y].tobytes() for x, y in zip(lo.tolist(), (hi + window).tolist())]
                digest = np.frombuffer(b"".join([hashlib.blake2b(c, digest_size=16).digest() for c in content]), np.int64).reshape(-1, 2)
                # equal regions of a text are one row, so that a text of one repeated word is no hot key
                order = np.lexsort((lo, digest[:, 1], digest[:, 0], row))
                new = np.ones(len(order), bool)
                new[1:] = (row[order][1:] != row[order][:-1]) | (digest[order][1:] != digest[order][:-1]).any(1)
                first = np.flatnonzero(new)
                some = order[first]
                found = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), pa.array((lo - texts.offsets[row])[order]))
                take = pa.array(a + row[some])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), found, pa.array(values[anchor[some]].view(np.int64)), *(pa.array(digest[some, i]) for i in (0, 1)), pa.array((anchor - lo)[some]), pa.array([content[i] for i in some.tolist()], pa.binary())],
                    ["k", "t", "places", "hash", "r1", "r2", "anchor", "content"],
                )

    return marked.select("k", "t", "text", "places").mapInArrow(run, "k long, t long, places array<long>, hash long, r1 long, r2 long, anchor long, content binary")


class SuffixOrder:
    """``starts`` in the order of the ``window`` bytes there, ties by place.

    Ranks by the first 8 bytes of all places are joined with those further on; only places that still
    share their rank are sorted again. ``levels`` holds (length, ranks by so many bytes) of every step.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, window: int):
        if window < 8:
            raise ValueError("a window has 8 bytes at least")
        self.window = window
        n = len(data)
        padded = np.concatenate([data, np.zeros(window + 8, np.uint8)])
        words = np.zeros(n, np.uint64)
        for i in range(8):
            words = words << np.uint64(8) | padded[i : i + n]
        self.words = words
        order = np.argsort(words)
        words = words[order]
        fresh = np.concatenate([[True], words[1:] != words[:-1]])
        rank = np.zeros(n + window, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) + 1
        tied = order[~(fresh & np.append(fresh[1:], True))]
        done = 8
        self.levels = [(done, rank.astype(np.int32))]
        three = n + 1 < 1 << 21  # three ranks fit a key, else two
        while done < window and len(tied):
            own, reach = rank[tied], min(done, window - done)
            next_rank = rank[tied + reach]
            if three:
                reach = min(2 * done, window - done)
                next_rank = next_rank << 21 | rank[tied + reach]
            by = np.argsort(own << 42 | next_rank if three else own * np.int64(n + 1) + next_rank)
            tied, own, next_rank = tied[by], own[by], next_rank[by]
            new_class = np.concatenate([[True], own[1:] != own[:-1]])
            fresh = new_class | np.concatenate([[True], next_rank[1:] != next_rank[:-1]])
            place = np.arange(len(tied))
            rank[tied] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(new_class, place, 0))
            tied = tied[~(fresh & np.append(fresh[1:], True))]
            done += reach
            self.levels.append((done, rank.astype(np.int32)))
        self.order = starts[np.argsort(rank[starts] * np.int64(n + 1) + starts)]
        ranked = rank[self.order]
        self.same = np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(starts) else np.zeros(0, bool)

    def common(self) -> np.ndarray:
        """Bytes that each entry of the order shares with the one before, ``window`` at most; 0 for the first."""
        out = np.where(self.same, self.window, 0)
        at = np.flatnonzero(~self.same)[1:]
        one, two = self.order[at - 1], self.order[at]
        length = np.zeros(len(at), np.int64)
        for step, rank in reversed(self.levels):
            live = np.arange(len(at))
            while len(live):
                x, y = one[live] + length[live], two[live] + length[live]
                live = live[(rank[x] == rank[y]) & (length[live] + step <= self.window)]
                length[live] += step
        # the first byte that differs within the next eight
        last = len(self.words) - 1
        differ = self.words[np.minimum(one + length, last)] ^ self.words[np.minimum(two + length, last)]
        for i in range(8):
            length += differ >> np.uint64(56 - 8 * i) == 0
        out[at] = np.minimum(length, self.window)
        return out


def suffix_order(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in order, and whether each shares its ``window`` bytes with the one before."""
    found = SuffixOrder(data, starts, window)
    return found.order, found.same


def _smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What each entry shares with the nearest one before it that has a smaller place (0 if none has).

    ``common`` is what each shares with the one before. Entries point at the one before them and follow
    its pointer while that has a larger place; the least on the way goes along.
    """
    to, shared = np.arange(len(place)) - 1, common.copy()
    live = np.flatnonzero((to >= 0) & (place[to] > place))
    while len(live):
        via = to[live]
        shared[live] = np.minimum(shared[live], shared[via])
        to[live] = to[via]
        live = live[(to[live] >= 0) & (place[to[live]] > place[live])]
    return np.where(to >= 0, shared, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending ``starts``: the length of its longest previous factor, ``window`` at most, and whether an equal window follows."""
    found = SuffixOrder(data, starts, window)
    common = found.common()
    before = _smaller(found.order, common)
    after = _smaller(found.order[::-1], np.append(common[1:], 0)[::-1])[::-1]
    entry = np.zeros(len(data), np.int64)
    entry[starts] = np.arange(len(starts))
    at = entry[found.order]
    factors, later = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    factors[at] = np.maximum(before, after)
    later[at] = np.append(found.same[1:], False) if len(starts) else found.same
    return factors, later


_MATCHED = "hash long, r1 long, r2 long, runs array<long>"


def runs_of(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked places, cut at every ``first``: begin and end by turns, and how many numbers each part has."""
    edge = hit & ~np.concatenate([[False], hit[:-1]])
    edge[first] = hit[first]
    begin = np.flatnonzero(edge)
    stop = hit & ~np.concatenate([hit[1:], [False]])
    last = np.append(first[1:], len(hit)) - 1
    stop[last] = hit[last]
    end = np.flatnonzero(stop) + 1
    part = np.searchsorted(first, begin, "right") - 1
    return np.stack([begin - first[part], end - first[part]], 1).ravel(), 2 * np.bincount(part, minlength=len(first))


def _candidates(table: pa.Table, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region, first window and window after the last of each stretch of windows whose core stands in another region of their anchor too."""
    size = -(-(window - gram + 1) // CLASSES)
    found, often = [], Counter()
    for i, (hash_, anchor, content) in enumerate(zip(*(table[c].to_pylist() for c in ("hash", "anchor", "content")))):
        # a class: the anchor stands from near to before far in its windows
        for near in range(0, anchor + 1, size):
            far = min(near + size, window - gram + 1)
            first, after = max(0, anchor - far + 1), min(len(content) - window, anchor - near) + 1
            if first < after:
                core = hash_, near, content[anchor - near : anchor - far + 1 + window]
                often[core] += 1
                found.append((i, first, after, core))
    own = np.array([x[:3] for x in found if often[x[3]] > 1], np.int64).reshape(-1, 3)
    region, first, after = own[np.lexsort((own[:, 1], own[:, 0]))].T
    head = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (first[1:] != after[:-1])]) if len(region) else region)
    return region[head], first[head], after[np.append(head[1:], len(region)) - 1] if len(head) else after


def _matches(table: pa.Table, window: int, gram: int, keep: str) -> pa.Table:
    """Runs of window starts in each region of a shard that have an earlier match, or any."""
    table = table.sort_by([("fk", "ascending"), ("ft", "ascending"), ("fs", "ascending"), ("hash", "ascending")])
    region, begin, after = _candidates(table, window, gram)
    runs, sizes = np.zeros(0, np.int64), np.zeros(table.num_rows, np.int64)
    if len(region):
        content = table["content"].to_pylist()
        data = b"".join(content[i][a : b + window - 1] for i, a, b in zip(region.tolist(), begin.tolist(), after.tolist()))
        count = after - begin
        first = np.cumsum(count) - count
        starts = np.repeat(np.arange(len(count)) * (window - 1), count) + np.arange(int(count.sum()))
        factors, later = previous_factors(np.frombuffer(data, np.uint8), starts, window)
        earlier = factors >= window
        runs, parts = runs_of(earlier if keep == "first" else earlier | later, first)
        runs += np.repeat(begin, parts)
        np.add.at(sizes, region, parts)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(runs))
    return pa.Table.from_arrays([*(table[c] for c in ("hash", "r1", "r2")), lists], names=["hash", "r1", "r2", "runs"])


def _sharded(regions: DataFrame, window: int, gram: int, keep: str) -> DataFrame:
    """Runs of window starts in each region that have an earlier match, or any."""

    def run(table: pa.Table) -> pa.Table:
        return _matches(table, window, gram, keep)

    return regions.groupBy("shard").applyInArrow(run, _MATCHED)


_PLACED = "hash long, r1 long, r2 long, fk long, ft long, fs long, at int"


def _grouped(scratch: Scratch, regions: DataFrame, window: int, keep: str) -> DataFrame:
    """The same for regions of hot anchors: windows grouped by their bytes, if their hash occurs twice."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in enumerate(batch.column(6).to_pylist()):
                one = byte_windows(np.frombuffer(c, np.uint8), window)
                cols = [batch.column(j).take(pa.array(np.full(len(one), i))) for j in range(6)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(one), dtype=np.int32)), pa.array(one.view(np.int64))], [*batch.schema.names[:6], "at", "one"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = spans(batch.column(7))
            for i, c in enumerate(batch.column(6).to_pylist()):
                at = np.asarray(places[i])
                cols = [batch.column(j).take(pa.array(np.full(len(at), i))) for j in range(6)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at.astype(np.int32)), pa.array([c[x : x + window] for x in at.tolist()], pa.binary())], [*batch.schema.names[:6], "at", "bytes"])

    region = ["hash", "r1", "r2"]
    rows = scratch.keep(regions.select(*region, "fk", "ft", "fs", "content").mapInArrow(hashed, f"{_PLACED}, one long"), "windows")
    twice = scratch.keep(rows.groupBy("one").agg(F.count("*").alias("n")).where("n > 1").select("one"), "twice")
    places = rows.join(twice, "one").groupBy(*region).agg(F.collect_list("at").alias("places"))
    rows = regions.join(places, region).select(*region, "fk", "ft", "fs", "content", "places").mapInArrow(cut, f"{_PLACED}, bytes binary")
    rows = scratch.keep(rows, "bytes")
    place = F.struct("fk", "ft", (F.col("fs") + F.col("at")).alias("p"))
    classes = rows.groupBy("bytes").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    hits = rows.join(scratch.keep(classes.select("bytes", "first"), "classes"), "bytes")
    if keep == "first":
        hits = hits.where(place != F.col("first"))
    run = F.array(F.col("at").cast("long"), F.col("at").cast("long") + 1)
    return hits.groupBy(*region).agg(F.flatten(F.collect_list(run)).alias("runs"))


def _merged(starts: DataFrame) -> DataFrame:
    """The runs of each text in order, those that touch made one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in spans(batch.column(2)):
                begin, end = own[::2], own[1::2]
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                apart = np.flatnonzero(begin[1:] > end[:-1])
                out.append(np.stack([begin[np.append(0, apart + 1)], end[np.append(apart, len(end) - 1)]], 1).ravel())
            edges = np.cumsum([0, *map(len, out)]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["k", "t", "starts"])

    return starts.mapInArrow(run, "k long, t long, starts array<long>")


def _left(column: pa.Array, starts: pa.Array, window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bytes, removed, runs, bytes left) of each text without what its repeated windows cover."""
    flat, edges = starts.values.to_numpy(), starts.offsets.to_numpy()
    for a, b, texts in blocks(column):
        for i in range(b - a):
            data = texts.data[texts.offsets[i] : texts.offsets[i + 1]]
            own = flat[edges[a + i] : edges[a + i + 1]]
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, own[::2], 1)
            np.add.at(edge, own[1::2] + window - 1, -1)
            out = np.cumsum(edge)[:-1] > 0
            runs = int((out & ~np.concatenate([[False], out[:-1]])).sum()) if len(out) else 0
            yield len(data), int(out.sum()), runs, data[~out].tobytes()


def _found(scratch: Scratch, docs: DataFrame, window: int, gram: int, keep: str, hot: int) -> DataFrame:
    """Runs of starts of the windows to remove (begin and end by turns), for each key of ``keyed``."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    rows = keyed(docs)
    anchors = scratch.keep(_anchors(rows, window, gram), "anchors")
    # both sides grow with the texts, so joins are merged at every size; a table of its own, so that one may split a hash with very many places
    shared = scratch.keep(anchors.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "shared")
    places = anchors.join(shared.hint("merge"), "hash").groupBy("k", "t").agg(F.collect_set("place").alias("places"))
    spots = _regions(rows.join(places.hint("merge"), ["k", "t"]), window, gram)
    spots = scratch.keep(spots, "spots")
    scratch.drop("anchors", "shared")
    region = ["hash", "r1", "r2"]
    regions = spots.groupBy(*region).agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("k", "t", F.col("places")[0].alias("start"))).alias("first"), F.first("anchor").alias("anchor"), F.first("content").alias("content"))
    regions = regions.select(*region, "n", F.col("first.k").alias("fk"), F.col("first.t").alias("ft"), F.col("first.start").alias("fs"), "anchor", "content")
    regions = scratch.keep(regions, "regions")
    where = scratch.keep(spots.select("k", "t", "places", *region, (F.length("content") - window + 1).cast("long").alias("windows")), "where")
    scratch.drop("spots")
    sizes = regions.groupBy("hash").agg(F.count("*").alias("different"))
    sizes = scratch.keep(sizes.where(f"different > {hot}").select("hash"), "hot")
    total = regions.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    usual = regions.join(sizes, "hash", "left_anti").withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)))
    matched = scratch.keep(_sharded(usual, window, gram, keep).where("size(runs) > 0"), "matched")
    if not sizes.isEmpty():
        hot_ones = scratch.keep(_grouped(scratch, regions.join(sizes, "hash", "left_semi"), window, keep), "matched-hot")
        matched = matched.unionByName(hot_ones)
        scratch.drop("windows", "twice", "bytes", "classes")
    where = where.join(regions.select(*region, "n", "fk", "ft", "fs"), region).join(matched, region, "left")
    is_first = lambda p: (F.col("k") == F.col("fk")) & (F.col("t") == F.col("ft")) & (p == F.col("fs"))
    every = (lambda p: F.col("n") > 1) if keep == "none" else (lambda p: ~is_first(p))
    runs = F.coalesce("runs", F.array().cast("array<long>"))
    own = F.flatten(F.transform("places", lambda p: F.when(every(p), F.array(p, p + F.col("windows"))).otherwise(F.transform(runs, lambda x: x + p))))
    starts = where.select("k", "t", own.alias("own")).where("size(own) > 0")
    starts = starts.groupBy("k", "t").agg(F.flatten(F.collect_list("own")).alias("starts"))
    starts = scratch.keep(_merged(starts), "starts")
    scratch.drop("regions", "hot", "where", "matched", "matched-hot")
    return starts


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = "first", hot: int = HOT_REGIONS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the bytes left) of every row.

    A byte goes if a string of ``window`` bytes covers it that also starts anywhere else; texts are
    judged as given, as UTF-8. ``keep="first"`` spares the first place of every string, by doc_id and
    position (rows alike in id and text are one document); ``keep="none"`` spares none. Null and empty
    texts have no bytes; a null doc_id is allowed; other columns are not read.
    """
    starts = _found(Scratch(spark, "suffix"), docs, window, gram, keep, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*_left(batch.column(1), batch.column(2), window))) or [[]] * 4
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    marked = keyed(docs).join(starts.hint("merge"), ["k", "t"], "left").select("doc_id", "text", "starts")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def trimmed(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: str = "first", hot: int = HOT_REGIONS) -> DataFrame:
    """Whole rows of ``docs`` with ``text`` cut as by ``remove_repeats``; ``n_chars`` follows it where there is one.

    Characters that a cut splits go. A null text stays null. Documents stay even if no text is left.
    """
    starts = _found(Scratch(spark, "suffix"), docs, window, gram, keep, hot)
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            cols = [row.field(i) for i in range(len(names))]
            left = [x[3].decode("utf-8", "ignore") for x in _left(cols[at], batch.column(1), window)]
            null = cols[at].is_null().to_pylist()
            texts = [None if no else t for t, no in zip(left, null)]
            cols[at] = pa.array(texts, cols[at].type)
            if length is not None:
                cols[length] = pa.array([None if t is None else len(t) for t in texts], cols[length].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-1)).alias("k"), F.xxhash64("row.text").alias("t"))
    return rows.join(starts.hint("merge"), ["k", "t"], "left").select("row", "starts").mapInArrow(run, schema)


def digest_rows(cut: DataFrame, text: bool = False) -> DataFrame:
    """The kept bytes as a digest, and with ``text`` as text too; a character that a cut splits is U+FFFD there."""
    out = cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))
    return out if text else out.drop("text")

"""Removal of repeated word windows through a fingerprint index (operator 3).

Every 35-word window selects the 12-word window of the smallest hash in it, its anchor; equal windows
select equal ones at equal places. The anchors, about one for every twelve words, go through the
log-structured index batch by batch; its merge joins name the documents and anchors that meet, and only
these go on. Windows in a row with one anchor form a region. Regions are verified by a BLAKE2 digest of
their words: equal ones are counted and one stands for all, and the windows of those are verified by
digests of their own. The index may be kept, so that later batches are held against it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fingerprints import FingerprintIndex
from .scratch import Scratch
from .textkernel import Words, blocks, join, least_places, mix, windows

WINDOW = 35
GRAM = 12
BATCHES = 4


def selected(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside a text, the selected place of each, and the hashes at all places."""
    values = windows(hashes, gram)
    at = least_places(values, window - gram + 1)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(at)]
    start = np.flatnonzero(np.arange(len(at)) + window <= first[1:][owner])
    return start, at[start], values


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key that joins need: the id and a hash of the text (rows alike in both are alike in all)."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.xxhash64("text").alias("t"), "doc_id", "text")


def spans(column: pa.Array) -> list[np.ndarray]:
    """Members of each list, none for null."""
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def anchors(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors of every text, each hash once with how often it is selected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, texts in blocks(batch.column(2)):
                words = Words(texts)
                _, at, values = selected(words.hashes(), words.first, window, gram)
                own = np.unique(at)
                row, hashes = np.searchsorted(words.first, own, "right") - 1, values[own]
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                head = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else row)
                count = np.diff(head, append=len(row))
                take = pa.array(a + row[head])
                yield pa.RecordBatch.from_arrays([pa.array(hashes[head].view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(count.astype(np.int64))], ["hash", "k", "t", "n"])

    return rows.select("k", "t", "text").mapInArrow(run, "hash long, k long, t long, n long")


def _digests(words: Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2 of the words from ``lo`` to before ``hi``, joined by one blank, as two numbers."""
    data, edge = words.joined()
    own = (hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(edge[lo].tolist(), edge[hi].tolist()))
    return np.frombuffer(b"".join(own), np.int64).reshape(-1, 2)


def _regions(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """Regions of each text that select one of its ``hashes``: digest, windows in it, and all its places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, edges = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for a, b, texts in blocks(batch.column(2)):
                words = Words(texts)
                start, at, values = selected(words.hashes(), words.first, window, gram)
                head = np.flatnonzero(np.diff(at, prepend=-1))
                tail = np.append(head[1:], len(at)) - 1
                row = np.searchsorted(words.first, start[head], "right") - 1
                wanted = flat[edges[a] : edges[b]].view(np.uint64)
                owner = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
                # a hash of another text that meets one of these only makes a region that no digest confirms
                own = np.isin(join(mix(row.astype(np.uint64)), values[at[head]]), join(mix(owner.astype(np.uint64)), wanted))
                row, lo, hi = row[own], start[head[own]], start[tail[own]]
                digest = _digests(words, lo, hi + window)
                order = np.lexsort((lo, digest[:, 1], digest[:, 0], row))
                row, lo, hi, digest = row[order], lo[order], hi[order], digest[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]).any(1)
                first = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array((lo - words.first[row]).astype(np.int32)))
                take = pa.array(a + row[first])
                cols = [batch.column(0).take(take), batch.column(1).take(take), *(pa.array(digest[first, i]) for i in (0, 1)), pa.array((hi - lo)[first].astype(np.int32) + 1), places]
                yield pa.RecordBatch.from_arrays(cols, ["k", "t", "r1", "r2", "size", "places"])

    return marked.select("k", "t", "text", "hashes").mapInArrow(run, "k long, t long, r1 long, r2 long, size int, places array<int>")


def _windows(marked: DataFrame, window: int) -> DataFrame:
    """Digests of all windows of the regions in ``own`` (place, size, n, how often the region occurs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, edges = batch.column(3).values, batch.column(3).offsets.to_numpy()
            place, size, n = (fields.field(c).to_numpy() for c in ("place", "size", "n"))
            for a, b, texts in blocks(batch.column(2)):
                words = Words(texts)
                own = np.arange(edges[a], edges[b])
                owner = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
                times = size[own]
                row, first = np.repeat(owner, times), np.cumsum(times) - times
                at = np.repeat(place[own], times) + np.arange(int(times.sum())) - np.repeat(first, times)
                lo = words.first[row] + at
                digest = _digests(words, lo, lo + window)
                take = pa.array(a + row)
                cols = [batch.column(0).take(take), batch.column(1).take(take), pa.array(at.astype(np.int32)), pa.array(np.repeat(n[own], times)), *(pa.array(digest[:, i]) for i in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "t", "at", "n", "one", "two"])

    return marked.select("k", "t", "text", "own").mapInArrow(run, "k long, t long, at int, n long, one long, two long")


def _cut(marked: DataFrame, window: int) -> DataFrame:
    """Each text without the words that its repeated windows cover; ``runs`` has their first starts and how many follow in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, edges = batch.column(2).values, batch.column(2).offsets.to_numpy()
            place, size = (fields.field(c).to_numpy() for c in ("place", "size"))
            n, gone, kept = [], [], []
            for a, b, texts in blocks(batch.column(1)):
                words = Words(texts)
                data, at = words.joined()
                for i in range(b - a):
                    lo, hi = words.first[i], words.first[i + 1]
                    edge = np.zeros(hi - lo + 1, np.int64)
                    own = slice(edges[a + i], edges[a + i + 1])
                    np.add.at(edge, place[own], 1)
                    np.add.at(edge, place[own] + size[own] + window - 1, -1)
                    out = np.cumsum(edge)[:-1] > 0
                    n.append(int(hi - lo))
                    gone.append(int(out.sum()))
                    if gone[-1]:
                        stay = np.flatnonzero(~out) + lo
                        kept.append(b" ".join([data[x : y - 1] for x, y in zip(at[stay].tolist(), at[stay + 1].tolist())]))
                    else:
                        kept.append(data[at[lo] : max(at[hi] - 1, at[lo])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _verified(scratch: Scratch, rows: DataFrame, candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """Runs of repeated windows of each text: k, t and a list of (place, size)."""
    hashes = candidates.groupBy("k", "t").agg(F.collect_set("hash").alias("hashes"))
    regions = scratch.keep(_regions(rows.join(hashes, ["k", "t"]), window, gram), "regions")
    first = F.min(F.struct("k", "t", F.col("places")[0].alias("place"))).alias("first")
    classes = scratch.keep(regions.groupBy("r1", "r2").agg(F.sum(F.size("places")).alias("n"), F.max("size").alias("size"), first), "classes")
    # a region that occurs again: all its windows are repeated, wherever it is
    again = scratch.keep(classes.where("n > 1").select("r1", "r2"), "again")
    whole = regions.join(again, ["r1", "r2"], "left_semi").select("k", "t", F.explode("places").alias("place"), "size")
    # its windows, and those of the others, may also stand in different regions
    one = classes.select("first.k", "first.t", F.struct("first.place", "size", "n").alias("own")).groupBy("k", "t").agg(F.collect_list("own").alias("own"))
    # rows alike in id and text are one text here
    texts = rows.join(one, ["k", "t"]).dropDuplicates(["k", "t"])
    singles = scratch.keep(_windows(texts, window), "windows")
    twice = scratch.keep(singles.groupBy("one", "two").agg(F.sum("n").alias("n")).where("n > 1").select("one", "two"), "twice")
    part = singles.where("n = 1").join(twice, ["one", "two"], "left_semi").select("k", "t", F.col("at").alias("place"), F.lit(1).alias("size"))
    runs = whole.unionByName(part).groupBy("k", "t").agg(F.collect_list(F.struct("place", "size")).alias("runs"))
    runs = scratch.keep(runs, "runs")
    scratch.drop("regions", "classes", "again", "windows", "twice")
    return runs


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one blank) of every row.

    A word goes if a window of ``window`` words covers it whose words also start anywhere else, in the
    same text included; windows are judged on the input. Null and empty texts have no words; repeated
    rows repeat each other's windows. A null doc_id is allowed; other columns are not read.
    """
    scratch = Scratch(spark, "substring")
    rows = keyed(docs)
    with FingerprintIndex(spark, scratch) as index:
        for i in range(batches):
            found = index.add(anchors(rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(batches)) == i), window, gram))
            hits = found if i == 0 else hits.unionByName(found)
    runs = _verified(scratch, rows, hits, window, gram)
    return _cut(rows.join(runs, ["k", "t"], "left"), window)


def remove_known(spark: SparkSession, index: FingerprintIndex, batch: DataFrame, history: DataFrame | None = None, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Add ``batch`` to ``index`` and return its rows as ``remove_repeats`` does, judged against themselves and ``history``.

    ``history`` are the documents added before (all of them, as they were); its rows are read only to
    verify what meets the batch, and are not returned. A batch seen before is repeated as a whole.
    """
    scratch = Scratch(spark, "substring-batch")
    own = keyed(batch)
    rows = own if history is None else own.unionByName(keyed(history))
    runs = _verified(scratch, rows, index.add(anchors(own, window, gram)), window, gram)
    return _cut(own.join(runs, ["k", "t"], "left"), window)


def digest_rows(cut: DataFrame) -> DataFrame:
    """The kept words as a digest."""
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

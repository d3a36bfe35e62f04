"""Near-duplicate groups by MinHash with sequential Bayesian verification (operator 1).

Signatures are cut into bands; texts that agree on a band are candidates. The signatures of a
candidate pair are compared a batch of hashes at a time, and the pair is dropped once the posterior
probability that its similarity reaches the threshold falls below ``POSTERIOR_MISS``. Survivors are checked on
their full shingle sets.

Texts with equal sets are one node. Within a bucket, members are first tried against the one that
shares buckets with the most others (the original among its copies), and linked nodes form components.
Then the members of a bucket that lie in different components are compared, block against block inside
a task: first by signature, which leaves the members with a plausible partner, then these on their full
sets. A task returns only links that join what its links so far have not, fewer than it has members. So
no link between components is missed, and the rows of every step grow with the members of a group, not
with its pairs; a bucket's largest component is not compared with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch
from .textkernel import Texts, Words, blocks, mix, windows

WORDS = 5
ROWS = 5
#: Hashes of a signature; bands take the first ones.
HASHES = 256
#: Probability that bands lose a pair at the threshold, and that posterior bounds do.
MISS = 1e-6
POSTERIOR_MISS = 1e-5
STEP = 16
#: Members of a bucket compared with others at once, and shingles of all of them, about, where sets are compared.
BLOCK = 256
SHINGLES = 1 << 18


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands that lose a pair of this similarity with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**ROWS))


def least_matches(similarity: float, hashes: int, miss: float = POSTERIOR_MISS) -> dict[int, int]:
    """Matches needed after each batch: fewer make P(similarity >= threshold | matches) less than ``miss`` (uniform prior)."""
    out = {}
    for n in [*range(STEP, hashes, STEP), hashes]:
        total, m = 0.0, -1
        while m < n:
            total += math.comb(n + 1, m + 1) * similarity ** (m + 1) * (1 - similarity) ** (n - m)
            if total >= miss:
                break
            m += 1
        out[n] = m + 1
    return out


def _shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in turn, not yet distinct, and where each text's begin."""
    words = Words(texts.lowered())
    hashes, per = words.hashes(), words.per_text()
    count = np.where(per >= size, per - size + 1, np.minimum(per, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]), np.uint64)
    wide = windows(hashes, size)
    full = np.repeat(per >= size, count)
    at = np.repeat(words.first[:-1], count) + np.arange(len(out)) - np.repeat(first[:-1], count)
    out[full] = wide[at[full]]
    for i in np.flatnonzero((per > 0) & (per < size)):
        own = hashes[words.first[i] : words.first[i + 1]]
        out[first[i]] = windows(own, len(own))[0] + np.uint64(len(own))
    return out, first


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1), mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64))


def _signed(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """Set size, 128-bit set key, bands and truncated signature of every text."""
    n = max(HASHES, bands * ROWS)
    times, plus = _coefficients(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch.column(1)):
                shingles, first = _shingles(texts, size)
                sizes = np.zeros(b - a, np.int64)
                keys = np.zeros((2, b - a), np.uint64)
                for i in range(b - a):
                    own = np.unique(shingles[first[i] : first[i + 1]])
                    sizes[i] = len(own)
                    keys[0, i], keys[1, i] = mix(own).sum(), mix(own + np.uint64(0x632BE59BD9B4E019)).sum()
                some = np.flatnonzero(np.diff(first) > 0)
                least = np.zeros((b - a, n), np.uint64)
                for k in range(n if len(some) else 0):
                    least[some, k] = np.minimum.reduceat(mix32(shingles * times[k] + plus[k]), first[:-1][some])
                held = windows_of(least[:, : bands * ROWS], bands)
                short = (least & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(sizes),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(held.ravel().view(np.int64))),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "signature"],
                )

    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, signature binary"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def mix32(x: np.ndarray) -> np.ndarray:
    """High and low halves folded, so that the low bits are as random as the high ones."""
    return x ^ (x >> np.uint64(32))


def windows_of(least: np.ndarray, bands: int) -> np.ndarray:
    """Bucket keys: a hash of each band's minima and its place."""
    cut = least.reshape(len(least), bands, ROWS)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), cut.shape[:2]).copy()
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i])
    return out


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Full sets as sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in blocks(batch.column(1)):
                shingles, first = _shingles(texts, size)
                own = [np.unique(shingles[first[i] : first[i + 1]]).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def _plausible(pairs: DataFrame, need: dict[int, int], part: int, whole: int) -> DataFrame:
    """Pairs that neither their sizes nor a batch of their signatures rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            m, n = (batch.column(i).to_numpy() for i in (4, 5))
            alive, done = np.flatnonzero(whole * np.minimum(m, n) >= part * np.maximum(m, n)), 0
            matches = np.zeros(len(alive), np.int64)
            for n, m in need.items():
                matches = matches + (left[alive, done:n] == right[alive, done:n]).sum(1)
                alive, matches, done = alive[matches >= m], matches[matches >= m], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a long, b long")


class Rule(NamedTuple):
    """When texts are near, the matches each batch of a signature needs, and how many bands it has."""

    part: int
    whole: int
    need: dict[int, int]
    bands: int


def _cells(entries: DataFrame, *columns: str) -> DataFrame:
    """Lists of the members of each two blocks of a bucket that hold different components (``i`` is the first block).

    Blocks of the largest component come after the others and meet only these. Blocks with full sets are
    smaller where texts are long, so that a list has a bounded size but for single texts.
    """
    sizes = entries.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "w")).alias("main"), F.sum("n").alias("all"), F.sum("w").alias("all_w"))
    blocks_of = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / SHINGLES) if "shingles" in columns else n / BLOCK)
    small = blocks_of(F.col("all") - F.col("main.n"), F.col("all_w") - F.col("main.w"))
    sizes = sizes.select("bucket", F.col("main.component").alias("main"), small.alias("small"), blocks_of(F.col("main.n"), F.col("main.w")).alias("large"))
    own = entries.join(sizes, "bucket").withColumn("apart", F.col("component") != F.col("main"))
    block = F.when(F.col("apart"), F.pmod(F.xxhash64("id"), "small")).otherwise(F.col("small") + F.pmod(F.xxhash64("id"), "large"))
    last = F.when(F.col("apart"), F.col("small") + F.col("large")).otherwise(F.col("small")) - 1
    rows = own.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.select("bucket", "place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.struct("block", "id", "component", *columns).alias("m"))
    return rows.groupBy("bucket", "place", "i", "j").agg(F.collect_list("m").alias("own")).select("bucket", "i", "own", "place")


def _sides(block: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    low = block == i
    left = np.flatnonzero(low)
    return left, left if low.all() else np.flatnonzero(~low)


def _likely(held: np.ndarray, n: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, place: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that neither their sizes nor a batch of their signatures rule out, if ``place`` is the first band they share."""
    x, y = np.meshgrid(left, right, indexing="ij")
    go = component[x] < component[y] if right is left else component[x] != component[y]
    go &= rule.whole * np.minimum(n[x], n[y]) >= rule.part * np.maximum(n[x], n[y])
    x, y = x[go], y[go]
    done, matches = 0, np.zeros(len(x), np.int64)
    for size, least in rule.need.items():
        matches = matches + (held[x, done:size] == held[y, done:size]).sum(1)
        x, y, matches, done = x[matches >= least], y[matches >= least], matches[matches >= least], size
    agree = held[x, : rule.bands * ROWS] == held[y, : rule.bands * ROWS]
    first = agree.reshape(len(x), rule.bands, ROWS).all(2).argmax(1) == place
    return x[first], y[first]


def _partnered(cells: DataFrame, rule: Rule) -> DataFrame:
    """Members of a bucket with a plausible partner in another component: bucket, id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, found = [], []
            fields, edges = batch.column(2).values, batch.column(2).offsets.to_pylist()
            block, ids, component, n = (fields.field(c).to_numpy() for c in ("block", "id", "component", "n_shingles"))
            for bucket, i, place, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), edges, edges[1:]):
                held = np.frombuffer(b"".join(fields.field("signature").slice(a, b - a).to_pylist()), "<u2").reshape(b - a, -1)
                own = np.unique(np.concatenate(_likely(held, n[a:b], component[a:b], *_sides(block[a:b], i), place, rule)))
                buckets += [bucket] * len(own)
                found.append(ids[a + own])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(np.concatenate(found))], ["bucket", "id"])

    return cells.mapInArrow(run, "bucket long, id long").distinct()


def _joining(cells: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links of each cell that join components its earlier ones don't: fewer than its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            fields, edges = batch.column(2).values, batch.column(2).offsets.to_pylist()
            block, ids, component, n = (fields.field(c).to_numpy() for c in ("block", "id", "component", "n_shingles"))
            shingles = fields.field("shingles")
            for i, place, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 3)), edges, edges[1:]):
                held = np.frombuffer(b"".join(fields.field("signature").slice(a, b - a).to_pylist()), "<u2").reshape(b - a, -1)
                x, y = _likely(held, n[a:b], component[a:b], *_sides(block[a:b], i), place, rule)
                parent = {c: c for c in component[a:b].tolist()}

                def root(c: int, parent: dict[int, int] = parent) -> int:
                    while parent[c] != c:
                        parent[c] = c = parent[parent[c]]
                    return c

                sets: dict[int, np.ndarray] = {}
                for p, q in zip((a + x).tolist(), (a + y).tolist()):
                    one, two = root(int(component[p])), root(int(component[q]))
                    if one == two:
                        continue
                    for m in (p, q):
                        if m not in sets:
                            sets[m] = np.frombuffer(shingles[m].as_buffer(), "<u8")
                    if _near(sets[p], sets[q], rule.part, rule.whole):
                        parent[max(one, two)] = min(one, two)
                        found.append((int(min(ids[p], ids[q])), int(max(ids[p], ids[q]))))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long")


def _near(a: np.ndarray, b: np.ndarray, part: int, whole: int) -> bool:
    """whole * intersection >= part * union of two sorted sets."""
    if not len(a) or not len(b):
        return False
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return whole * common >= part * (len(a) + len(b) - common)


def _linked(pairs: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs whose full sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ((np.frombuffer(v.as_buffer(), "<u8") for v in pair) for pair in zip(batch.column(2), batch.column(3)))
            good = [i for i, (a, b) in enumerate(sets) if _near(a, b, part, whole)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return pairs.mapInArrow(run, "a long, b long")


def groups(spark: SparkSession, docs: DataFrame, part: int = 80, whole: int = 100, size: int = WORDS) -> DataFrame:
    """Near-duplicate groups of ``docs`` (``doc_id``, ``text``): doc_id, n_shingles, component_id, kept.

    Texts are linked when ``whole * intersection >= part * union`` of their distinct ``size``-word
    shingles (A-Z lower-cased); a text with fewer words is one shingle. Null and empty texts have no
    set and are linked with nothing. Rows with one doc_id are one document, linked by any of its
    texts. Rows with a null doc_id are returned with their set size, unlinked and kept. Columns other
    than doc_id and text are not read. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "minhash")
    bands = bands_for(part / whole)
    rule = Rule(part, whole, least_matches(part / whole, max(HASHES, bands * ROWS)), bands)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    base = scratch.keep(_signed(texts, size, bands), "base")
    nodes = base.where("doc_id is not null and n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"))
    nodes = scratch.keep(nodes, "nodes")
    # both sides of these joins grow with the texts, so they are merged at every size
    own = base.withColumnRenamed("doc_id", "node").join(nodes.hint("merge"), ["k1", "k2", "node"])
    signed = scratch.keep(own.select(F.col("node").alias("id"), "n_shingles", "signature", "bands"), "signed")
    entries = signed.select("id", F.posexplode("bands").alias("place", "bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("others")).where("low < high")
    shared = scratch.keep(shared.select("bucket", "others"), "shared")
    entries = scratch.keep(entries.join(shared.hint("merge"), "bucket"), "entries")
    scratch.drop("shared")
    known = scratch.keep(entries.groupBy("id").agg(F.sum("others").alias("met")), "known")
    wanted = known.select(F.col("id").alias("doc_id"))
    sets = scratch.keep(_sets(texts.join(wanted.hint("merge"), "doc_id"), size), "sets")
    signatures = signed.select("id", "signature", "n_shingles")
    again = base.join(nodes, ["k1", "k2"]).select("doc_id", "node")
    several = again.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    links = scratch.keep(several.select("a", F.col("z").alias("b")), "same")
    if not links.isEmpty():
        links = scratch.keep(again.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")), "same-all")
    popular = F.struct(F.col("met"), (-F.col("id")).alias("first"))
    centres = entries.join(known.select("id", "met"), "id").groupBy("bucket").agg(F.max(popular).alias("centre"))
    pairs = entries.join(centres, "bucket").groupBy("id").agg((-F.max("centre")["first"]).alias("a")).where("a <> id")
    pairs = pairs.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    both = pairs.join(signatures.toDF("a", "x", "m"), "a").join(signatures.toDF("b", "y", "n"), "b").select("a", "b", "x", "y", "m", "n")
    pairs = scratch.keep(_plausible(both, rule.need, part, whole), "pairs")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = links.unionByName(scratch.keep(_linked(both, part, whole), "centres"))
    found = connected(scratch, links, "round")
    placed = entries.select("bucket", "place", "id").join(found.toDF("id", "component"), "id", "left")
    placed = scratch.keep(placed.select("bucket", "place", "id", F.coalesce("component", "id").alias("component")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    inside = placed.join(scratch.keep(mixed, "mixed"), "bucket").join(signatures, "id")
    partnered = scratch.keep(_partnered(_cells(inside, "n_shingles", "signature"), rule), "partnered")
    again = placed.join(partnered, ["bucket", "id"]).join(signatures, "id").join(sets, "id")
    joining = _joining(_cells(again, "n_shingles", "signature", "shingles"), rule)
    links = links.unionByName(scratch.keep(joining.distinct(), "joining"))
    scratch.drop("signed", "entries", "known", "sets", "pairs", "placed", "mixed", "partnered")
    found = connected(scratch, links, "last")
    scratch.drop("centres", "joining")
    out = base.select("doc_id", "n_shingles", "k1", "k2").join(nodes, ["k1", "k2"], "left")
    out = out.withColumn("node", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("node")))
    out = out.join(found, "node", "left").withColumn("component_id", F.coalesce("component", "node", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

"""Approximate nearest neighbours by learned partitions (operator 11).

A bounded sample of the vectors gives a neighbour graph, which is cut into balanced parts by bisections
that follow its slowest vibration and are mended by swaps. A small network learns, for each vector of
the sample, in which parts its neighbours are. Every vector is filed under its most probable part, and
every query is sent to its most probable parts, in which all vectors are compared. How many parts that
are is settled by an audit: some vectors are compared with all others, and the fewest parts are taken
that hold the wanted share of what they should find.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

NEAREST = 20
#: Vectors that the graph and the network are fitted on, about; neighbours of each in the graph.
SAMPLE = 8192
DEGREE = 16
#: Parts are twice as many as long as they have PART_ROWS rows, between these numbers.
PART_ROWS = 4096
PARTS = (16, 256)
HIDDEN = 96
EPOCHS = 24
#: Vectors that are compared with all rows, about, and the share of their neighbours that the parts must hold.
AUDITED = 256
RECALL = 0.97
#: Rows of a block of a part, and queries of a block.
BLOCK = 4096
ASKED = 512
#: Vectors of the sample that give each query a score to beat.
BEATEN = 2048
_PAIRS = 1 << 16

_ROW = "id long, size int, part int, v binary"


@dataclass
class Router:
    """A network with one hidden layer from a vector to probabilities of parts."""

    size: int
    parts: int
    scale: float
    weights: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x / self.scale @ a + b, 0) @ c + d

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts, the most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")


def neighbour_graph(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector and its ``degree`` others of largest inner product, as two columns."""
    degree = min(degree, len(x) - 1)
    found = np.empty((len(x), degree), np.int64)
    for a in range(0, len(x), 1024):
        products = x[a : a + 1024] @ x.T
        products[np.arange(len(products)), a + np.arange(len(products))] = -np.inf
        found[a : a + 1024] = np.argpartition(-products, degree - 1, axis=1)[:, :degree]
    return np.repeat(np.arange(len(x)), degree), found.ravel()


def balanced_parts(ends: tuple[np.ndarray, np.ndarray], n: int, bits: int, seed: int = 7, steps: int = 40, swaps: int = 8) -> np.ndarray:
    """A part for each of ``n`` nodes, 2 ** bits parts of equal size (to one node), few edges between them."""
    a, b = np.concatenate(ends), np.concatenate(ends[::-1])
    part = np.zeros(n, np.int64)
    random = np.random.default_rng(seed)
    for bit in range(bits):
        inside = part[a] == part[b]
        a, b = a[inside], b[inside]
        parts = 1 << bit
        degree = np.bincount(a, minlength=n) + 1e-6
        mass = np.bincount(part, degree, parts)
        x = random.normal(size=n)
        for _ in range(steps):
            x = (x + np.bincount(a, x[b], n) / degree) / 2
            x -= (np.bincount(part, x * degree, parts) / mass)[part]
            x /= np.sqrt(np.bincount(part, x * x, parts) + 1e-300)[part]
        order = np.lexsort((x, part))
        sizes = np.bincount(part, minlength=parts)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        side = rank >= (sizes // 2)[part]
        share = 4
        for _ in range(swaps):
            # what each node gains by changing sides; the same number of both sides go, the best first
            gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
            order = np.lexsort((-gain, side, part))
            group = (2 * part + side)[order]
            counts = np.bincount(group, minlength=2 * parts)
            place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
            willing = np.bincount(group, gain[order] > 0, 2 * parts).astype(np.int64).reshape(-1, 2).min(1) // share
            moved = order[place < np.repeat(willing, 2)[group]]
            before = (side[a] != side[b]).sum()
            side[moved] = ~side[moved]
            if (side[a] != side[b]).sum() > before:
                side[moved] = ~side[moved]
                share *= 2
        part = 2 * part + side
    return part


def trained(x: np.ndarray, parts: int, seed: int = 5) -> Router:
    """A router for ``parts`` parts (a power of two), fitted on the rows of ``x``."""
    n, size = x.shape
    ends = neighbour_graph(x, DEGREE)
    part = balanced_parts(ends, n, parts.bit_length() - 1)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (ends[0], part[ends[1]]), 1.0)
    wanted[np.arange(n), part] += 1
    wanted /= wanted.sum(1)[:, None]
    random = np.random.default_rng(seed)
    net = Router(size, parts, float(np.sqrt((x * x).mean())) or 1.0, (random.normal(size=(size, HIDDEN)) * np.sqrt(2 / size), np.zeros(HIDDEN), random.normal(size=(HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)))
    first, second = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(random.permutation(n), max(1, n // 256)):
            a, b, c, d = net.weights
            own = x[rows] / net.scale
            hidden = np.maximum(own @ a + b, 0)
            logits = hidden @ c + d
            p = np.exp(logits - logits.max(1)[:, None])
            error = (p / p.sum(1)[:, None] - wanted[rows]) / len(rows)
            back = (error @ c.T) * (hidden > 0)
            step += 1
            for w, g, m, s in zip(net.weights, (own.T @ back, back.sum(0), hidden.T @ error, error.sum(0)), first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that take part, as bytes of their own precision."""
    for batch in batches:
        column = batch.column(1)
        width = "<f4" if pa.types.is_float32(column.type.value_type) else "<f8"
        ids, sizes, held = [], [], []
        for i, v in zip(batch.column(0).to_pylist(), column):
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            own = v.values.to_numpy().astype(width)
            if np.isfinite(own).all() and own.any():
                ids.append(i)
                sizes.append(len(own))
                held.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], ["id", "size", "v"])


def _matrix(held: list[bytes], size: int) -> np.ndarray:
    """Rows in double precision."""
    return np.frombuffer(b"".join(held), "<f4" if held and len(held[0]) == 4 * size else "<f8").reshape(-1, size).astype(np.float64)


def _filed(net: Router | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every vector with its most probable part; those of other lengths are one part of their own."""
    for batch in batches:
        part = np.zeros(batch.num_rows, np.int32)
        own = np.flatnonzero(batch.column(1).to_numpy() == net.size) if net else []
        if len(own):
            part[own] = net.scores(_matrix(batch.column(2).take(pa.array(own)).to_pylist(), net.size)).argmax(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part), batch.column(2)], ["id", "size", "part", "v"])


def _routed(net: Router | None, probes: int, beaten: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query once for each part that it is sent to, with a score that its neighbours reach at least."""
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        own = np.flatnonzero(sizes == net.size) if net else np.zeros(0, np.int64)
        rest = np.setdiff1d(np.arange(batch.num_rows), own)
        parts, least = np.zeros((len(own), probes), np.int32), np.full(batch.num_rows, -np.inf)
        if len(own):
            x = _matrix(batch.column(2).take(pa.array(own)).to_pylist(), net.size)
            parts = net.order(x)[:, :probes].astype(np.int32)
            if len(beaten) > NEAREST:
                # of the sample's vectors in these parts; one more than wanted, for the query may be one of them
                products = x @ beaten.T
                slack = 1e-9 * np.abs(products).max(1)
                asked = np.zeros((len(own), net.parts), bool)
                asked[np.arange(len(own))[:, None], parts] = True
                products[~asked[:, net.scores(beaten).argmax(1)]] = -np.inf
                least[own] = np.partition(products, -NEAREST - 1, axis=1)[:, -NEAREST - 1] - slack
        at = np.concatenate([np.repeat(own, probes), rest])
        part = np.concatenate([parts.ravel(), np.zeros(len(rest), np.int32)])
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in (0, 1)), pa.array(part), batch.column(2).take(pa.array(at)), pa.array(least[at])], ["id", "size", "part", "v", "least"])


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last, whatever stands beside them."""
    total = q[:, 0] * x[:, 0]
    for k in range(1, q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def best(names: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, row's place and score of the NEAREST rows of each query, its own left out. Ties go to the smaller id."""
    products = q @ x.T
    products[names[:, None] == ids] = -np.inf
    slack = 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max())
    bound = np.full(len(q), -np.inf) if least is None else least
    if len(x) > NEAREST:
        bound = np.maximum(bound, np.partition(products, -NEAREST, axis=1)[:, -NEAREST])
    i, j = np.nonzero((products >= (bound - slack)[:, None]) & (products > -np.inf))
    score = np.concatenate([np.zeros(0), *(_product(q[i[a : a + _PAIRS]], x[j[a : a + _PAIRS]]) for a in range(0, len(i), _PAIRS))])
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - first[i] < NEAREST
    return i[keep], j[keep], score[keep]


def _audit(names: np.ndarray, q: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best of a task's rows for each audited vector."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))
    for batch in batches:
        own = np.flatnonzero(batch.column(1).to_numpy() == q.shape[1])
        if not len(own):
            continue
        at = pa.array(own)
        ids, part = batch.column(0).take(at).to_numpy(), batch.column(2).take(at).to_numpy()
        i, j, score = best(names, q, ids, _matrix(batch.column(3).take(at).to_pylist(), q.shape[1]))
        asked, found, scores, parts = (np.concatenate(c) for c in zip(held, (i, ids[j], score, part[j])))
        order = np.lexsort((found, -scores, asked))
        asked, found, scores, parts = asked[order], found[order], scores[order], parts[order]
        keep = np.arange(len(asked)) - np.searchsorted(asked, asked) < NEAREST
        held = (asked[keep], found[keep], scores[keep], parts[keep])
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["asked", "id", "score", "part"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best rows of a block for each query of a block."""
    for batch in batches:
        for row in range(batch.num_rows):
            size = batch.column(0)[row].as_py()
            asked, held = batch.column(1)[row].values, batch.column(2)[row].values
            names, ids = asked.field("id").to_numpy(), held.field("id").to_numpy()
            i, j, score = best(names, _matrix(asked.field("v").to_pylist(), size), ids, _matrix(held.field("v").to_pylist(), size), asked.field("least").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])


def _some(rows: DataFrame, n: int, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` of ``n`` rows, never above twice as many."""
    picked = F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(1 << 40)) < int(min(1.0, wanted / max(n, 1)) * (1 << 40))
    return rows.where(picked).limit(2 * wanted)


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), F.col("id" if "id" in rows.columns else "vec_id")))
    return rows.withColumn("rank", rank).where(f"rank <= {NEAREST}")


def search(spark: SparkSession, vectors: DataFrame, every: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the NEAREST rows found for each row of ``vectors`` whose vec_id is divisible by ``every``.

    ``vectors`` has ``vec_id`` and ``embedding``. Nearness is the inner product in double precision, ties go to
    the smaller vec_id. Rows whose id or vector is null, and vectors that are empty, zero or hold null or
    non-finite components take no part. Vectors are compared with those of their own length only; those of
    the most frequent length go through the learned parts, others are compared as a whole. Rows that share a
    vec_id are each a candidate, but none for a query of that id, and one of them is the query. Other
    columns are not read; an empty table gives an empty result. ``audited_recall`` is the share of
    neighbours that the parts of the audited vectors hold (1 if all parts are looked through).
    """
    scratch = Scratch(spark, "partitions")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    valid = scratch.keep(rows.mapInArrow(_valid, "id long, size int, v binary"), "valid")
    main = valid.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    size, n = main[0] if main else (0, 0)
    own = valid.where(F.col("size") == size)
    sample = _matrix([r["v"] for r in _some(own, n, SAMPLE, 1).select("v").collect()], size) if n else np.zeros((0, 0))
    parts = 1 << int(np.clip(np.log2(max(n, 1) / PART_ROWS), *np.log2(PARTS)))
    net = trained(sample, parts) if len(sample) >= 4 * parts else None
    filed = scratch.keep(valid.mapInArrow(partial(_filed, net), _ROW), "filed")
    scratch.drop("valid")
    probes, recall = (net.parts if net else 1), 1.0
    audited = _some(filed.where(F.col("size") == size), n, AUDITED, 2).select("id", "v").collect() if net else []
    if audited:
        names, q = np.array([r["id"] for r in audited]), _matrix([r["v"] for r in audited], size)
        truth = filed.mapInArrow(partial(_audit, names, q), "asked long, id long, score double, part int")
        truth = _ranked(truth, "asked").groupBy("asked", "part").agg(F.count("*").alias("n")).collect()  # of the audited vectors only
        place = np.argsort(net.order(q), axis=1)
        asked, part, count = (np.array([r[c] for r in truth]) for c in ("asked", "part", "n"))
        total = np.bincount(asked, count, len(q))[asked]
        held = np.cumsum(np.bincount(place[asked, part], count / total, net.parts)) / len(np.unique(asked))
        probes = int(min(np.searchsorted(held, RECALL), net.parts - 1)) + 1
        recall = float(min(held[probes - 1], 1.0))
    asked = filed.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("size", "v")).alias("q")).select("id", "q.size", "q.v")
    asked = scratch.keep(asked.mapInArrow(partial(_routed, net, probes, sample[:BEATEN]), _ROW + ", least double"), "asked")
    key = ["size", "part"]
    counts = scratch.keep(filed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "counts")
    lists = filed.join(counts, key).withColumn("block", F.pmod(F.xxhash64("id", "v"), "blocks"))
    lists = lists.groupBy(*key, "block").agg(F.collect_list(F.struct("id", "v")).alias("own"))
    groups = asked.groupBy(*key).agg(F.ceil(F.count("*") / ASKED).alias("groups")).join(counts, key)
    queries = asked.join(groups, key).withColumn("group", F.pmod(F.xxhash64("id"), "groups"))
    queries = queries.groupBy(*key, "group", "blocks").agg(F.collect_list(F.struct("id", "v", "least")).alias("asked"))
    # every block of queries meets every block of its part, wherever that is
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(*key, "block", "asked")
    found = queries.join(lists, [*key, "block"]).select("size", "asked", "own").mapInArrow(_compared, "query_id long, vec_id long, score double")
    return _ranked(found, "query_id").select("query_id", "rank", "vec_id", "score", F.lit(recall).alias("audited_recall"))

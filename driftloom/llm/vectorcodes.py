"""Vector codes: product quantisation in integers by dual-tree Lloyd (operator 13).

Vectors are written once as blocks of integers. For every part of a block there is a tree over its
points, kept as an order of the points, and for every codebook a tree over its entries. Pairs of a
point node and an entry node are followed from both roots; integer bounds on their distance prune
pairs, a point node with one entry left adds its cached count and sum as a whole, and only the points
of leaves with more entries are compared one by one. Every task sends on one sum for each part, entry
and place; the codebooks are the only things that the driver holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors of a block, and points of a leaf, about.
BLOCK = 4096
LEAF = 16
#: Integers beyond this have squares that don't fit the sums.
LARGEST = 1 << 26
#: Shares that the rows of one label are joined in.
SALTS = 64

_BLOCK = "size int, ids array<long>, labels array<string>, v binary, trees binary"


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin; each is parted in two by the next level."""
    return np.arange((1 << level) + 1, dtype=np.int64) * n >> level


def tree_order(x: np.ndarray, levels: int) -> np.ndarray:
    """An order of ``x`` whose nodes, half by half, are split along the longest side of their box."""
    order = np.arange(len(x))
    for level in range(levels):
        edges = _bounds(len(x), level)
        held = x[order]
        sides = np.maximum.reduceat(held, edges[:-1]) - np.minimum.reduceat(held, edges[:-1])
        node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        order = order[np.lexsort((held[np.arange(len(x)), sides.argmax(1)[node]], node))]
    return order


class Tree:
    """Boxes, counts and sums of all nodes over rows in tree order, level by level."""

    def __init__(self, x: np.ndarray, levels: int):
        self.x, self.levels = x, levels
        self.edges = [_bounds(len(x), level) for level in range(levels + 1)]
        low, high, total = ([f.reduceat(x, self.edges[-1][:-1])] for f in (np.minimum, np.maximum, np.add))
        for _ in range(levels):
            low.insert(0, np.minimum(low[0][::2], low[0][1::2]))
            high.insert(0, np.maximum(high[0][::2], high[0][1::2]))
            total.insert(0, total[0][::2] + total[0][1::2])
        self.low, self.high, self.total = low, high, total

    @staticmethod
    def depth(n: int, leaf: int) -> int:
        return max(0, int(np.log2(max(1, n // leaf))))


def _least_of(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    out = np.full(groups, np.iinfo(np.int64).max)
    np.minimum.at(out, group, values)
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers from low to below high, and which pair each comes from."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def nearest(points: Tree, entries: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole nodes with their entry, by level, then single points with theirs. Ties go to the lower index."""
    names = tree_order(entries, Tree.depth(len(entries), 1))
    books = Tree(entries[names], Tree.depth(len(entries), 1))
    p = e = 0
    node, entry = np.zeros(1, np.int64), np.zeros(1, np.int64)
    single, whole = False, []
    while True:
        # the next finer nodes of the entries, then of the points
        if e < books.levels:
            node, entry, e = np.repeat(node, 2), np.stack([2 * entry, 2 * entry + 1], 1).ravel(), e + 1
        elif not single:
            entry, which = _spread(books.edges[e][entry], books.edges[e][entry + 1])
            node, single = node[which], True
        if p < points.levels and len(node):
            node, entry, p = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(entry, 2), p + 1
        low, high = points.low[p][node], points.high[p][node]
        elow, ehigh = (books.x[entry],) * 2 if single else (books.low[e][entry], books.high[e][entry])
        nearer = np.maximum(0, np.maximum(elow - high, low - ehigh))
        farther = np.maximum(ehigh - low, high - elow)
        least, most = (nearer * nearer).sum(1), (farther * farther).sum(1)
        bound = _least_of(most, node, len(points.edges[p]) - 1)
        stays = least <= bound[node]
        node, entry, most = node[stays], entry[stays], most[stays]
        if single and len(node):
            # an entry goes if the node's best one is nearer in the whole box, or as near and before it
            order = np.lexsort((names[entry], most, node))
            node, entry, most = node[order], entry[order], most[order]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            best = entry[np.repeat(first, np.diff(first, append=len(node)))]
            mine, other = books.x[best], books.x[entry]
            slope = 2 * (other - mine)
            gap = np.maximum(slope * points.low[p][node], slope * points.high[p][node]).sum(1) + (mine * mine).sum(1) - (other * other).sum(1)
            stays = (entry == best) | (gap > 0) | ((gap == 0) & (names[entry] < names[best]))
            node, entry = node[stays], entry[stays]
            alone = np.bincount(node, minlength=len(points.edges[p]) - 1)[node] == 1
            whole.append((p, node[alone], names[entry[alone]]))
            node, entry = node[~alone], entry[~alone]
        if single and (p == points.levels or not len(node)):
            break
    at, which = _spread(points.edges[p][node], points.edges[p][node + 1])
    apart = points.x[at] - books.x[entry[which]]
    order = np.lexsort((names[entry[which]], (apart * apart).sum(1), at))
    first = order[np.diff(at[order], prepend=-1) > 0]
    return whole, at[first], names[entry[which[first]]]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Valid vectors as integers, with the order of each part's tree."""
    for batch in batches:
        held: dict[int, list[int]] = {}
        column = batch.column(2)
        for i, v in enumerate(column):
            if v.is_valid and len(v.values) and not v.values.null_count and np.isfinite(v.values.to_numpy()).all():
                held.setdefault(len(v.values), []).append(i)
        out = []
        for size, rows in held.items():
            if size % PARTS:
                raise ValueError(f"vectors of {size} components have no {PARTS} equal parts")
            for a in range(0, len(rows), BLOCK):
                own = pa.array(rows[a : a + BLOCK])
                x = np.floor(SCALE * column.take(own).flatten().to_numpy().astype(np.float64)).reshape(-1, size)
                if (np.abs(x) > LARGEST).any():
                    raise ValueError(f"a component beyond {LARGEST // SCALE} has an error that no long holds")
                x = x.astype("<i4")
                parts = x.astype(np.int64).reshape(len(x), PARTS, -1)
                orders = [tree_order(parts[:, k], Tree.depth(len(x), LEAF)).astype("<u2").tobytes() for k in range(PARTS)]
                out.append((size, batch.column(0).take(own).to_pylist(), batch.column(1).take(own).to_pylist(), x.tobytes(), b"".join(orders)))
        types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(types)], ["size", "ids", "labels", "v", "trees"])


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of each block's smallest ids, null ids last."""
    for batch in batches:
        ids, held = [], []
        for size, own, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            x = np.frombuffer(v, "<i4").reshape(-1, size)
            rows = [(i is None, i or 0, x[k].tolist()) for k, i in enumerate(own)]
            for null, i, row in sorted(rows)[:ENTRIES]:
                ids.append(None if null else i)
                held.append(row)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.list_(pa.int32()))], ["id", "x"])


def _parts(v: bytes, trees: bytes, size: int) -> Iterator[tuple[np.ndarray, Tree]]:
    x = np.frombuffer(v, "<i4").astype(np.int64).reshape(-1, PARTS, size // PARTS)
    orders = np.frombuffer(trees, "<u2").astype(np.int64).reshape(PARTS, len(x))
    for k in range(PARTS):
        yield orders[k], Tree(x[orders[k], k], Tree.depth(len(x), LEAF))


def _summed(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count and sums of each part's entries over all blocks of a task."""
    counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for batch in batches:
        for size, v, trees in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for k, (_, tree) in enumerate(_parts(v, trees, size)):
                whole, at, entry = nearest(tree, books[k])
                for level, node, own in whole:
                    np.add.at(counts[k], own, tree.edges[level][node + 1] - tree.edges[level][node])
                    np.add.at(sums[k], own, tree.total[level][node])
                np.add.at(counts[k], entry, 1)
                np.add.at(sums[k], entry, tree.x[at])
    part, entry = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
    )


def _coded(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes and errors of all vectors of a block."""
    for batch in batches:
        for size, ids, labels, v, trees in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), *(batch.column(i).to_pylist() for i in (3, 4))):
            codes, error = np.empty((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
            for k, (order, tree) in enumerate(_parts(v, trees, size)):
                whole, at, entry = nearest(tree, books[k])
                codes[order[at], k] = entry
                for level, node, own in whole:
                    rows, which = _spread(tree.edges[level][node], tree.edges[level][node + 1])
                    codes[order[rows], k] = own[which]
                apart = tree.x - books[k][codes[order, k]]
                error[order] += (apart * apart).sum(1)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [ids.values, labels.values, pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"]
            )


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; unused entries stay."""
    width = books.shape[2]
    found = blocks.select("size", "v", "trees").mapInArrow(partial(_summed, books), "part int, entry int, n long, sums array<long>")
    found = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    after = books.copy()
    for r in found.collect():  # a row for each entry of each part
        after[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return after


def codes(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of the vectors of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Rows whose vector is null, empty or holds null or non-finite components are left out. All vectors
    have one length, a multiple of PARTS, and no component beyond LARGEST / SCALE; else an error is raised.
    Rows that share a vec_id are vectors of their own, those with none are coded too and come last in the
    choice of the first entries; with fewer than ENTRIES vectors each is an entry. Labels are compared as
    text, nulls are equal. Other columns are not read; a table without vectors gives an empty result.
    """
    scratch = Scratch(spark, "vectorcodes")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    blocks = scratch.keep(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    sizes = [r["size"] for r in blocks.select("size").distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    first = blocks.select("size", "ids", "v").mapInArrow(_first, "id long, x array<int>").orderBy(F.col("id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2) if first else np.zeros((PARTS, 1, 1), np.int64)
    for _ in range(ROUNDS):
        books = _round(blocks, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = scratch.keep(blocks.mapInArrow(partial(_coded, books), "vec_id long, label string, code string, error long"), "coded")
    scratch.drop("blocks")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    # the rows of a frequent label are joined in SALTS shares
    totals = totals.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    both = salted.join(totals, salted["label"].eqNullSafe(totals["__label"]) & (salted["__salt"] == totals["__salt"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

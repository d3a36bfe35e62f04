"""Embedding near-duplicates by NN-descent (operator 5).

Equal vectors are one node. A neighbour graph starts from buckets of random-hyperplane codes and is
refined by local joins: the neighbours of a node, forward and backward, are compared with each other,
and each keeps its best. A node all of whose neighbours reach the threshold is saturated, and its list
is enlarged. Lists of groups beyond the largest list are completed by comparing the members of a
linked component with each other in blocks; only link counts leave a block. Recall is audited in every
label, by linked vectors, against all its rows; a label where it is too low starts again from more
codes and goes on. What still fails after the last attempt is compared as a whole, label by label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected
from .scratch import Scratch

THRESHOLD = 0.98
#: Neighbours to start with, and the longest list.
LIST = 8
LONGEST = 32
ROUNDS = 4
TABLES = 6
#: Members of a code bucket, about, and the signs that part larger ones.
BUCKET = 16
FINER = 12
BLOCK = 256
#: Vectors audited in a label at first, how many of them must have a link, and the most audited.
AUDITED = 256
LINKED = 300
MOST_AUDITED = 16384
#: The share of audited linked vectors with all links that ends the search, and attempts before all pairs are compared.
RECALL = 0.99
ATTEMPTS = 3

_NODE = "node long, label string, m long, size int, v binary"


def _valid(rows: DataFrame) -> DataFrame:
    """Rows that can link, their components as double-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, held, sizes = [], [], [], []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if i is None or label is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                own = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(own).all() and own.any():
                    # a power of two takes the largest component near 1, exactly, so that no norm overflows or vanishes
                    own = np.ldexp(own, -int(np.frexp(np.abs(own).max())[1])) + 0.0
                    ids.append(i)
                    labels.append(label)
                    held.append(own.tobytes())
                    sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], ["id", "label", "size", "v"])

    return rows.mapInArrow(run, "id long, label string, size int, v binary")


def _unit(buffers: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(buffers), "<f8").reshape(len(buffers), -1)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _centres(nodes: DataFrame) -> DataFrame:
    """The mean unit vector of each label and size."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                rows.setdefault(key, []).append(i)
            held = [_unit(batch.column(2).take(pa.array(own)).to_pylist()).sum(0).tobytes() for own in rows.values()]
            labels, sizes = ([k[i] for k in rows] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(sizes, pa.int32()), pa.array([len(o) for o in rows.values()], pa.int64()), pa.array(held, pa.binary())], ["label", "size", "n", "v"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.sum([np.frombuffer(b, "<f8") for b in own], axis=0) / n for n, own in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([h.tobytes() for h in held], pa.binary())], ["label", "size", "centre"])

    part = nodes.select("label", "size", "v").mapInArrow(sums, "label string, size int, n long, v binary")
    return part.groupBy("label", "size").agg(F.sum("n").alias("n"), F.collect_list("v").alias("own")).mapInArrow(means, "label string, size int, centre binary")


def _codes(nodes: DataFrame, centres: DataFrame, bits: int, seed: int) -> DataFrame:
    """A bucket for each node and table: signs of random projections from the label's centre, and FINER more signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy()
            for n in np.unique(sizes):
                own = np.flatnonzero(sizes == n)
                v, centre = (batch.column(i).take(pa.array(own)).to_pylist() for i in (3, 4))
                apart = _unit(v) - np.frombuffer(b"".join(centre), "<f8").reshape(len(own), -1)
                planes = np.random.default_rng([seed, int(n)]).normal(size=(int(n), TABLES * (bits + FINER)))
                signs = (apart @ planes > 0).reshape(len(own), TABLES, bits + FINER)
                code, fine = ((signs[:, :, c] * (1 << np.arange(signs[:, :, c].shape[2], dtype=np.int64))).sum(2) for c in (slice(bits), slice(bits, None)))
                at = pa.array(np.repeat(own, TABLES))
                table = np.tile(np.arange(TABLES, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(table), pa.array(code.ravel()), pa.array(fine.ravel())], ["node", "label", "size", "place", "code", "fine"])

    rows = nodes.join(centres, ["label", "size"]).select("node", "label", "size", "v", "centre")
    return rows.mapInArrow(run, "node long, label string, size int, place int, code long, fine long")


def _started(nodes: DataFrame, centres: DataFrame, bits: int, seed: int) -> DataFrame:
    """Each node's best neighbours inside its buckets, all members compared.

    A bucket much larger than BUCKET is parted by further signs, which keep near vectors together, and
    by a salt only where they don't part it.
    """
    coded = _codes(nodes, centres, bits, seed)
    bucket = ["label", "size", "place", "code"]
    # large ones only, so that the joins stay small
    large = coded.groupBy(*bucket).agg(F.count("*").alias("n")).where(f"n > {2 * BUCKET}")
    more = F.least(F.ceil(F.log2(F.col("n") / BUCKET)), F.lit(FINER)).cast("int")
    mask = large.select(*bucket, (F.pow(F.lit(2.0), more).cast("long") - 1).alias("mask"))
    fine = coded.join(mask, bucket, "left").withColumn("fine", F.coalesce(F.col("fine").bitwiseAND(F.col("mask")), F.lit(0).cast("long")))
    dense = fine.groupBy(*bucket, "fine").agg(F.ceil(F.count("*") / (2 * BUCKET)).alias("parts")).where("parts > 1")
    salt = F.coalesce(F.pmod(F.xxhash64("node", "place", F.lit(seed)), "parts"), F.lit(0).cast("long"))
    placed = fine.join(dense, [*bucket, "fine"], "left").withColumn("salt", salt).select("node", *bucket, "fine", "salt")
    lists = placed.join(nodes.select("node", "v"), "node").groupBy(*bucket, "fine", "salt").agg(F.collect_list(F.struct("node", "v")).alias("own")).where("size(own) > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            fields, edges = batch.column(0).values, batch.column(0).offsets.to_pylist()
            ids = fields.field("node").to_numpy()
            for a, b in zip(edges, edges[1:]):
                v = _unit(fields.field("v").slice(a, b - a).to_pylist())
                cosine = v @ v.T
                np.fill_diagonal(cosine, -3)
                k = min(LIST, b - a - 1)
                best = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                out.append((ids[a:b].repeat(k), ids[a + best.ravel()], np.take_along_axis(cosine, best, 1).ravel()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["u", "v", "cosine"])

    found = lists.select("own").mapInArrow(run, "u long, v long, cosine double")
    return found.unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))


def _best(graph: DataFrame) -> DataFrame:
    """Each node's best neighbours: LIST of them, more while all so far reach the threshold."""
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cosine"), "v"))
    ranked = graph.dropDuplicates(["u", "v"]).withColumn("rank", rank)
    return ranked.where(f"rank <= {LIST} or (rank <= {LONGEST} and cosine >= {THRESHOLD})").drop("rank")


def _joined(graph: DataFrame, nodes: DataFrame, seed: int) -> DataFrame:
    """Local joins: pairs among the neighbours of a node that would enter a list."""
    back = graph.select(F.col("v").alias("w"), F.col("u").alias("x"), "cosine")
    pick = F.row_number().over(Window.partitionBy("w", "salt").orderBy(F.xxhash64("x", F.lit(seed))))
    # a node that many lists hold takes a part of them, found in two steps so that no task ranks them all
    back = back.withColumn("salt", F.pmod(F.xxhash64("x"), F.lit(16))).withColumn("pick", pick).where(f"pick <= {LIST}")
    back = back.withColumn("pick", F.row_number().over(Window.partitionBy("w").orderBy("pick", F.xxhash64("x")))).where(f"pick <= {2 * LIST}")
    rows = graph.select(F.col("u").alias("w"), F.col("v").alias("x")).unionByName(back.select("w", "x")).distinct()
    worst = graph.groupBy("u").agg(F.min("cosine").alias("worst"), F.count("*").alias("held"))
    about = nodes.join(worst, F.col("node") == F.col("u"), "left").select(
        F.col("node").alias("x"), "v", F.when((F.col("held") >= LIST) & (F.col("worst") < THRESHOLD), F.col("worst")).otherwise(-2.0).alias("worst")
    )
    lists = rows.join(about, "x").groupBy("w").agg(F.collect_list(F.struct("x", "worst", "v")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            own = batch.column(0)
            fields, edges = own.values, own.offsets.to_pylist()
            ids, worst, held = fields.field("x").to_numpy(), fields.field("worst").to_numpy(), fields.field("v")
            for a, b in zip(edges, edges[1:]):
                if b - a < 2:
                    continue
                v = _unit(held.slice(a, b - a).to_pylist())
                cosine = v @ v.T
                np.fill_diagonal(cosine, -3)
                i, j = np.nonzero(cosine > worst[a:b, None])
                out.append((ids[a + i], ids[a + j], cosine[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["u", "v", "cosine"])

    return lists.select("own").mapInArrow(run, "u long, v long, cosine double")


def _blocks(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of blocks of each component, as lists (``i`` is the first block)."""
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = nodes.join(placed, "node").join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = own.select("component", "node", "m", "v", "block", other)
    rows = rows.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "m", "v")
    return rows.groupBy("component", "i", "j").agg(F.collect_list(F.struct("block", "node", "m", "v")).alias("own")).select("i", "own")


def _counted(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """Vectors that each node of a component links to: the component against itself, a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_pylist()
            fields, edges = batch.column(1).values, batch.column(1).offsets.to_pylist()
            block, ids, m = (fields.field(c).to_numpy() for c in ("block", "node", "m"))
            found = []
            for i, a, b in zip(first, edges, edges[1:]):
                v = _unit(fields.field("v").slice(a, b - a).to_pylist())
                low = block[a:b] == i
                if low.all():
                    hit = v @ v.T >= THRESHOLD
                    np.fill_diagonal(hit, False)
                    found.append((ids[a:b], hit @ m[a:b]))
                else:
                    hit = v[low] @ v[~low].T >= THRESHOLD
                    found += [(ids[a:b][low], hit @ m[a:b][~low]), (ids[a:b][~low], hit.T @ m[a:b][low])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))], ["node", "links"])

    return _blocks(nodes, placed).mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _exact(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked, from comparing all nodes of a label: quadratic in its nodes.

    In a pair of blocks each member is linked with the first one it reaches, so that no list of all links
    leaves a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, edges = batch.column(1).values, batch.column(1).offsets.to_pylist()
            ids = fields.field("node").to_numpy()
            for a, b in zip(edges, edges[1:]):
                v = _unit(fields.field("v").slice(a, b - a).to_pylist())
                hit = v @ v.T >= THRESHOLD
                np.fill_diagonal(hit, True)
                # the least place each member reaches, spread until it stays
                least = np.arange(b - a)
                while True:
                    now = np.where(hit, least[None], b - a).min(1)
                    if (now == least).all():
                        break
                    least = now
                own = np.flatnonzero(least < np.arange(b - a))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + least[own]]), pa.array(ids[a + own])], ["a", "b"])

    whole = nodes.groupBy("label", "size").agg(F.min("node").alias("component"))
    return _blocks(nodes, nodes.join(whole, ["label", "size"]).select("node", "component")).mapInArrow(run, "a long, b long").distinct()


def truth(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Audited nodes of every label and size, compared with all its nodes: ``node``, ``label``, ``size``, ``true`` links.

    More are audited, eight times as many each time, until LINKED of them have a link, all nodes are
    audited, or MOST_AUDITED are.
    """
    key = ["label", "size"]
    sizes = scratch.keep(nodes.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    found, wanted = None, AUDITED
    left = sizes
    for step in range(8):
        own = nodes.select("node", *key, "m", "v").join(left, key)
        pick = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(1 << 30)) * F.col("n") < F.lit(wanted << 30)
        asked = own.where(pick).withColumn("part", F.pmod(F.xxhash64(F.lit(12), "node"), F.ceil(F.least("n", F.lit(wanted)) / BLOCK)))
        asked = asked.groupBy(*key, "n", "part").agg(F.collect_list(F.struct("node", "v")).alias("asked"))
        salts = lambda n: F.ceil(n / (64 * BLOCK))
        asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts(F.col("n")) - 1))).drop("n")
        lists = own.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))).groupBy(*key, "n", "block").agg(F.collect_list(F.struct("node", "m", "v")).alias("own"))
        lists = lists.withColumn("salt", F.pmod(F.col("block"), salts(F.col("n"))))
        both = lists.join(asked, [*key, "salt"]).select(*key, "asked", "own")
        now = both.mapInArrow(_true, "node long, label string, size int, true long").groupBy("node", *key).agg(F.sum("true").alias("true"))
        now = scratch.keep(now, f"audited-{step}")
        linked = now.groupBy(*key).agg(F.count_if(F.col("true") > 0).alias("linked"))
        short = left.join(linked, key, "left").where(f"coalesce(linked, 0) < {LINKED} and n > {wanted} and {wanted} < {MOST_AUDITED}").select(*key, "n")
        short = scratch.keep(short, f"short-{step}")
        now = now.join(short.select(*key), key, "left_anti").select("node", *key, "true")
        found = now if found is None else found.unionByName(now)
        if short.isEmpty():
            break
        left, wanted = short, wanted * 8
    return scratch.keep(found, "truth")


def _true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        q, o = batch.column(2), batch.column(3)
        edges = list(zip(q.offsets.to_pylist(), q.offsets.to_pylist()[1:], o.offsets.to_pylist(), o.offsets.to_pylist()[1:]))
        names, ids, m = q.values.field("node").to_numpy(), o.values.field("node").to_numpy(), o.values.field("m").to_numpy()
        for label, size, (a, b, c, d) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), edges):
            hit = _unit(q.values.field("v").slice(a, b - a).to_pylist()) @ _unit(o.values.field("v").slice(c, d - c).to_pylist()).T >= THRESHOLD
            hit &= names[a:b, None] != ids[c:d]
            n = b - a
            yield pa.RecordBatch.from_arrays([pa.array(names[a:b]), pa.array([label] * n, pa.string()), pa.array([size] * n, pa.int32()), pa.array((hit @ m[c:d]).astype(np.int64))], ["node", "label", "size", "true"])


def audit(known: DataFrame, links: DataFrame) -> DataFrame:
    """``label``, ``size`` and ``recall``: the share of the audited vectors with a link whose links ``links`` (node, links) all has."""
    both = known.where(F.col("true") > 0).join(links, "node", "left")
    return both.groupBy("label", "size").agg(F.avg((F.coalesce("links", F.lit(0)) >= F.col("true")).cast("int")).alias("recall"))


def groups(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``, ``label``).

    Two rows are linked when their labels are equal and their cosine is at least THRESHOLD. Rows with a null id, label
    or vector, an empty or zero vector, or null or non-finite components link with nothing; vectors of
    different sizes don't either. Equal rows are separate vectors, linked with each other. vec_id is
    taken as a key: rows that share it but differ count as one node of their component. Other columns
    are not read; an empty table gives an empty result. ``audited_recall`` is the share of the audited
    linked vectors of the row's label that have all their links, null where none of them has a link.
    """
    scratch = Scratch(spark, "neighbours")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "embedding")
    valid = _valid(rows).select("*", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2"))
    valid = scratch.keep(valid, "valid")
    key = ["label", "size", "k1", "k2"]
    classes = scratch.keep(valid.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("m")), "classes")
    firsts = valid.withColumnRenamed("id", "node").join(classes, [*key, "node"]).dropDuplicates([*key, "node"])
    nodes = scratch.keep(firsts.select("node", "label", "m", "size", "v"), "nodes")
    most = nodes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 1
    bits = int(np.clip(np.ceil(np.log2(most / BUCKET + 1)), 1, 24))
    centres = scratch.keep(_centres(nodes), "centres")
    checked = truth(scratch, nodes)
    live, graph, placed, found = nodes, None, None, None
    for attempt in range(ATTEMPTS + 1):
        if attempt < ATTEMPTS:
            fresh = _started(live, centres, bits, attempt)
            graph = scratch.keep(_best(fresh if graph is None else graph.unionByName(fresh)), f"graph-{attempt}-0")
            before = None
            for i in range(1, ROUNDS + 1):
                graph = scratch.keep(_best(graph.unionByName(_joined(graph, live, i))), f"graph-{attempt}-{i}")
                scratch.drop(f"graph-{attempt}-{i - 1}")
                now = graph.where(f"cosine >= {THRESHOLD}").count()
                if before is not None and now <= before * 1.001:
                    break
                before = now
            links = graph.where(f"cosine >= {THRESHOLD}").select(F.col("u").alias("a"), F.col("v").alias("b"))
        else:
            links = _exact(live)
        own = connected(scratch, links, f"parts-{attempt}")
        counts = scratch.keep(_counted(live, own), f"links-{attempt}")
        # labels that fail the audit go on, the others are done
        failed = audit(checked, counts).join(live.select("label", "size").distinct(), ["label", "size"], "left_semi").where(f"recall < {RECALL}")
        failed = scratch.keep(failed.select("label", "size"), f"failed-{attempt}")
        last = attempt == ATTEMPTS or failed.isEmpty()
        if not last:
            rest = scratch.keep(live.join(failed, ["label", "size"], "left_semi"), f"live-{attempt}")
            ids = rest.select("node")
            own, counts = own.join(ids, "node", "left_anti"), counts.join(ids, "node", "left_anti")
            graph = scratch.keep(graph.join(ids.withColumnRenamed("node", "u"), "u", "left_semi").select("u", "v", "cosine"), f"graph-{attempt}-rest")
            live = rest
        placed = own if placed is None else placed.unionByName(own)
        found = counts if found is None else found.unionByName(counts)
        if last:
            break
    known = valid.select("id", *key).distinct().join(classes, key).select("id", "node", "m")
    known = known.join(placed, "node", "left").join(found, "node", "left")
    known = known.groupBy("id").agg(
        F.max(F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.min(F.coalesce("component", "node")).alias("component")
    )
    # a row for each label
    recall = scratch.keep(audit(checked, found).groupBy("label").agg(F.min("recall").alias("audited_recall")), "recall")
    out = rows.select("id", "label").join(known, "id", "left").join(recall, "label", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), "audited_recall"
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("vec_id", "n_links", "component_id", kept, "audited_recall")

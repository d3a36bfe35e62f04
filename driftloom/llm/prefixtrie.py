"""Conversation prefix tries in double arrays (operator 12).

A turn is known by 128 bits of the SHA-256 of its role and text, so its text is read once and never
shuffled. Equal conversations are one sequence of turns with a count. The different sequences are
sorted and dealt into ranges; every range is a shard of the trie, whatever prefixes are frequent,
since no two sequences are equal. In a shard the turns get dense ids, the trie is packed into BASE and
CHECK arrays, and all sequences walk down the arrays at once to fill the nodes' sums. Only the nodes
on a shard's edge go on in another one. A shard is told the last sequence before it and the first one
after it, so a node counts as new in one shard alone and all sums of the upper nodes can be added up.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Turns of a shard, about, and ids of conversations that are written into one row of a node's list.
SHARD_TURNS = 100_000
IDS = 65_536
#: Free slots that are tried at once for the children of a node.
TRIED = 1024

_NODE = "key binary, parent binary, shard int, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, spent long, own long, ends string, shared boolean"


def conversations(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (an array of ``id`` and ``bytes``) of every conversation, ordered by turn, nulls first.

    Turns of one number are ordered by role and then by the SHA-256 of their text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), F.sha2(text, 256).alias("order"),
        F.unhex(F.substring(F.sha2(told, 256), 1, 32)).alias("id"), F.octet_length(text).cast("long").alias("bytes"),
    )
    held = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("conv_id is not null")
    held = held.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def with_borrowed_heads(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Conversations whose first turns, crc32 of their id modulo ``most`` of them, are those of the first one of their family."""
    first = F.col("conv_id") - F.col("conv_id") % family
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = convs.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("__first"), F.slice("turns", 1, most - 1).alias("__head"))
    head = F.slice(F.coalesce("__head", F.slice("turns", 1, 0)), 1, h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return convs.join(heads, first == F.col("__first"), "left").select("conv_id", F.concat(head, own).alias("turns"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each sequence's ids; the rows of one sequence follow each other in order."""
    held: tuple | None = None

    def row(s, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.binary()), pa.array([h.hexdigest()])], ["sid", "ends"])

    for batch in batches:
        ids, out = [], []
        for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if held and held[0] == sid:
                held[1].update(b"," + text.encode())
                continue
            if held:
                ids.append(held[0])
                out.append(held[1].hexdigest())
            held = (sid, hashlib.sha256(text.encode()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(out, pa.string())], ["sid", "ends"])
    if held:
        yield row(*held)


def _sequences(scratch: Scratch, convs: DataFrame) -> DataFrame:
    """Different sequences: ``turns``, ``n``, the smallest ``conv_id`` and ``ends``, the hash of all ids."""
    sid = F.unhex(F.sha2(F.to_binary(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""), F.lit("hex")), 256))
    part = F.shiftright("conv_id", IDS.bit_length() - 1).alias("part")
    # a part has IDS ids at most, so no list grows with the number of equal conversations
    parts = convs.select(sid.alias("sid"), part, "conv_id", "turns").groupBy("sid", "part").agg(F.sort_array(F.collect_set("conv_id")).alias("ids"), F.first("turns").alias("turns"))
    parts = scratch.keep(parts, "parts")
    whole = parts.groupBy("sid").agg(F.sum(F.size("ids")).alias("n"), F.min(F.col("ids")[0]).alias("conv_id"), F.first("turns").alias("turns"))
    lists = parts.select("sid", "part", F.array_join("ids", ",").alias("text")).repartition("sid").sortWithinPartitions("sid", "part").select("sid", "text")
    return whole.join(lists.mapInArrow(_hashed, "sid binary, ends string"), "sid").select("turns", "n", "conv_id", "ends")


class DoubleArray:
    """A trie over sequences of dense codes: node ``s`` has the child of ``code`` at BASE[s] + code, if CHECK there is ``s``."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.codes, self.starts, self.sizes = codes, starts, sizes
        self.base = np.zeros(1024, np.int64)
        self.check = np.full(1024, -1, np.int64)
        self.check[0] = 0  # the root
        self.low = 1
        self._build()

    def _room(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, count: int) -> np.ndarray:
        """The first ``count`` free slots."""
        found, at = [np.zeros(0, np.int64)], self.low
        while count > 0:
            self._room(at + max(count, TRIED))
            own = at + np.flatnonzero(self.check[at : at + max(count, TRIED)] < 0)[:count]
            found.append(own)
            at, count = at + max(count, TRIED), count - len(own)
        return np.concatenate(found)

    def _fit(self, children: np.ndarray) -> int:
        """A base at which all slots of sorted ``children`` are free."""
        at, gaps = self.low, children - children[0]
        while at < len(self.check):
            own = at + np.flatnonzero(self.check[at : at + TRIED] < 0)
            self._room(at + TRIED + int(gaps[-1]) + 1)
            for gap in gaps[1:]:
                own = own[self.check[own + gap] < 0]
                if not len(own):
                    break
            if len(own):
                return int(own[0] - children[0])
            at += TRIED
        self._room(at + int(gaps[-1]) + 1)
        return int(at - children[0])

    def _build(self) -> None:
        at = np.zeros(len(self.sizes), np.int64)
        for depth in itertools.count():
            live = np.flatnonzero(self.sizes > depth)
            if not len(live):
                return
            pairs = np.unique(np.stack([at[live], self.codes[self.starts[live] + depth]], 1), axis=0)
            edges = np.flatnonzero(np.diff(pairs[:, 0], prepend=-1))
            counts = np.diff(edges, append=len(pairs))
            for a, k in zip(edges[counts > 1].tolist(), counts[counts > 1].tolist()):
                node, children = int(pairs[a, 0]), pairs[a : a + k, 1]
                self.base[node] = self._fit(children)
                self.check[self.base[node] + children] = node
            single = pairs[edges[counts == 1]]
            slots = self._free(len(single))
            self.base[single[:, 0]] = slots - single[:, 1]
            self.check[slots] = single[:, 0]
            while self.low < len(self.check) and self.check[self.low] >= 0:
                self.low += 1
            at[live] = self.step(at[live], self.codes[self.starts[live] + depth])

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children of ``nodes`` by ``codes``; an absent one is an error."""
        slots = self.base[nodes] + codes
        if (self.check[slots] != nodes).any():
            raise LookupError("no such child")
        return slots

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sequences that reach a depth and their nodes there, from the root down."""
        live, at = np.arange(len(self.sizes)), np.zeros(len(self.sizes), np.int64)
        for depth in itertools.count():
            if not len(live):
                return
            yield live, at
            on = self.sizes[live] > depth
            live, at = live[on], at[on]
            at = self.step(at, self.codes[self.starts[live] + depth])


def _dense(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Dense ids of turns, numbered by depth, so that siblings have near ids."""
    pairs = values.view("<u8").reshape(-1, 2)
    names, codes = np.unique(pairs, axis=0, return_inverse=True)
    depth = np.arange(len(values)) - np.repeat(starts, sizes)
    first = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(first, codes.ravel(), depth)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((np.arange(len(names)), first))] = np.arange(len(names))
    return rank[codes.ravel()]


def _common(a: list | None, b: list | None) -> int:
    if a is None or b is None:
        return 0
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _shard(rows: pa.Table, edge: pa.Table) -> pa.Table:
    """Nodes of one shard; those that other shards have too are marked, with their shares of all sums."""
    turns = rows["turns"].combine_chunks()
    turns = turns.chunk(0) if isinstance(turns, pa.ChunkedArray) else turns
    offsets = turns.offsets.to_numpy()
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    fields = turns.values.slice(offsets[0], offsets[-1] - offsets[0])
    ids, weights = fields.field("id").to_pylist(), fields.field("bytes").to_numpy(zero_copy_only=False)
    codes = _dense(np.frombuffer(b"".join(ids), "V16"), starts, sizes) if ids else np.zeros(0, np.int64)
    n, conv, ends = rows["n"].to_numpy(), rows["conv_id"].to_numpy(), rows["ends"].to_pylist()
    low, high, before, after = (None if (x := edge[c][0].as_py()) is None else [t["id"] for t in x] for c in ("low", "high", "before", "after"))
    trie = DoubleArray(codes, starts, sizes)
    size = len(trie.check)
    n_convs, own, depth, above = (np.zeros(size, np.int64) for _ in range(4))
    least, finish = np.full(size, np.iinfo(np.int64).max), np.full(size, -1, np.int64)
    order = []
    for d, (live, at) in enumerate(trie.levels()):
        np.add.at(n_convs, at, n[live])
        np.minimum.at(least, at, conv[live])
        finish[at[sizes[live] == d]] = live[sizes[live] == d]
        slots = np.unique(at)
        depth[slots], above[slots] = d, trie.check[slots]
        if d:
            own[at] = weights[starts[live] + d - 1]
        order.append(slots)
    # the path that the sequence before has begun, and the one that the sequence after goes on with
    code_of = {i: c for i, c in zip(ids, codes.tolist())}
    new = np.ones(size, bool)
    new[0] = before is None
    shared = {0: _key([])}
    open_end = np.zeros(size, bool)
    for path, other, old in ((low, before, True), (high, after, False)):
        common, node, key = _common(path, other), 0, hashlib.sha256()
        open_end[0] |= not old and other is not None
        for i in path[:common]:
            node = int(trie.step(np.array([node]), np.array([code_of[i]]))[0])
            key.update(i)
            shared[node] = key.digest()
            if old:
                new[node] = False
            else:
                open_end[node] = True
    children, leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
    spent, distinct = n_convs * own, own * new
    has_child = np.zeros(size, bool)
    for slots in order[:0:-1]:
        has_child[above[slots]] = True
        leaves[slots] += ~has_child[slots] & new[slots] & ~open_end[slots]
        np.add.at(children, above[slots], new[slots].astype(np.int64))
        for sums in (leaves, spent, distinct):
            np.add.at(sums, above[slots], sums[slots])
    leaves[0] += not has_child[0] and not open_end[0] and bool(new[0])
    nodes = np.concatenate(order)
    is_shared = np.isin(nodes, list(shared))
    parent_shared = np.isin(above[nodes], list(shared)) & (nodes != 0)
    empty = hashlib.sha256(b"").hexdigest()
    root = nodes == 0
    return pa.table(
        {
            "key": pa.array([shared.get(x) for x in nodes.tolist()], pa.binary()),
            "parent": pa.array([shared[p] if s else None for p, s in zip(above[nodes].tolist(), parent_shared.tolist())], pa.binary()),
            "shard": pa.array(np.full(len(nodes), edge["shard"][0].as_py(), np.int32)),
            "depth": pa.array(depth[nodes].astype(np.int32)),
            "conv_id": pa.array(least[nodes]),
            "parent_conv_id": pa.array(least[above[nodes]], mask=root | parent_shared),
            "n_convs": pa.array(n_convs[nodes]), "n_children": pa.array(children[nodes]), "n_leaves": pa.array(leaves[nodes]),
            "spent": pa.array(spent[nodes]), "own": pa.array(distinct[nodes]),
            "ends": pa.array([ends[f] if f >= 0 else (None if s else empty) for f, s in zip(finish[nodes].tolist(), is_shared.tolist())], pa.string()),
            "shared": pa.array(is_shared),
        }
    )


def _key(path: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(path)).digest()


def _merged(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """All nodes once: those of one shard as they are, the shared upper ones added up over their shards."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "spent", "own")]
    upper = nodes.where("shared").groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.coalesce(F.max("ends"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends"))
    upper = scratch.keep(upper, "upper")
    smallest = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("__above"))
    # the names of a shard's upper nodes go to that shard, so that no join has more rows of a key than a shard has
    told = scratch.keep(nodes.where("shared").select("shard", F.col("key").alias("parent")).join(smallest, "parent"), "told")
    lower = nodes.where("not shared").join(told.hint("merge"), ["shard", "parent"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__above"))
    upper = upper.join(smallest, "parent", "left").withColumn("parent_conv_id", F.col("__above"))
    wanted = [
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("spent") - F.col("own")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    ]
    return lower.select(*wanted).unionByName(upper.select(*wanted))


def nodes(spark: SparkSession, convs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``convs`` (``conv_id``, ``turns`` as ``conversations`` gives them).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256`` of each. A conversation without turns ends at the root. A table
    without conversations has no node, not even a root. A conversation's turns are one row of about 24
    bytes a turn, however long their texts are.
    """
    scratch = Scratch(spark, "prefixtrie")
    found = scratch.keep(_sequences(scratch, convs), "sequences")
    scratch.drop("parts")
    turns = found.agg(F.sum(F.size("turns"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    shards = scratch.keep(found.repartitionByRange(parts, "turns").withColumn("shard", F.spark_partition_id()), "shards")
    scratch.drop("sequences")
    # a row for each shard
    edges = shards.groupBy("shard").agg(F.min("turns").alias("low"), F.max("turns").alias("high"))
    by = Window.orderBy("shard")
    edges = scratch.keep(edges.withColumns({"before": F.lag("high").over(by), "after": F.lead("low").over(by)}), "edges")
    own = shards.groupBy("shard").cogroup(edges.groupBy("shard")).applyInArrow(_shard, _NODE)
    return _merged(scratch, scratch.keep(own, "nodes"))


def rebuilt_nodes(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Nodes of all conversations of ``rows`` (``conv_id``, ``turn``, ``role``, ``text``), each with its family's first turns.

    A null role or text is empty; rows with a null conv_id are no conversation's and left out; turns of one
    number are all kept, in the order of ``conversations``, repeated rows too; other columns are not read.
    """
    scratch = Scratch(spark, "conversations")
    return nodes(spark, with_borrowed_heads(scratch.keep(conversations(rows), "turns")))

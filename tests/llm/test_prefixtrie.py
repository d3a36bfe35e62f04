"""The trie of conversations against a dictionary of all prefixes."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm import prefixtrie


def rebuilt(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(held)] for c, held in turns.items()}
    out = {}
    for c in own:
        h, first = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = tuple(own.get(first, [])[:h] + own[c][h:])
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = collections.defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, held in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1].encode()) if p else 0
    done = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -(10**9), len(m), children[p], leaves[p], saved[p], done(p)) for p, m in members.items())


def found(df):
    named = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in named) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, shard string")


def some_rows(seed):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(-7, 120):
        for t in range(int(r.integers(1, 12))):
            rows.append((c, t, ["user", "assistant", None][t % 3], f"é{int(r.integers(0, 2))}" if t < 9 else f"own {c}"))
    rows += [(200, None, "user", None), (200, 1, None, ""), (200, 1, None, ""), (200, 1, "a", "b"), (200, 0, "u", "x"), (None, 0, "u", "x")]
    # a third of all conversations are equal; one is long
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1400, 5) for t in range(10)]
    return rows + [(5000, t, "user", f"long {t}") for t in range(700)]


@pytest.mark.parametrize("turns", [100_000, 7])
def test_nodes_equal_a_dictionary_of_prefixes(spark, monkeypatch, turns):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", turns)
    rows = some_rows(1)
    assert found(prefixtrie.rebuilt_nodes(spark, table(spark, rows))) == brute(rows)


def test_conversations_without_turns_and_without_family(spark):
    # a conversation that borrows turns from an absent family loses its own first ones
    assert zlib.crc32(b"7") % 9 > 1
    rows = [(7, 0, "u", "a"), (8, 0, "u", "b")]
    assert found(prefixtrie.rebuilt_nodes(spark, table(spark, rows))) == brute(rows)


def test_no_conversation_has_no_node(spark):
    assert prefixtrie.rebuilt_nodes(spark, table(spark, [(None, 0, "u", "x")])).collect() == []
    assert prefixtrie.rebuilt_nodes(spark, table(spark, []).where("false")).collect() == []


def test_long_lists_of_ids_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "IDS", 4)
    rows = [(c, 0, "u", "same") for c in range(-40, 300, 5)]
    assert found(prefixtrie.rebuilt_nodes(spark, table(spark, rows).repartition(7))) == brute(rows)


def test_double_array_finds_every_sequence():
    r = np.random.default_rng(3)
    paths = sorted({tuple(r.integers(0, 30, size=r.integers(0, 6)).tolist()) for _ in range(2000)})
    sizes = np.array([len(p) for p in paths])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    codes = np.array([x for p in paths for x in p], np.int64)
    trie = prefixtrie.DoubleArray(codes, starts, sizes)
    prefixes = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert (trie.check >= 0).sum() == len(prefixes)
    ends = {}
    for d, (live, at) in enumerate(trie.levels()):
        for i, s in zip(live.tolist(), at.tolist()):
            assert ends.setdefault(paths[i][:d], s) == s
    assert len(set(ends.values())) == len(prefixes)
    with pytest.raises(LookupError):
        trie.step(np.array([0]), np.array([999 % len(trie.check)]))


def test_turns_of_one_number_are_ordered_by_role_and_hash(spark):
    rows = [(5, 0, "b", "x"), (5, 0, "a", "x"), (5, None, "c", None)]
    held = prefixtrie.conversations(table(spark, rows)).select(F.transform("turns", lambda t: t["bytes"]).alias("b")).first()["b"]
    assert held == [0, 1, 1]

"""Search through learned partitions against all products, and the parts it learns."""

import os

import numpy as np
import pytest

from driftloom.llm import partitions, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def summed(q, x):
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += q[k] * x[:, k]
    return total


def brute(ids, x, every=20):
    out = {}
    for q in np.unique(ids[ids % every == 0]):
        score = summed(x[np.flatnonzero(ids == q)[0]], x)
        rest = np.flatnonzero(ids != q)
        out[int(q)] = [(int(ids[i]), score[i]) for i in rest[np.lexsort((ids[rest], -score[rest]))][:20]]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, own in out.items():
        own.sort()
        assert [o[0] for o in own] == list(range(1, len(own) + 1))
        assert [o[1:] for o in own] == sorted((o[1:] for o in own), key=lambda o: (-o[1], o[0]))
        out[q] = [o[1:] for o in own]
    return out


def recall(got, want):
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert all(abs(dict(want[q]).get(i, s) - s) < 1e-12 for q in want for i, s in got[q])
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<double>, part int, score double")


def test_clustered_vectors_are_found_in_few_parts(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 24))[r.integers(0, 40, size=4000)] + r.normal(scale=0.3, size=(4000, 24))
    df = partitions.search(spark, table(spark, [(i, x[i].tolist()) for i in range(4000)]))
    assert recall(found(df), brute(np.arange(4000), x)) >= 0.95
    # below 1 if not all parts were asked
    assert partitions.RECALL <= df.first()["audited_recall"] < 1


def test_a_third_of_equal_vectors_keep_the_smaller_ids(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(900, 16))
    x[r.permutation(900)[:300]] = x[7]
    ids = r.permutation(900)
    got, want = found(partitions.search(spark, table(spark, [(int(i), x[i].tolist()) for i in ids]))), brute(np.arange(900), x)
    assert recall(got, want) >= 0.9
    for q in range(0, 900, 20):
        if (x[q] == x[7]).all():
            assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_rows_that_take_no_part_few_rows_and_other_lengths(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(25)] + [(40, [1.0, 2.0, 3.0]), (41, [3.0, 0.0, 0.0]), (60, [0.0, 0.0]), (80, None), (100, []), (120, [None, 1.0]), (140, [float("nan"), 1.0]), (None, [9.0, 9.0])]
    got = found(partitions.search(spark, table(spark, rows)))
    assert got.keys() == {0, 20, 40} and got[40] == [(41, 3.0)]
    assert [i for i, _ in got[0]] == list(range(24, 4, -1)) and got[20][0] == (24, 21 * 25 + 1.0)
    twice = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0])]
    assert found(partitions.search(spark, table(spark, twice))) == {0: [(1, 2.0), (1, 2.0)]}
    assert partitions.search(spark, table(spark, rows).where("false")).collect() == []


def test_small_blocks_give_the_same_rows(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 8))
    df = table(spark, [(i, x[i].tolist()) for i in range(400)])
    want = found(partitions.search(spark, df))
    monkeypatch.setattr(partitions, "BLOCK", 32)
    monkeypatch.setattr(partitions, "ASKED", 3)
    assert found(partitions.search(spark, df)) == want


def test_parts_are_balanced_and_cut_few_edges():
    r = np.random.default_rng(3)
    group = r.integers(0, 8, size=1003)
    x = 4 * np.eye(8)[group] + r.normal(scale=0.2, size=(1003, 8))
    ends = partitions.neighbour_graph(x, 10)
    assert (ends[0] != ends[1]).all() and len(ends[0]) == 10030
    part = partitions.balanced_parts(ends, 1003, 3)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() - sizes.min() <= 2
    cut, chance = (part[ends[0]] != part[ends[1]]).mean(), 7 / 8
    assert cut < chance / 4


def test_the_network_learns_the_parts_of_neighbours():
    r = np.random.default_rng(6)
    x = r.normal(size=(16, 12))[r.integers(0, 16, size=2000)] + r.normal(scale=0.2, size=(2000, 12))
    net = partitions.trained(x, 16)
    own = net.order(x)
    ends = partitions.neighbour_graph(x, 20)
    part = own[:, 0]
    first = (own[ends[0], :4] == part[ends[1]][:, None]).any(1).mean()
    assert first > 0.85


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_recall_on_the_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert recall(found(queries.op11_partitions(spark, FOLDER)), brute(ids, x)) >= 0.9

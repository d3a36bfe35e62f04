"""Integer product quantisation against plain rounds over all entries."""

import collections
import hashlib

import numpy as np
import pytest

from driftloom.llm import vectorcodes


def brute(rows):
    kept = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([r[2] for r in kept]).reshape(len(kept), 16, -1)
    books = x[:64].transpose(1, 0, 2).copy()

    def assigned():
        return np.stack([((x[:, k, None] - books[k][None]) ** 2).sum(2).argmin(1) for k in range(16)], 1)

    for _ in range(2):
        codes = assigned()
        for k in range(16):
            for e in range(books.shape[1]):
                if (codes[:, k] == e).any():
                    own = x[codes[:, k] == e, k]
                    books[k, e] = [int(s) // len(own) for s in own.sum(0)]
    codes = assigned()
    errors = sum(((x[:, k] - books[k][codes[:, k]]) ** 2).sum(1) for k in range(16))
    totals = collections.Counter()
    for (_, label, _), e in zip(kept, errors):
        totals[label] += int(e)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted((-1 if i is None else i, "".join(f"{c:02x}" for c in code), int(e), totals[label], digest) for (i, label, _), code, e in zip(kept, codes, errors))


def found(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, size int")


@pytest.mark.parametrize(("n", "block"), [(3, 4096), (70, 4096), (900, 4096), (900, 100)])
def test_codes_equal_plain_rounds(spark, monkeypatch, n, block):
    monkeypatch.setattr(vectorcodes, "BLOCK", block)
    r = np.random.default_rng(n)
    centres = r.normal(size=(9, 32))
    v = centres[r.integers(0, 9, size=n)] + r.normal(scale=0.2, size=(n, 32)) * r.integers(0, 2, size=(n, 1))
    v[: n // 3] = v[0]  # a third are copies
    rows = [(i + 10, v[i].tolist(), None if i % 5 == 0 else i % 4) for i in r.permutation(n).tolist()]
    bad = [(1, None, 1), (2, [], 1), (3, [None] + [0.0] * 31, 1), (4, [float("nan")] * 32, None), (5, [float("inf")] * 32, 2)]
    rows += [(None, [0.5] * 32, 3), (11, [-0.25] * 32, 3), (11, [-0.25] * 32, 3)]
    assert found(vectorcodes.codes(spark, table(spark, rows + bad).repartition(5))) == brute(rows)


def test_lengths_sizes_and_empty_tables(spark):
    assert vectorcodes.codes(spark, table(spark, [(1, None, 1)])).collect() == []
    assert vectorcodes.codes(spark, table(spark, [(1, [1.0] * 16, 1)]).where("false")).collect() == []
    for rows in ([(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)], [(1, [1.0] * 15, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(Exception, match="components|component beyond"):
            vectorcodes.codes(spark, table(spark, rows)).collect()


@pytest.mark.parametrize("entries", [1, 2, 13, 64])
@pytest.mark.parametrize("n", [1, 17, 2500])
def test_dual_trees_find_the_nearest_entry_and_the_lower_of_ties(n, entries):
    r = np.random.default_rng(n + entries)
    for spread in (2, 300):
        x, books = r.integers(-spread, spread, size=(n, 3)), r.integers(-spread, spread, size=(entries, 3))
        order = vectorcodes.tree_order(x, vectorcodes.Tree.depth(n, vectorcodes.LEAF))
        tree = vectorcodes.Tree(x[order], vectorcodes.Tree.depth(n, vectorcodes.LEAF))
        whole, at, entry = vectorcodes.nearest(tree, books)
        codes = np.full(n, -1)
        codes[order[at]] = entry
        for level, node, own in whole:
            for a, e in zip(node, own):
                span = order[tree.edges[level][a] : tree.edges[level][a + 1]]
                assert (codes[span] == -1).all() and (tree.total[level][a] == x[span].sum(0)).all()
                codes[span] = e
        assert (codes == ((x[:, None] - books[None]) ** 2).sum(2).argmin(1)).all()
        assert entries > 1 or len(at) == 0  # one entry takes the root as a whole

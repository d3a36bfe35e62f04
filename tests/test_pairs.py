"""Pair summaries by blocks against whole distance tables."""

import numpy as np
import pytest

from driftloom.operators import pairs


def brute(d, w):
    order = np.argsort(d, kind="stable")
    cum = np.cumsum(w[order])
    at = lambda q: d[order][np.searchsorted(cum, q * cum[-1] - 1e-12)]
    return float(np.average(d, weights=w)), at(0.5), at(0.1), at(0.9), d.min(), d.max(), len(d)


@pytest.mark.parametrize(("points", "references", "queries"), [(128, 2048, 256), (4, 50, 7), (2, 9, 100)])
def test_summaries_equal_whole_tables(spark, monkeypatch, points, references, queries):
    monkeypatch.setattr(pairs, "POINTS", points)
    monkeypatch.setattr(pairs, "REFERENCES", references)
    monkeypatch.setattr(pairs, "QUERIES", queries)
    r = np.random.default_rng(points)
    refs = {k: (np.round(r.normal(size=(n, 3)), 2), r.integers(1, 6, size=n)) for k, n in (("a", 300), ("b", 60), ("c", 1))}
    refs["a"][0][:100] = refs["a"][0][0]  # many ties
    asked = {k: np.round(r.normal(size=(n, 3)), 2) for k, n in (("a", 20), ("b", 9), ("c", 2), ("none", 3))}
    left = spark.createDataFrame([(k, i, v.tolist()) for k, vs in asked.items() for i, v in enumerate(vs)], "key string, query_id long, v array<double>")
    right = spark.createDataFrame([(k, i, int(w), v.tolist()) for k, (vs, ws) in refs.items() for i, (v, w) in enumerate(zip(vs, ws))], "key string, reference_id long, weight int, v array<double>")
    got = {(x["key"], x["query_id"]): x for x in pairs.summaries(left, right.repartition(3)).collect()}
    assert got.keys() == {(k, i) for k in "abc" for i in range(len(asked[k]))}
    for (k, i), x in got.items():
        d = np.round(np.sqrt(((asked[k][i] - refs[k][0]) ** 2).sum(1)), 6)
        want = brute(d, refs[k][1])
        assert np.allclose([x[c] for c in ("mean", "p50", "p10", "p90", "least", "most", "panel_size")], want, atol=1.1e-6), (k, i, x, want)
        assert np.allclose([x[c] for c in ("p50", "p10", "p90", "least", "most")], want[1:6], atol=1e-9)


def test_points_bracket_the_quantile():
    blocks = [(0, [{"d": 1, "upto": 2, "before": 0}, {"d": 9, "upto": 10, "before": 8}]), (0, [{"d": 4, "upto": 3, "before": 0}])]
    low, high, done = pairs.located(blocks, 0.5, 13)
    assert (low, high, done) == (1, 9, False)
    assert pairs.located([(0, [{"d": 1, "upto": 2, "before": 0}, {"d": 5, "upto": 4, "before": 2}])], 0.5, 4) == (pairs._LEAST, 1, True)


def test_an_empty_panel_gives_no_rows(spark):
    left = spark.createDataFrame([("a", 1, [1.0])], "key string, query_id long, v array<double>")
    right = spark.createDataFrame([("a", 1, 1, [1.0])], "key string, reference_id long, weight int, v array<double>")
    assert pairs.summaries(left, right.where("false")).count() == 0 and pairs.summaries(left.where("false"), right).count() == 0


@pytest.mark.parametrize("references", [65_536, 500])
def test_what_leaves_a_task_is_small_and_settled_soon(spark, monkeypatch, references):
    monkeypatch.setattr(pairs, "REFERENCES", references)
    write, tables = pairs.written, []

    def counted(df, label):
        out = write(df, label)
        tables.append((label, out))
        return out

    monkeypatch.setattr(pairs, "written", counted)
    r = np.random.default_rng(7)
    refs, weights, asked = r.normal(size=(5000, 4)), r.integers(1, 4, size=5000), r.normal(size=(20, 4))
    left = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(asked)], "key string, query_id long, v array<double>")
    right = spark.createDataFrame([("a", i, int(w), v.tolist()) for i, (v, w) in enumerate(zip(refs, weights))], "key string, reference_id long, weight int, v array<double>")
    got = {x["query_id"]: x for x in pairs.summaries(left, right).collect()}
    for i, x in got.items():
        d = np.round(np.sqrt(((asked[i] - refs) ** 2).sum(1)), 6)
        assert np.allclose([x[c] for c in ("mean", "p50", "p10", "p90", "least", "most", "panel_size")], brute(d, weights), atol=1.1e-6)
    passes = [sum(len(x["points"]) for x in t.collect()) for label, t in tables if label == "summaries"]
    assert len(got) == 20 and passes[0] <= 20 * (8 if references > 5000 else 10 * 140)
    assert len(passes) <= (1 if references > 5000 else 2)


def test_products_give_the_digits_of_sums(monkeypatch):
    r = np.random.default_rng(4)
    near = r.normal(size=(300, 64)).astype(np.float32).astype(np.float64)
    halves = np.zeros((400, 64))
    halves[:, 0] = np.arange(400) * 1e-6 + 0.5e-6  # between two digits
    for q, c in ((near[:50], near), (near[:50] + 1000, near + 1000), (halves[:3], halves), (np.zeros((2, 64)), np.zeros((3, 64))), (near[:5], near[:5] + 1e-7), (np.zeros((1, 0)), np.zeros((2, 0)))):
        want = np.zeros((len(q), len(c)))
        for k in range(q.shape[1]):
            want += (q[:, k, None] - c[None, :, k]) ** 2
        assert (np.rint(pairs.euclidean(q, c) * 1e6) == np.rint(np.sqrt(want) * 1e6)).all()

"""Scattered pairs beside a large group are all found."""

import numpy as np
import pytest

from driftloom.llm import neighbours


@pytest.mark.parametrize("attempts", [neighbours.ATTEMPTS, 0])
def test_scattered_pairs_beside_a_large_group(spark, monkeypatch, attempts):
    monkeypatch.setattr(neighbours, "ATTEMPTS", attempts)  # 0: all pairs are compared
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    one = unit(r.normal(size=(1500, 64)))
    other = r.normal(size=one.shape)
    other = unit(other - (other * one).sum(1)[:, None] * one)
    c = r.uniform(0.981, 0.99, size=(1500, 1))
    group = unit(unit(r.normal(size=64)) + r.normal(scale=0.01, size=(300, 64)))
    v = np.concatenate([one, c * one + np.sqrt(1 - c * c) * other, group])
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: x["n_links"] for x in neighbours.groups(spark, df).collect()}
    hit = unit(v) @ unit(v).T >= neighbours.THRESHOLD
    true = hit.sum(1) - 1
    wrong = sum(got[i] != true[i] for i in range(len(v)))
    assert wrong <= (0.01 * (true > 0).sum() if attempts else 0)

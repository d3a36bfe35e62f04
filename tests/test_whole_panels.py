"""Panels against choices worked out strain by strain from their definition."""

from datetime import date

import numpy as np
import pytest

from driftloom.operators import panels


def brute(strains, size, outlying=0.25):
    """query_id to reference weight: strains are (query_id, sequence, weight), all of one day."""
    apart = lambda s, t: sum(a != b for a, b in zip(s, t))
    if len(strains) <= size:
        total = sum(w for _, _, w in strains)
        return {i: w / total for i, _, w in strains}
    taken, last = [], min(size - 1, round(size * outlying))
    while len(taken) < size:
        rest = [s for s in strains if s not in taken]
        if not taken:
            pull = {s: s[2] for s in rest}
        else:
            root = len(taken) < size - last
            pull = {s: min(apart(s[1], t[1]) for t in taken) * (s[2] ** 0.5 if root else 1) for s in rest}
        taken.append(max(rest, key=lambda s: (pull[s], s[2], -s[0])))
    mass = dict.fromkeys((t[0] for t in taken), 0.0)
    for s in strains:
        mass[min(taken, key=lambda t: (apart(s[1], t[1]), taken.index(t)))[0]] += s[2]
    return {i: m / sum(mass.values()) for i, m in mass.items()}


def table(spark, strains):
    return spark.createDataFrame([(i, s, date(2019, 12, 1), w) for i, s, w in strains], "query_id long, sequence string, date date, weight double")


@pytest.mark.parametrize(("n", "kept"), [(3, 8), (300, 8), (300, 2), (300, 100)])
def test_panel_takes_the_strains_of_most_pull(spark, monkeypatch, n, kept):
    monkeypatch.setattr(panels, "KEPT", kept)
    r = np.random.default_rng(3)
    strains = [(i, "".join(r.choice(list("ACGT"), 12)), 1.0 + i % 5) for i in range(n)]
    strains[n - 2] = (n - 2, "T" * 12, 90.0)
    cut = spark.createDataFrame([(0, date(2020, 1, 1))], "window_id int, recent_start date")
    got = {x["query_id"]: x["reference_weight"] for x in panels.panel(table(spark, strains), cut, 10).collect()}
    assert got == pytest.approx(brute(strains, 10))


def test_a_large_stratum_is_chosen_from_as_a_whole(spark):
    # the outlying strain comes last of many equal ones
    strains = [(i, "A" * 12, 1.0) for i in range(30_000)] + [(30_000, "A" * 6 + "C" * 6, 1.0)]
    cut = spark.createDataFrame([(0, date(2020, 1, 1))], "window_id int, recent_start date")
    got = {x["query_id"]: x["reference_weight"] for x in panels.panel(table(spark, strains), cut, 6).collect()}
    assert len(got) == 6 and got[0] == pytest.approx(30_000 / 30_001) and got[30_000] == pytest.approx(1 / 30_001)

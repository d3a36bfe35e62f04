"""Panels of several windows: against strain by strain choices, and with each strain held once."""

from datetime import date, timedelta

import numpy as np
import pytest
from test_whole_panels import brute

from driftloom.operators import panels

CUTS = [(w, date(2019 + w // 2, 1 + w % 2 * 6, 1), date(2019 + w // 2, 6 + w % 2 * 6, 30 + w % 2)) for w in range(5)]


def cutoffs(spark):
    return spark.createDataFrame(CUTS, "window_id int, recent_start date, recent_end date")


def half_year(day, start):
    return (day.year - start.year) * 2 + (day.month > 6) - (start.month > 6) + 6


def observed(r, n=900):
    pool = ["".join(r.choice(list("ACGT"), 11)) for _ in range(n // 3)]
    # some strains are seen again and again, in a half-year that is recent for one window and past for another
    return [(int(i), pool[i], date(2016, 1, 1) + timedelta(days=int(r.integers(0, 1600)))) for i in np.minimum(r.integers(0, n // 3, n), r.integers(0, n // 3, n))]


@pytest.mark.parametrize("kept", [1, 32])
def test_past_panels_equal_choices_from_the_observations(spark, monkeypatch, kept):
    monkeypatch.setattr(panels, "KEPT", kept)
    rows = observed(np.random.default_rng(8))
    df = spark.createDataFrame(rows, "query_id long, sequence string, date date").repartition(3)
    got = panels.past_panel(df, cutoffs(spark), 24).collect()
    strata, want = 6, {}
    for w, start, end in CUTS:
        past, now = {}, {i for i, _, d in rows if start <= d <= end}
        for i, s, d in rows:
            if start.replace(year=start.year - 3) <= d < start and i not in now:
                n, last = past.get((i, s), (0, d))
                past[i, s] = (n + 1, max(last, d))
        pools = {}
        for (i, s), (n, last) in past.items():
            pools.setdefault(half_year(last, start), []).append((i, s, float(n), last))
        for t, seats in panels.seats({t: len(p) for t, p in pools.items()}, 24, strata).items():
            # the earlier one among equals: strains in the order of date and id, named by their place
            own = sorted(pools[t], key=lambda x: (x[3], x[0]))
            found = brute([(k, s, n) for k, (_, s, n, _) in enumerate(own)], seats)
            want |= {(w, t, own[k][0]): m for k, m in found.items()}
    assert {(x["window_id"], x["stratum"], x["query_id"]) for x in got} == set(want)
    for w, _, _ in CUTS:
        own = [x for x in got if x["window_id"] == w]
        total = sum(want[w, x["stratum"], x["query_id"]] for x in own)
        assert sum(x["reference_weight"] for x in own) == pytest.approx(1)
        assert [x["reference_weight"] for x in own] == pytest.approx([want[w, x["stratum"], x["query_id"]] / total for x in own])


@pytest.mark.parametrize("kind", ["panel", "past_panel"])
def test_a_strain_is_held_once_and_a_pass_fills_several_seats(spark, monkeypatch, kind):
    held, passes = [], []
    write = panels.written

    def counted(df, label):
        out = write(df, label)
        held.append(out.count())
        return out

    monkeypatch.setattr(panels, "written", counted)
    if hasattr(panels, "_pass"):
        once = panels._pass
        monkeypatch.setattr(panels, "_pass", lambda *a: passes.append(1) or once(*a))
    r = np.random.default_rng(9)
    # one half-year has all strains, so its stratum gets nearly all seats
    rows = [(i, "".join(r.choice(list("ACGT"), 60)), date(2018, 10, 1), 1.0 + i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "query_id long, sequence string, date date, weight double")
    got = getattr(panels, kind)(df, cutoffs(spark), 30)
    assert got.groupBy("window_id").count().where("count = 30").count() == 5
    assert sum(held) == 400 and 0 < len(passes) < 20

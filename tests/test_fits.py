"""Ridge fits from running sums against fits on all earlier rows."""

import numpy as np

from driftloom.operators import fits


def test_sums_of_windows_give_the_fits_of_their_rows(spark):
    r = np.random.default_rng(3)
    rows, columns = [], ("current_share", "escape_excess", "fitness_excess")
    for w in range(7):
        for b in range(4):
            x = [float(r.random()), float(r.normal(50, 3)), float(r.normal(1e5, 10))]
            change = None if w == 6 else 0.3 * x[0] - 0.01 * x[1] + float(r.normal(scale=0.01))
            if (w, b) == (2, 1):
                x[1] = None
            rows.append((w, f"b{b}", *x, change, 0.1))
    # a column that is constant so far
    rows = [(w, b, x, 5.0 if w < 4 and y is not None else y, z, c, n) for w, b, x, y, z, c, n in rows]
    df = spark.createDataFrame(rows, "window_id int, branch string, current_share double, escape_excess double, fitness_excess double, share_change double, next_share double")
    got = {(x["window_id"], x["branch"]): x for x in fits.ridge_share_change(df).collect()}
    for w in range(7):
        train = [x for x in rows if x[0] < w and all(v is not None for v in x[2:6])]
        for x in (x for x in rows if x[0] == w):
            mine = got[w, x[1]]
            assert mine["train_windows"] == w
            if w < 3:
                assert mine["status"] == "too few earlier windows" and mine["predicted"] is None
            elif None in x[2:5]:
                assert mine["predicted"] is None
            else:
                want = fits.ridge(np.array([t[2:5] for t in train]), np.array([t[5] for t in train]), np.array([x[2:5]]), 1.0)[0]
                assert abs(mine["predicted"] - want) < 1e-7 and mine["status"] == "ok"
    assert len(fits.ridge_fits(df, columns, "share_change").collect()) == 7

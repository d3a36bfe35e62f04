"""Every scored row has a rank."""

from driftloom.operators import scores


def test_every_row_is_ranked(spark):
    rows = [("ab"[i % 3 == 0], float(i * 37 % 101), i) for i in range(1000)] + [(None, 1.0, 5000), ("c", None, 5001)]
    df = spark.createDataFrame(rows, "branch string, score double, obs_id long")
    got = {r["obs_id"]: r["rank"] for r in scores.ranked(df, "branch", "score", "obs_id").collect()}
    true = {}
    for b in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == b), key=lambda r: (-(r[1] or 0), r[2]))
        true |= {r[2]: i for i, r in enumerate(own, 1)}
    assert got == true

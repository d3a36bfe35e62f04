"""Mean distances from letter profiles against all pairs, and one record for each accession."""

import random

from driftloom.operators import sequence_tables, strains


def test_profiles_give_the_mean_distance_of_all_pairs(spark):
    r = random.Random(1)
    word = lambda n: "".join(r.choice("ACDé-") for _ in range(n))
    pool = [word(n) for n in (6, 6, 6, 4, 4, 0)]
    later = [(w, r.choice(pool)) for w in (1, 2) for _ in range(40)] + [(1, None)]
    asked = [(w, f"s{i}", r.choice([*pool, word(6)])) for w in (1, 2, 3) for i in range(12)] + [(1, "none", "ACDACDACD"), (1, "null", None)]
    found = strains.later_distance(spark.createDataFrame(asked, "window_id int, strain_id string, sequence string"), spark.createDataFrame(later, "window_id int, sequence string").repartition(4))
    got = {(x["window_id"], x["strain_id"]): (x["compared"], round(x["mean_distance"], 9)) for x in found.collect()}
    want = {}
    for w, name, s in asked:
        own = [t for v, t in later if v == w and s is not None and t is not None and len(t) == len(s)]
        if own:
            want[w, name] = (len(own), round(sum(sum(a != b for a, b in zip(s, t)) for t in own) / len(own), 9))
    assert got == want and len(want) > 20


def test_the_best_record_of_an_accession_stays(spark):
    rows = [("a", 1, 0.5), ("a", 2, 0.9), ("a", 3, 0.9), ("b", 4, None), ("b", 5, 0.1), ("c", 6, None), ("c", 7, None), (None, 8, 1.0), (None, 9, None)]
    df = spark.createDataFrame(rows, "accession string, record int, quality double")
    assert sorted(x["record"] for x in strains.isolates(df, "quality", "record").collect()) == [2, 5, 6, 8, 9]


def test_counts_by_place_equal_letters_one_by_one(spark):
    r = random.Random(2)
    rows = [(r.choice("xy"), "".join(r.choice("AB-\U0001f600") for _ in range(r.randrange(7)))) for _ in range(300)] + [("x", None), (None, "AB")]
    df = spark.createDataFrame(rows, "g string, sequence string")
    want = {}
    for g, s in rows:
        for k, c in enumerate(s or ""):
            want[g, k, c] = want.get((g, k, c), 0) + 1
    got = {(x["g"], x["pos"], x["letter"]): x["n"] for x in strains.position_counts(df, ["g"], "sequence").collect()}
    assert got == want
    best = {x["g"]: x["consensus"] for x in sequence_tables.consensus(df.where("g is not null"), "g").collect()}
    for g in "xy":
        places = sorted({k for h, k, c in want if h == g and c != "-"})
        assert best[g] == "".join(min((c for h, p, c in want if h == g and p == k and c != "-"), key=lambda c: (-want[g, k, c], c)) for k in places)


def test_no_row_is_made_for_a_letter_of_a_strain(spark, monkeypatch):
    monkeypatch.setattr(strains, "LETTERS", 300, raising=False)  # several blocks
    r = random.Random(3)
    word = lambda: "".join(r.choice("ACD") for _ in range(9))
    asked, later = [(1, i, word(), i % 4) for i in range(100)], [(1, word()) for _ in range(50)]
    found = strains.later_distance(spark.createDataFrame(asked, "window_id int, strain_id long, sequence string, more int"), spark.createDataFrame(later, "window_id int, sequence string"))
    assert "posexplode" not in found._jdf.queryExecution().toString()
    for x in found.collect():
        want = sum(sum(a != b for a, b in zip(asked[x["strain_id"]][2], t)) for _, t in later) / 50
        assert (x["compared"], x["more"], round(x["mean_distance"], 9)) == (50, x["strain_id"] % 4, round(want, 9))
    assert found.count() == 100

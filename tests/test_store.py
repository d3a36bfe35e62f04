"""Versions of a score table, and joins whose checks no later step takes out."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import joins
from driftloom.sources.store import Moved, ScoreStore, striped
from driftloom.streaming import bins


def rows(spark, held):
    return spark.createDataFrame(held, "cutoff string, query long, score double, at long")


def opened(spark, path, **more):
    return ScoreStore(spark, f"file://{path}", ["cutoff", "query"], "at", buckets=4, **more)


def content(store, version=None):
    return sorted(map(tuple, store.read(version).select("cutoff", "query", "score", "at").collect()))


def test_two_batches_of_one_cutoff_keep_both(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    assert store.version() == 0
    store.upsert(rows(spark, [("a", i, float(i), 1) for i in range(20)]))
    store.upsert(rows(spark, [("a", i, -1.0, 2) for i in range(10, 30)] + [("a", 3, 99.0, 0)]))
    want = sorted([("a", i, float(i), 1) for i in range(10)] + [("a", i, -1.0, 2) for i in range(10, 30)])
    assert content(store) == want
    again = store.upsert(rows(spark, [("a", i, -1.0, 2) for i in range(10, 30)]))
    assert content(store) == want and content(store, 1) == sorted(("a", i, float(i), 1) for i in range(20))
    assert again == 3 and store.upsert(rows(spark, [])) == 3


def test_rows_of_one_batch_that_share_a_key(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    store.upsert(rows(spark, [("a", 1, 1.0, 5), ("a", 1, 2.0, 7), ("a", 1, 3.0, None)]))
    assert content(store) == [("a", 1, 2.0, 7)]
    with pytest.raises(ValueError, match="no key"):
        store.upsert(rows(spark, [("a", None, 1.0, 5)]))


def test_seeds_and_guarded_updates(spark, tmp_path):
    store = opened(spark, tmp_path / "s")
    store.seed(rows(spark, [("a", 1, None, None), ("a", 2, 4.0, 1)]))
    store.seed(rows(spark, [("a", 2, None, None), ("b", 2, None, None)]))
    store.update(rows(spark, [("a", 1, 5.0, 2), ("a", 2, 5.0, 2), ("z", 9, 5.0, 2)]), lambda old, new: old["score"].isNull())
    assert content(store) == [("a", 1, 5.0, 2), ("a", 2, 4.0, 1), ("b", 2, None, None)]


def test_a_writer_that_is_killed_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = opened(spark, tmp_path / "s")
    store.upsert(rows(spark, [("a", 1, 1.0, 1)]))

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ScoreStore, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        store.upsert(rows(spark, [("a", 1, 2.0, 2)]))
    monkeypatch.undo()
    assert store.version() == 1 and content(store) == [("a", 1, 1.0, 1)]


def test_a_writer_that_comes_second_merges_again(spark, tmp_path, monkeypatch):
    store, other = opened(spark, tmp_path / "s"), opened(spark, tmp_path / "s")
    store.upsert(rows(spark, [("a", 1, 1.0, 1)]))
    publish, met = ScoreStore._publish, []

    def late(self, version, pointer):
        if self is store and not met:
            met.append(version)
            other.upsert(rows(spark, [("a", 2, 2.0, 1)]))
        publish(self, version, pointer)

    monkeypatch.setattr(ScoreStore, "_publish", late)
    assert store.upsert(rows(spark, [("a", 3, 3.0, 1)])) == 3 and met == [2]
    assert [r[1] for r in content(store)] == [1, 2, 3]
    with pytest.raises(Moved):
        publish(store, 3, {})


def test_other_parameters_are_refused(spark, tmp_path):
    opened(spark, tmp_path / "s", parameters={"model": "x", "mask": True}).upsert(rows(spark, [("a", 1, 1.0, 1)]))
    opened(spark, tmp_path / "s", parameters={"model": "x", "mask": True})
    with pytest.raises(ValueError, match="mask"):
        opened(spark, tmp_path / "s", parameters={"model": "x", "mask": False})


def test_a_stream_keeps_the_scores_of_earlier_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text("".join(f'{{"cutoff": "a", "query": {k}, "score": {i}, "at": {i}}}\n' for k in (i, 10)))
    source = spark.readStream.schema("cutoff string, query long, score double, at long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    store = opened(spark, tmp_path / "s")
    bins.ingest_scores(source, store).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert content(store) == [("a", 0, 0.0, 0), ("a", 1, 1.0, 1), ("a", 2, 2.0, 2), ("a", 10, 2.0, 2)]


def test_pending_work_goes_round_the_workers_in_order(spark):
    df = spark.range(0, 100).select((F.col("id") * 37 % 101).alias("k"))
    got = sorted(tuple(r) for r in striped(df, ["k"], 7).select("k", "place", "worker").collect())
    assert [(p, w) for _, p, w in got] == [(i, i % 7) for i in range(100)]


@pytest.mark.parametrize("act", [lambda d: d.count(), lambda d: d.select("k").collect(), lambda d: d.agg(F.count("*")).collect()])
def test_checks_stay_when_their_columns_are_not_read(spark, act):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    right = spark.createDataFrame([(1, "a", 3)], "k long, x string, y long")
    for found in (joins.complete_join(left, right.drop("x"), ["k"], "y"), joins.complete_join(left, right.drop("x"), ["k"])):
        with pytest.raises(Exception, match="no partner"):
            act(found)
    with pytest.raises(Exception, match="disagree"):
        act(joins.agreeing_join(left.where("k = 1").withColumn("x", F.lit("z")), right, ["k"], ["x"]))
    with pytest.raises(ValueError, match="no partner"):
        joins.complete_join(left, right, ["k"], "y", at_once=True)
    assert act(joins.complete_join(left.where("k = 1"), right.drop("x"), ["k"], "y"))


def test_a_key_stands_for_one_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("b", None)], "k string, v string")
    assert sorted(map(tuple, joins.one_value_each(df, "k", "v").collect())) == [("a", "x"), ("b", None)]
    with pytest.raises(Exception, match="two values"):
        joins.one_value_each(df.union(spark.createDataFrame([("a", "y")], "k string, v string")), "k", "v").count()


def test_given_half_years_are_each_there_once(spark):
    from datetime import date

    from driftloom.plans import windows

    found = windows.given(spark, [date(2021, 1, 1), date(2020, 7, 1), date(2021, 1, 1)]).orderBy("window_id").collect()
    assert [tuple(r) for r in found] == [(0, date(2020, 7, 1), date(2020, 12, 31)), (1, date(2021, 1, 1), date(2021, 6, 30))]


def test_references_are_frozen_before_each_cutoff(spark):
    from datetime import date

    refs = spark.createDataFrame([("p", 1, "H1N1", "2019-05-01"), ("p", 1, " h1n1 ", "2019-03-01"), ("q", 2, "H3N2", "2018-01-01"), ("r", 3, "H1N1", "2019-13-01"), ("s", 9, "H1N1", "2018-01-01"), ("t", 1, "H1N1", "2020-01-01")], "k string, embedding_id int, subtype string, reference_date string")
    cuts = spark.createDataFrame([(0, date(2019, 3, 1)), (1, date(2020, 1, 1)), (2, date(2020, 1, 2))], "window_id int, forecast_cutoff date")
    held = spark.createDataFrame([(1,), (1,), (2,), (3,)], "embedding_id int")
    found = joins.references_before(refs, cuts, ["k"], held, "H1N1")
    assert sorted((r["window_id"], r["k"], r["reference_date"]) for r in found.collect()) == [(1, "p", date(2019, 3, 1)), (2, "p", date(2019, 3, 1)), (2, "t", date(2020, 1, 1))]

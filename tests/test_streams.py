"""Streams with late and repeated rows over several batches, and restarts from their checkpoints."""

import json
import os
from datetime import date

import pytest

from driftloom.streaming import bins, work

DAY = "2020-01-{:02d}T{:02d}:00:00"


def put(folder, i, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{i:02d}.json"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(path, (1_600_000_000 + i, 1_600_000_000 + i))  # files are read in this order


def ran(spark, df, tmp_path, schema):
    """What a query adds to its sink until it has read all files there are."""
    q = df.writeStream.outputMode("append").format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"file://{tmp_path}/out").collect()


def test_bins_are_final_once_the_watermark_passes(spark, tmp_path):
    events = lambda ids, day, hour=1: [{"id": i, "t": DAY.format(day, hour), "b": "x"} for i in ids]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("id long, t timestamp, b string").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    counts = bins.stream_bins(source, "t", "b", date(2020, 1, 1), 7, "2 days", "id")
    schema = "bin_start date, branch string, n long"
    put(tmp_path / "in", 0, events([1, 2, 3], 2))
    put(tmp_path / "in", 1, events([3, 4], 2) + events([5], 9))  # 3 comes again; the watermark is at the 7th
    put(tmp_path / "in", 2, events([6], 5) + events([7], 8))  # 6 is later than the watermark, but its week isn't over
    assert [tuple(r) for r in ran(spark, counts, tmp_path, schema)] == []
    put(tmp_path / "in", 3, events([8], 12))  # the first week ends at the 8th, the watermark is at the 10th
    put(tmp_path / "in", 4, events([9], 13) + events([10], 3))  # 10 would fall in the week that is done
    got = sorted(tuple(r) for r in ran(spark, counts, tmp_path, schema))
    assert got == [(date(2020, 1, 1), "x", 5)]
    put(tmp_path / "in", 5, events([11], 25))
    put(tmp_path / "in", 6, events([12], 26))
    got = sorted(tuple(r) for r in ran(spark, counts, tmp_path, schema))
    assert got == [(date(2020, 1, 1), "x", 5), (date(2020, 1, 8), "x", 4)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_work_is_pending_taken_done_or_timed_out(spark, tmp_path, rocks):
    n = iter(range(1000))
    e = lambda key, event, hour, worker=None, score=None, day=1, i=None: {"event_id": next(n) if i is None else i, "key": key, "event": event, "worker": worker, "score": score, "at": DAY.format(day, hour)}
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("event_id long, key string, event string, worker string, score double, at timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    changes = work.queue(source, "1 hour", 2 * 3_600_000, 100 * 3_600_000)
    schema = "key string, state string, worker string, score double, attempts int, at timestamp"
    put(tmp_path / "in", 0, [e("a", "seed", 1), e("b", "seed", 1), e("a", "take", 2, "w1", i=500), e("c", "seed", 1)])
    put(tmp_path / "in", 1, [e("a", "take", 2, "w1", i=500), e("a", "done", 3, "w1", 0.5), e("b", "take", 3, "w2"), e("b", "seed", 3)])
    got = sorted((r["key"], r["at"].hour, r["state"]) for r in ran(spark, changes, tmp_path, schema))
    assert got == [("a", 1, "pending"), ("a", 2, "taken"), ("a", 3, "done"), ("b", 1, "pending"), ("b", 3, "taken"), ("c", 1, "pending")]
    # after a restart the state is there: b times out, is taken again and done; a stays done, its second score doesn't count
    put(tmp_path / "in", 2, [e("c", "take", 9, "w3")])
    put(tmp_path / "in", 3, [e("a", "done", 9, "w9", 9.0), e("b", "take", 9, "w3")])
    put(tmp_path / "in", 4, [e("b", "done", 10, "w3", 0.25), e("c", "done", 1, "w9", 7.0)])  # the last is later than the watermark
    rows = ran(spark, changes, tmp_path, schema)
    b = [(r["state"], r["worker"], r["score"], r["attempts"]) for r in sorted(rows, key=lambda r: (r["at"], r["state"] != "timed out")) if r["key"] == "b"]
    assert b == [("pending", None, None, 0), ("taken", "w2", None, 1), ("timed out", "w2", None, 1), ("taken", "w3", None, 2), ("done", "w3", 0.25, 2)]
    assert [r["score"] for r in rows if r["key"] == "a" and r["state"] == "done"] == [0.5]
    assert [r["state"] for r in rows if r["key"] == "c"] == ["pending", "taken"]

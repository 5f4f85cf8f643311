"""The live sink against the rules of its windows: late rows, repeated batches, restarts, far clocks."""

import hashlib
import os

from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.streaming import live

GRID = [(0.0, 0.0), (1.0, 10.0)]
SCHEMA = "sensor string, t0 double, score double, percentile double, key long"
FRAMES = [
    [("s", 5.0, 9.9, 0.99, 1), ("s", 8.0, 1.0, 0.1, 2), ("z", 3.0, 1.0, 0.1, 3)],
    [("s", 12.0, 1.0, 0.1, 4), ("s", 9.0, 1.0, 0.1, 5)],
    [("s", 6.0, 9.8, 0.98, 6), ("s", 25.0, 1.0, 0.1, 7), ("z", 4.0, 1.0, 0.1, 8)],
    [("s", 3.0, 1.0, 0.1, 9), ("s", 26.0, 1.0, 0.1, 10), ("s", 1e9, 1.0, 0.1, 11)],
    [("s", 27.0, 1.0, 0.1, 12), ("z", 30.0, 1.0, 0.1, 13)],
]


def walk(frames, seconds=10):
    """Rows that end in the pool, and rows that came late."""
    closed, held, pool, late = set(), {}, set(), 0
    for rows in frames:
        tops = {}
        for s, t, *_, key in rows:
            b = (s, int(t // seconds))
            tops[s] = max(tops.get(s, b[1]), b[1])
            if b in closed:
                late += 1
            else:
                held.setdefault(b, set()).add(key)
        for b in [b for b in held if b[1] < tops.get(b[0], b[1])]:
            closed.add(b)
            pool |= held.pop(b)
    return pool, late, set().union(*held.values())


def keys(spark, sink):
    return sorted(r["key"] for r in spark.read.parquet(f"{sink.path}/pool/windows").select("key").collect())


def test_frames_late_rows_and_repeats(spark, tmp_path):
    sink = live.LiveSink(str(tmp_path / "live"), None, GRID, seconds=10)
    for i, rows in enumerate(FRAMES):
        for _ in range(1 + (i % 2)):  # a repeated batch, by a sink that was started anew
            sink = live.LiveSink(str(tmp_path / "live"), None, GRID, seconds=10)
            sink.take(spark.createDataFrame(rows, SCHEMA), i)
    pool, late, waiting = walk(FRAMES)
    assert keys(spark, sink) == sorted(pool)
    assert sink.late(spark).agg(F.sum("n")).first()[0] == late == 3
    alerts = spark.read.parquet(str(tmp_path / "live/alerts"))
    assert sorted(r["key"] for r in alerts.collect()) == [1, 6]  # that of a late row is kept
    sink.finish(spark)
    assert keys(spark, sink) == sorted(pool | waiting)
    assert sink.state(spark).filter("kind = 'open'").count() == 0


def test_no_batch_reads_old_frames(spark, tmp_path):
    sink = live.LiveSink(str(tmp_path / "live"), None, GRID, seconds=10)
    for i in range(3):
        sink.take(spark.createDataFrame([("s", 10.0 * i + 1, 1.0, 0.1, i)], SCHEMA), i)
    assert not os.listdir(tmp_path / "live/frames")
    assert sorted(os.listdir(tmp_path / "live/state")) == ["frame=1", "frame=2"]
    waiting = [d for d in os.listdir(tmp_path / "live/open") if d.startswith("bucket=")]
    assert sorted(waiting) == ["bucket=1", "bucket=2"]


def test_closed_windows_are_forgotten_below_a_floor(spark, tmp_path):
    sink = live.LiveSink(str(tmp_path / "live"), None, GRID, seconds=10, keep=2)
    for i, t in enumerate((5.0, 25.0, 45.0, 5.0, 1.0)):
        sink.take(spark.createDataFrame([("s", t, 1.0, 0.1, i)], SCHEMA), i)
    assert sink.late(spark).first()["n"] == 2
    assert sink.state(spark).filter("kind = 'closed'").agg(F.min("bucket")).first()[0] >= 2


def test_pool_index_tells_files(spark, tmp_path):
    rows = spark.createDataFrame([("s", "flow", 1, "w1", 2.0), ("s", "flow", 1, "w1", 4.0), ("s", "flow", 2, "w2", 3.0)], "sensor string, visao string, bucket long, window_id string, t0 double")
    assert sinks.write_pool(rows, str(tmp_path / "pool")).count() == 2
    assert sinks.write_pool(rows, str(tmp_path / "pool")).count() == 0
    index = {r["window_id"]: r for r in spark.read.parquet(str(tmp_path / "pool/index")).collect()}
    for w, n, b in (("w1", 2, 1), ("w2", 1, 2)):
        folder = tmp_path / f"pool/windows/sensor=s/visao=flow/bucket={b}"
        data = next(folder.glob("*.parquet")).read_bytes()
        assert (index[w]["n_rows"], index[w]["parquet_bytes"], index[w]["sha256"]) == (n, len(data), hashlib.sha256(data).hexdigest())
        assert (index[w]["t_start"], index[w]["t_end"], index[w]["path"]) == (b * 780, (b + 1) * 780, str(folder))

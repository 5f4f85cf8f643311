"""Chained starts, sessions and late rows against row-by-row versions of their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, flows, windows
from tidemark.schemas import PACKET

FAR = float("inf")


@pytest.fixture()
def tiny_batches(spark):
    """Arrow batches of seven rows, so that blocks run over several of them."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def walk(rows, span, idle):
    by = {}
    for k, t in rows:
        by.setdefault(k, []).append(t)
    out = []
    for k, times in by.items():
        start = before = None
        for t in sorted(times):
            if start is None or t - start >= span or t - before > idle:
                start = t
                out.append([k, start, t, 0])
            out[-1][2], out[-1][3], before = t, out[-1][3] + 1, t
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("span, idle, spans, width", [(10.0, FAR, 1, None), (10.0, 3.0, 2, None), (FAR, 4.0, 1, None), (7.5, 2.0, 4096, None), (10.0, 5.0, 1, 3.0)])
def test_chains_match_a_walk(spark, tiny_batches, seed, span, idle, spans, width):
    rng = np.random.default_rng(seed)
    steps = rng.exponential(1.5, 300) * (rng.random(300) < 0.9) + (rng.random(300) < 0.03) * 40
    times = np.round(np.cumsum(steps) if seed else rng.uniform(0, 300, 300), 1)
    rows = [((None, "a", "b")[rng.integers(3)], float(t)) for t in times]
    df = spark.createDataFrame([*rows, ("a", None)], "k string, ts double").repartition(3)
    got = chains.chain_starts(df, ["k"], span=span, idle=idle, spans=spans, width=width)
    assert sorted(map(tuple, got.collect()), key=repr) == walk(rows, span, idle)


def test_chain_of_nothing(spark):
    none = spark.createDataFrame([], "k string, ts double")
    assert chains.chain_starts(none, ["k"], span=1.0).count() == 0


def test_active_timeout_counts_from_the_packet_that_passes_it(spark):
    p = spark.createDataFrame([(float(t), "a", "b", 17, 10, None, None, "") for t in (0, 100, 130, 240, 260, 370, 381)], PACKET)
    got = flows.active_sessions(p, idle=120.0, active=120.0).orderBy("t0").collect()
    assert [(r["t0"], r["t1"], r["n_packets"]) for r in got] == [(0, 100, 2), (130, 240, 2), (260, 370, 2), (381, 381, 1)]
    made = flows.extracted_flows(p, idle=120.0, active=120.0, grain=50.0).orderBy("bidirectional_first_seen_ms").collect()
    assert [(r["bidirectional_packets"], r["bidirectional_duration_ms"], r["bidirectional_mean_piat_ms"]) for r in made] == [(2, 1e5, 1e5), (2, 1.1e5, 1.1e5), (2, 1.1e5, 1.1e5), (1, 0, 0)]


def walk_late(rows):
    late = set()
    for s in {r[0] for r in rows}:
        closed, waiting = set(), set()
        for f in sorted({r[1] for r in rows if r[0] == s}):
            held = {r[2] for r in rows if r[:2] == (s, f)}
            late |= {(s, f, b) for b in held & closed}
            waiting |= held - closed
            shut = {b for b in waiting if b < max(held)}
            closed, waiting = closed | shut, waiting - shut
    return late


@pytest.mark.parametrize("fan", [512, 3])
def test_late_rows_match_a_walk_and_jumps_cost_nothing(spark, fan):
    rng = np.random.default_rng(4)
    rows = [(f"s{rng.integers(2)}", int(f), int(b)) for f, b in zip(rng.integers(0, 60, 150), rng.integers(0, 30, 150))]
    rows += [("s0", 30, 10**9), ("s1", 61, 3 * 10**18)]
    got = windows.late_rows(spark.createDataFrame(rows, "sensor string, frame int, bucket long"), fan=fan)
    assert {tuple(r)[:3] for r in got.filter("late").collect()} == walk_late(rows)
    assert windows.late_rows(spark.createDataFrame([], "sensor string, frame int, bucket long"), fan=fan).count() == 0


def test_anchored_windows_have_no_task_per_sensor(spark, monkeypatch):
    times = spark.range(200).select((F.col("id") * 3).cast("double").alias("ts"), F.lit("s").alias("sensor"))
    whole, cut = (windows.anchored_windows(times, 10.0, spans=n).orderBy("w_start").collect() for n in (4096, 2))
    assert whole == cut and [r["w_start"] for r in whole[:3]] == [0.0, 12.0, 24.0]

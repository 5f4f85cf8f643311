"""Declared invariants, and schedules by time cell and address."""

import numpy as np

from tidemark.operators import labels, rules


def test_null_is_no_violation_and_missing_columns_are_told(spark):
    v = spark.createDataFrame([(1, None, None), (2, 1, 9), (3, 1, 3), (4, 4, None)], "verdict_id int, supersedes int, confianca int")
    got = {r["rule"]: r["n"] for r in rules.violations({"verdicts": v}).collect()}
    assert got == {"verdict_word": None, "confidence_range": 1, "no_self_chain": 1, "verdict_key": 0, "linear_chain": 1, "chain_target": 0}
    assert [(r["verdict_id"], r["broken"]) for r in rules.broken_rows(v, "verdicts").orderBy("verdict_id").collect()] == [(2, ["confidence_range"]), (4, ["no_self_chain"])]
    assert rules.violations({"verdicts": v.limit(0)}).filter("n > 0").count() == 0


def test_long_schedule_is_looked_up_by_cell_and_address(spark):
    rng = np.random.default_rng(6)
    ip = lambda: f"10.0.0.{rng.integers(25)}"
    entries = []
    for i in range(10_000):
        start = float(rng.integers(0, 400_000))
        entries.append((i, start, start + float(rng.integers(0, 9000)), f"e{i}", [ip() for _ in range(rng.integers(1, 3))], [ip() for _ in range(rng.integers(0, 4))]))
    schedule = spark.createDataFrame(entries, "pos int, start double, stop double, name string, attackers array<string>, victims array<string>")
    flows = [(i, float(rng.integers(0, 410_000)), ip(), ip() if i % 20 else None) for i in range(120)]
    df = labels.label_flows(spark.createDataFrame(flows, "id int, t0 double, src string, dst string"), schedule)
    for r in df.collect():
        want = None
        for _, start, stop, name, att, vic in entries:
            one, two = (r["src"] in att and (not vic or r["dst"] in vic)), (r["dst"] in att and (not vic or r["src"] in vic))
            if start <= r["t0"] <= stop and (one or two):
                want = name
                break
        assert r["attack"] == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

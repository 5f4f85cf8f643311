"""Exact k-means against full comparison in integers."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import centroids


def brute(rows, k=8, rounds=10, size=64, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, np.floor(1024 * np.array(v, float)).astype(np.int64)))
    kept.sort(key=lambda p: (hashlib.sha256(f"{seed}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1].tolist()))
    points = np.array([v for _, v in kept])
    now = points[:k].copy()
    for _ in range(rounds):
        near = ((points[:, None] - now[None]) ** 2).sum(2).argmin(1)
        for j in range(len(now)):
            own = points[near == j]
            if len(own):
                now[j] = [int(t) // len(own) for t in own.sum(0)]
    gaps = ((points[:, None] - now[None]) ** 2).sum(2)
    return sorted(((i, int(j), int(d)) for (i, _), j, d in zip(kept, gaps.argmin(1), gaps.min(1))), key=repr), now


def vectors(n, size, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, size)) * spread
    return [(i, (middle[rng.integers(9)] + rng.normal(size=size) * 0.1).tolist()) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "ties", "few", "repeats", "grid"])
def test_matches_full_comparison(spark, case):
    size = 4 if case in ("ties", "grid") else 64
    rows = vectors(400, size, 1)
    if case == "ties":
        rows = [(i, [0.25 * (i % 3), 0.5 * (i % 2), 0.0, -0.001 * (i % 5)]) for i in range(300)]
    if case == "grid":
        rows = [(i, [float(i % 4), float(i // 4 % 4), float(i // 16 % 4), 0.0]) for i in range(256)]
    if case == "few":
        rows = rows[:5]
    if case == "repeats":
        rows = rows[:60] + [(7, rows[7][1])] * 200 + [(8, [0.5] * 64)] * 3 + [(None, rows[9][1])]
    bad = [(900, None), (901, [0.1] * (size - 1)), (902, [float("nan")] * size), (903, [None] + [0.1] * (size - 1)), (904, [float("inf")] * size), (905, [])]
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], "vec_id long, embedding array<double>, cluster string, block int").repartition(4)
    found, now = centroids.cluster(table, k=8, size=size)
    want, middle = brute(rows + bad, size=size)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=repr) == want
    assert now.tolist() == middle.tolist()


def test_report_and_empty_table(spark):
    table = spark.createDataFrame(vectors(50, 64, 2), "vec_id long, embedding array<float>")
    got = centroids.cluster_report(table).collect()
    assert {r["inertia"] for r in got} == {sum(r["distance"] for r in got)}
    for j in {r["cluster"] for r in got}:
        own = [r for r in got if r["cluster"] == j]
        assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)} and len({r["centroid_sha256"] for r in own}) == 1
    assert centroids.cluster_report(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="2\\^27"):
        centroids.cluster_report(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>"))


def test_search_agrees_and_saves_distances():
    points = np.floor(1024 * np.array([v for _, v in vectors(3000, 16, 4, spread=1.5)])).astype(np.int64)
    now = points[:8].copy()
    state = centroids.first_search(points, now)
    taken = []
    for _ in range(12):
        before, now = now, now.copy()
        for j in range(8):
            own = points[state["near"] == j]
            if len(own):
                now[j] = [int(t) // len(own) for t in own.sum(0)]
        state, n = centroids.shallot(points, state, centroids.Centroids(now, before))
        taken.append(n)
        gaps = ((points[:, None] - now[None]) ** 2).sum(2)
        assert (state["near"] == gaps.argmin(1)).all()
        exact = np.sqrt(np.sort(gaps, axis=1).astype(float))
        assert (state["upper"] >= exact[:, 0]).all() and (state["lower"] <= exact[:, 1]).all()
    assert taken[-1] < 0.1 * 8 * len(points)


def test_rounds_join_without_shuffle(spark):
    tables = centroids._Bucketed(spark, 4)
    blocks = tables.write(spark.range(40).selectExpr("id AS block", "1 AS n", "CAST('v' AS BINARY) AS vectors"), "blocks")
    state = tables.write(spark.range(40).selectExpr("id AS block", "CAST('s' AS BINARY) AS state"), "bounds")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = centroids._assign(spark.table(blocks), spark.table(state), np.zeros((2, 4), np.int64), None)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    tables.drop(blocks)
    tables.drop(state)

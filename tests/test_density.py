"""Density clustering against comparison of all pairs."""

import numpy as np
import pytest

from tidemark.operators import density


def brute(points, eps, min_rows):
    ids, x = list(points), np.array(list(points.values()), float)
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps**2
    core = near.sum(1) >= min_rows
    name = {i: None for i in range(len(ids))}
    for i in sorted(np.flatnonzero(core), key=lambda i: ids[i]):
        if name[i] is None:
            todo, seen = [i], {i}
            while todo:
                at = todo.pop()
                for j in np.flatnonzero(near[at] & core):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            for j in seen:
                name[j] = min(ids[k] for k in seen)
    for i in np.flatnonzero(~core):
        name[i] = min((name[j] for j in np.flatnonzero(near[i] & core)), default=None)
    return {ids[i]: (bool(core[i]), name[i]) for i in range(len(ids))}


@pytest.mark.parametrize("case", ["blobs", "grid", "copies", "three"])
def test_matches_all_pairs(spark, case, monkeypatch):
    rng = np.random.default_rng(3)
    dims, eps, k = 2, 0.5, 5
    if case == "blobs":
        x = np.concatenate([rng.normal((0, 0), 0.4, (120, 2)), rng.normal((1.6, 0.3), 0.25, (80, 2)), rng.uniform(-3, 4, (60, 2))])
    elif case == "grid":  # distances equal to eps, rows on the edges of cells
        x = np.array([(i * 0.5, j * 0.5) for i in range(8) for j in range(8) if (i + j) % 5])
    elif case == "copies":
        x = np.concatenate([np.tile([[0.1, 0.1]], (60, 1)), np.tile([[0.55, 0.1]], (3, 1)), np.tile([[1.0, 0.1]], (30, 1)), np.tile([[1.6, 0.1]], (30, 1)), [[0.6, 0.59]]])
        monkeypatch.setattr(density, "PART_ROWS", 7)
    else:
        dims, x = 3, rng.normal(0, 0.8, (150, 3))
    points = {int(i): tuple(map(float, p)) for i, p in zip(rng.permutation(len(x)) + 10, x)}
    cols = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(-1, *[None] * dims)], "row long, " + ", ".join(f"{c} double" for c in cols))
    got = {r["row"]: (r["core"], r["cluster"]) for r in density.dbscan(df, cols, "row", eps, k).collect()}
    assert got == brute(points, eps, k)


def test_empty(spark):
    assert density.dbscan(spark.createDataFrame([], "row long, a double, b double"), ["a", "b"], "row").count() == 0


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, density.staged

    def spied(df, what):
        plans.setdefault(what, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, what)

    monkeypatch.setattr(density, "staged", spied)
    x = np.random.default_rng(5).uniform(0, 3, (400, 2))
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "row long, a double, b double")
    density.dbscan(df, ["a", "b"], "row", 0.4, 5).count()
    for what in ("cell-pairs", "open-pairs", "boxes", "links", "cells"):
        assert plans[what] and not any("BroadcastHashJoin" in p for p in plans[what]), what

"""Principal axes and kernel models against dense linear algebra."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import subspace

rng = np.random.default_rng(8)
X = rng.normal(size=(300, 4)) @ np.diag([5, 2, 0.4, 0.1]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0] + [10, -4, 0, 2]
COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id int, " + ", ".join(f"{c} double" for c in COLS)).repartition(5)


@pytest.mark.parametrize("scale", [True, False])
def test_axes_match_decomposition(spark, table, scale):
    axes = subspace.fit_axes(table, COLS, 0.95, scale)
    z = (X - X.mean(0)) / (X.std(0) if scale else 1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    shares = s**2 / (s**2).sum()
    assert np.allclose(axes.shares, shares)
    assert axes.kept == int(np.searchsorted(np.cumsum(shares), 0.95, side="right")) + 1
    for mine, theirs in zip(np.array(axes.loadings), vt):
        assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-6) and mine[np.argmax(np.abs(mine))] > 0
    placed = subspace.on_axes(table, axes, 2).orderBy("id").select("coord_x", "coord_y").collect()
    assert np.allclose(np.array(placed), z @ np.array(axes.loadings[:2]).T)
    assert len([c for c in subspace.on_axes(table, axes).columns if c.startswith("coord_")]) == axes.kept
    ranked = subspace.axis_loadings(spark, axes).filter("component = 1").orderBy("place").collect()
    assert [abs(r["loading"]) for r in ranked] == sorted((abs(v) for v in axes.loadings[0]), reverse=True)


def test_axes_of_constant_and_empty_columns(spark, table):
    assert subspace.fit_axes(table.withColumn("a", F.lit(1.0)), COLS).shares[-1] == 0
    assert subspace.fit_axes(table.limit(0), COLS).shares == (0.0,) * 4


def kernel(x, y, gamma):
    return np.exp(-gamma * ((x[:, None] - y[None]) ** 2).sum(2))


def test_features_approach_their_kernels(table):
    z = (X - X.mean(0)) / X.std(0)
    made = subspace.gaussian_features(table, COLS, gamma=0.25, count=1024)
    got = np.array([r["f"] for r in table.orderBy("id").select(made.array().alias("f")).collect()])
    error = np.abs(got @ got.T - kernel(z, z, 0.25))
    assert error.mean() < 0.03 and error.max() < 0.17
    exact = subspace.polynomial_kernel_features(table, COLS, 3, 0.25, 1.0)
    got = np.array([r["f"] for r in table.orderBy("id").select(exact.array().alias("f")).collect()])
    assert np.allclose(got @ got.T, (0.25 * z @ z.T + 1) ** 3)


def test_ridge_matches_exact_kernel_ridge(spark, table):
    z = (X - X.mean(0)) / X.std(0)
    y = np.sin(z[:, 0]) + 0.3 * z[:, 1] ** 2
    rows = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(X, y))], "id int, " + ", ".join(f"{c} double" for c in COLS) + ", y double")
    poly = subspace.polynomial_kernel_features(rows, COLS, 2)
    k = (z @ z.T / 4 + 1) ** 2
    want = k @ np.linalg.solve(k + 0.5 * np.eye(len(y)), y)
    got = [r["v"] for r in rows.withColumn("v", subspace.kernel_ridge(rows, poly, "y", 0.5).value()).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-6)
    k = kernel(z, z, 0.25)
    want = k @ np.linalg.solve(k + 0.5 * np.eye(len(y)), y)
    near = subspace.kernel_ridge(rows, subspace.gaussian_features(rows, COLS, 0.25, count=512), "y", 0.5)
    got = np.array([r["v"] for r in rows.withColumn("v", near.value()).orderBy("id").collect()])
    assert np.abs(got - want).mean() < 0.05 * y.std()


def test_kernel_values_run_on_blocks(table):
    """every feature of every row was an interpreted lambda, some 60 microseconds a row with 64 features."""
    made = subspace.gaussian_features(table, COLS, count=600)
    model = subspace.KernelModel(made, tuple(np.linspace(-1, 1, 600).tolist()), 0.5)
    got = table.repartition(1).select("id", made.array().alias("f"), model.value().alias("v"))
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.unionAll(got).unionAll(got).orderBy("id").collect()
    assert len(rows) == 900 and all(len(r["f"]) == 600 for r in rows)
    assert np.allclose([r["v"] for r in rows], np.array([r["f"] for r in rows]) @ model.weights + 0.5)
    assert got.filter("id < 0").collect() == []


@pytest.mark.parametrize("rows_at_once", [1, subspace.BLOCK, subspace.BLOCK + 1, 0])
def test_ridge_over_batches_of_any_size(spark, rows_at_once):
    """Batches that are smaller and larger than a block; nulls and non-finite columns are 0, rows without a label unknown, no rows give zero weights."""
    n = 40 if rows_at_once == 1 else 2 * subspace.BLOCK + 3
    odd = [None, float("nan"), float("inf"), 2.0, -1.0, 0.5]
    data = [(i, odd[i % 6], float(i % 7), None if i % 11 == 0 else float(i % 5)) for i in range(n)]
    rows = spark.createDataFrame(data, "id int, a double, b double, y double").repartition(2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        made = subspace.gaussian_features(rows, ["a", "b"], count=8)
        model = subspace.kernel_ridge(rows, made, "y", 0.5)
        none = subspace.kernel_ridge(rows.filter("y IS NULL"), made, "y", 0.5)
        got = [r["v"] for r in rows.withColumn("v", model.value()).orderBy("id").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    x = np.array([(a if a is not None and np.isfinite(a) else 0.0, b) for _, a, b, _ in data])
    z = (x - x.mean(0)) / x.std(0)
    f = np.sqrt(2 / 8) * np.cos(z @ np.array([w for w, _ in made.waves]).T + [p for _, p in made.waves])
    known = np.array([y is not None for *_, y in data])
    y = np.array([y for *_, y in data if y is not None])
    want = f @ np.linalg.solve(f[known].T @ f[known] + 0.5 * np.eye(8), f[known].T @ y)
    assert np.allclose(got, want, atol=1e-8)
    assert none.weights == (0.0,) * 8


@pytest.mark.parametrize("kind", ["gaussian", "polynomial"])
def test_svm_parts_rings(spark, kind):
    angle, ring = rng.uniform(0, 2 * np.pi, 400), np.arange(400) % 2
    p = np.stack([np.cos(angle), np.sin(angle)], 1) * (1 + 1.5 * ring)[:, None] + rng.normal(0, 0.1, (400, 2))
    rows = spark.createDataFrame([(*map(float, q), int(r)) for q, r in zip(p, ring)], "a double, b double, y int")
    made = subspace.gaussian_features(rows, ["a", "b"], count=64) if kind == "gaussian" else subspace.polynomial_kernel_features(rows, ["a", "b"], 2)
    hit = rows.select(((subspace.kernel_svm(rows, made, "y").value() > 0).cast("int") == F.col("y")).cast("int").alias("hit"))
    assert hit.agg(F.avg("hit")).first()[0] > 0.97

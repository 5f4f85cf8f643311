"""Principal axes from one pass of moments, and kernel models on explicit features.

The covariance matrix comes from mergeable aggregates in one pass; only that matrix, columns squared, reaches the
driver. Kernels are used through features of rows: random Fourier features for the Gaussian kernel, monomials for
the polynomial one, made for blocks of rows at once. A ridge on them solves normal equations gathered in one pass, so
no pair of rows is ever met.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.operators.models import project

BLOCK = 2048  # rows whose features are made at once


def moment_matrix(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, means and population covariances of ``cols``, by one aggregate; nulls and non-finite values are 0."""
    clean = df.select(*[finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = clean.agg(F.count("*").alias("n"), *[F.avg(f"c{i}").alias(f"m{i}") for i in range(len(cols))], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"v{i}_{j}"] or 0.0
    return row["n"], np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))]), cov


@dataclass(frozen=True)
class Axes:
    """Principal axes of columns: loadings by axis, the share of variance of every axis, and how many reach the share asked for."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    loadings: tuple[tuple[float, ...], ...]
    shares: tuple[float, ...]
    kept: int


def fit_axes(df: DataFrame, cols: Sequence[str], share: float = 0.95, scale: bool = True) -> Axes:
    """Axes in order of variance, with the fewest that hold more than ``share`` of it as ``kept``.

    ``scale`` divides columns by their deviation (1 where it is 0). Of each axis the largest loading is positive, the
    first of equal ones.
    """
    n, means, cov = moment_matrix(df, cols)
    spreads = np.sqrt(np.diag(cov)) if scale else np.ones(len(cols))
    spreads = np.where(spreads > 0, spreads, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(spreads, spreads))
    order = np.argsort(-values, kind="stable")
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    top = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=1, keepdims=True) - 1e-9, axis=1)
    vectors = vectors * np.where(vectors[np.arange(len(cols)), top] < 0, -1.0, 1.0)[:, None]
    shares = values / values.sum() if values.sum() > 0 else np.zeros(len(cols))
    kept = min(len(cols), int(np.searchsorted(np.cumsum(shares), share, side="right")) + 1)
    return Axes(tuple(cols), tuple(means.tolist()), tuple(spreads.tolist()), tuple(map(tuple, vectors.tolist())), tuple(shares.tolist()), kept)


def axis_shares(spark: SparkSession, axes: Axes) -> DataFrame:
    """``component, share, cumulative, kept``; components count from 1."""
    total = np.cumsum(axes.shares).tolist()
    return spark.createDataFrame([(i + 1, s, t, i < axes.kept) for i, (s, t) in enumerate(zip(axes.shares, total))], "component int, share double, cumulative double, kept boolean")


def axis_loadings(spark: SparkSession, axes: Axes) -> DataFrame:
    """``component, column, loading, place``: columns of each axis by the size of their loading."""
    rows = []
    for i, axis in enumerate(axes.loadings):
        ranked = sorted(range(len(axis)), key=lambda j: (-abs(axis[j]), j))
        rows += [(i + 1, axes.cols[j], axis[j], place + 1) for place, j in enumerate(ranked)]
    return spark.createDataFrame(rows, "component int, column string, loading double, place int")


def on_axes(df: DataFrame, axes: Axes, count: int | None = None) -> DataFrame:
    """``df`` with its coordinates on the kept axes, or on the first ``count``: ``coord_x, coord_y, coord_2, ...``."""
    used = [[v / s for v, s in zip(axis, axes.spreads)] for axis in axes.loadings[: axes.kept if count is None else count]]
    return project(df, axes.cols, used, axes.means)


@dataclass(frozen=True)
class Features:
    """Explicit features of a kernel over standardised columns: ``waves`` (weights, phase) or ``terms`` (columns, factor)."""

    cols: tuple[str, ...]
    means: tuple[float, ...]
    spreads: tuple[float, ...]
    waves: tuple[tuple[tuple[float, ...], float], ...] = ()
    terms: tuple[tuple[tuple[int, ...], float], ...] = ()

    def inputs(self) -> list[Column]:
        """The columns as doubles; nulls and non-finite values are 0."""
        return [finite(F.col(c).cast("double")) for c in self.cols]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Features of the rows of ``x``, whose columns are ``inputs``."""
        z = (x - np.array(self.means)) / np.array(self.spreads)
        if self.waves:
            weights, phases = np.array([w for w, _ in self.waves]), np.array([p for _, p in self.waves])
            return np.cos(z @ weights.T + phases) * np.sqrt(2 / len(self.waves))
        out = np.empty((len(z), len(self.terms)))
        for i, (columns, factor) in enumerate(self.terms):
            out[:, i] = factor * z[:, list(columns)].prod(axis=1)
        return out

    def array(self) -> Column:
        """One array per row."""

        @F.arrow_udf("array<double>")
        def made(*x: pa.Array) -> pa.Array:
            out = np.concatenate([self.of(part) for part in _blocks(x)])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))

        return made(*self.inputs())


def _blocks(columns: Sequence[pa.Array]) -> Iterator[np.ndarray]:
    """Columns of doubles as matrices of at most ``BLOCK`` rows; an empty one where there is no row."""
    arrays = [c.to_numpy(zero_copy_only=False) for c in columns]
    for at in range(0, max(1, len(arrays[0])), BLOCK):
        yield np.column_stack([a[at : at + BLOCK] for a in arrays])


def _scales(df: DataFrame, cols: Sequence[str]) -> tuple[tuple[float, ...], tuple[float, ...]]:
    _, means, cov = moment_matrix(df, cols)
    return tuple(means.tolist()), tuple(float(s) if s > 0 else 1.0 for s in np.sqrt(np.diag(cov)))


def gaussian_features(df: DataFrame, cols: Sequence[str], gamma: float | None = None, count: int = 128, seed: int = 42) -> Features:
    """``count`` random Fourier features of exp(-gamma |x - y|^2) on standardised columns; ``gamma`` is one over the columns by default."""
    gamma = 1.0 / len(cols) if gamma is None else gamma
    rng = np.random.default_rng(seed)
    weights, phases = rng.normal(0, np.sqrt(2 * gamma), (count, len(cols))), rng.uniform(0, 2 * np.pi, count)
    return Features(tuple(cols), *_scales(df, cols), waves=tuple((tuple(w), float(p)) for w, p in zip(weights.tolist(), phases)))


def polynomial_kernel_features(df: DataFrame, cols: Sequence[str], degree: int = 3, gamma: float | None = None, shift: float = 1.0) -> Features:
    """The exact features of (gamma x.y + shift)^degree: every monomial up to ``degree`` with the root of its coefficient."""
    gamma = 1.0 / len(cols) if gamma is None else gamma
    terms = []
    for size in range(degree + 1):
        for pick in combinations_with_replacement(range(len(cols)), size):
            ways = factorial(degree) / factorial(degree - size)
            for i in set(pick):
                ways /= factorial(pick.count(i))
            if factor := ways * gamma**size * shift ** (degree - size):
                terms.append((pick, float(np.sqrt(factor))))
    return Features(tuple(cols), *_scales(df, cols), terms=tuple(terms))


@dataclass(frozen=True)
class KernelModel:
    """A linear function of a kernel's features."""

    features: Features
    weights: tuple[float, ...] = field(repr=False)
    intercept: float = 0.0

    def value(self) -> Column:
        @F.arrow_udf("double")
        def made(*x: pa.Array) -> pa.Array:
            weights = np.array(self.weights)
            return pa.array(np.concatenate([self.features.of(part) @ weights + self.intercept for part in _blocks(x)]))

        return made(*self.features.inputs())


def _rows(df: DataFrame, features: Features, label: str) -> DataFrame:
    return df.select(array_to_vector(features.array()).alias("features"), F.col(label).cast("double").alias("_y"))


def kernel_ridge(df: DataFrame, features: Features, label: str, alpha: float = 1.0) -> KernelModel:
    """Least squares with ``alpha`` times the squared weights, without intercept.

    Every task sums the products of all features and of the label over its rows, block by block; these sums are added
    place by place, and the driver solves the normal equations.
    """
    known = df.filter(F.col(label).isNotNull()).select(*[c.alias(f"c{i}") for i, c in enumerate(features.inputs())], F.col(label).cast("double").alias("y"))
    size = len(features.waves or features.terms) + 1
    above = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for part in _blocks(batch.columns):
                v = np.column_stack([features.of(part[:, :-1]), part[:, -1]])
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(above[0]), dtype=np.int32)), pa.array(total[above])], names=["at", "total"])

    summed = known.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    gram = np.zeros((size, size))
    places = summed["at"].to_numpy()
    gram[above[0][places], above[1][places]] = gram[above[1][places], above[0][places]] = summed["total"].to_numpy()
    weights = np.linalg.solve(gram[:-1, :-1] + alpha * np.eye(size - 1), gram[:-1, -1])
    return KernelModel(features, tuple(weights.tolist()))


def kernel_svm(df: DataFrame, features: Features, label: str, c: float = 1.0) -> KernelModel:
    """A support vector machine on a kernel's features; labels 0 and 1, the value is above 0 for 1."""
    rows = _rows(df, features, label).filter(F.col("_y").isNotNull())
    made = LinearSVC(featuresCol="features", labelCol="_y", regParam=1.0 / (c * max(1, rows.count())), maxIter=100, standardization=False).fit(rows)
    return KernelModel(features, tuple(made.coefficients.toArray().tolist()), float(made.intercept))

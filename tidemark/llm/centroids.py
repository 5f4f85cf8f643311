"""Exact k-means on integer vectors with Shallot search.

Vectors become integers and are packed, a block of some thousand vectors a row, into a table that is
bucketed by block. What a vector remembers between rounds (nearest and second-nearest centroid, an
upper bound of the distance to the first, a lower bound of the distance to all others) lies in a
table of its own, bucketed alike: each round joins the two without a shuffle, reads the vectors,
and writes the new state with the sums of its clusters. Only these sums, one row of numbers per
task, are shuffled; the driver holds the centroids.

Search: a vector whose bounds part it from all other centroids is left alone. For others the
distances to both remembered centroids are taken and the scan starts at the closer one. The other
centroids follow in order of their distance from the start; the ball that can still hold a nearest
or second-nearest one shrinks with every better centroid and ends the scan. Distances are compared
as integers; the floating bounds are widened by more than their rounding error.

Edge cases: vectors that are null, of another length, or with null, NaN or infinite components are
left out; with fewer vectors than clusters every vector is a centroid; no vectors give an empty
result; equal vectors and repeated ids are vectors of their own, and where ids tie for a place among
the first centroids the smaller components come first; a null id is hashed as an empty id; equal
distances go to the smaller centroid number; a centroid without vectors stays; scaled components of
2^27 or more, whose squared distances leave 64 bits, raise ``ValueError``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.workspace import forget, fresh_path, partitions, written

#: Vectors in a packed row, and in a bucket of packed rows.
BLOCK = 2048
BUCKET_ROWS = 500_000
#: Components below it keep squared distances of 64 of them within 64 bits.
LIMIT = 1 << 27
#: Far more than the rounding of a square root and a few sums, relative to distances.
SLACK = 1e-9
STATE = np.dtype([("near", "<i4"), ("next", "<i4"), ("upper", "<f8"), ("lower", "<f8")])


def kept_vectors(vector_col: str, size: int) -> Column:
    """Whether a vector has ``size`` components, all finite."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == size) & fine, F.lit(False))


def integers(vector_col: str, scale: float) -> Column:
    return F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x))


def square(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole rows."""
    gap = vectors.astype(np.int64) - centroid
    return np.einsum("ij,ij->i", gap, gap)


def first_search(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """State after a full comparison with every centroid."""
    k = len(centroids)
    state = np.zeros(len(vectors), STATE)
    all_sq = np.stack([square(vectors, c) for c in centroids], axis=1)
    order = np.argsort(all_sq, axis=1, kind="stable")
    rows = np.arange(len(vectors))
    state["near"] = order[:, 0]
    state["upper"] = np.sqrt(all_sq[rows, order[:, 0]].astype(float)) * (1 + SLACK)
    state["next"] = order[:, 1] if k > 1 else 0
    state["lower"] = np.sqrt(all_sq[rows, order[:, 1]].astype(float)) * (1 - SLACK) if k > 1 else np.inf
    return state


class Centroids:
    """Centroids of a round with their neighbours in order of distance and how far each has moved."""

    def __init__(self, now: np.ndarray, before: np.ndarray):
        self.now = now
        k = len(now)
        self.moved = np.sqrt(np.array([square(now[j : j + 1], before[j])[0] for j in range(k)], float)) * (1 + SLACK)
        gaps = np.stack([np.sqrt(square(now, c).astype(float)) for c in now])
        others = [[j for j in range(k) if j != i] for i in range(k)]
        self.neighbours = [sorted(own, key=lambda j, i=i: (gaps[i, j], j)) for i, own in enumerate(others)]
        self.gaps = gaps * (1 - SLACK)
        self.half = np.array([self.gaps[i, own[0]] / 2 if own else np.inf for i, own in enumerate(self.neighbours)])
        self.other_moved = np.array([max((self.moved[j] for j in own), default=0.0) for own in others])


def shallot(vectors: np.ndarray, state: np.ndarray, c: Centroids) -> tuple[np.ndarray, int]:
    """The state of vectors after the centroids moved, and the number of distances that it took."""
    state = state.copy()
    state["upper"] = (state["upper"] + c.moved[state["near"]]) * (1 + SLACK)
    state["lower"] = (state["lower"] - c.other_moved[state["near"]]) * (1 - SLACK)
    if len(c.now) == 1:
        return state, 0
    free = np.maximum(state["lower"], c.half[state["near"]])
    open_ = np.flatnonzero(state["upper"] >= free)
    taken = len(open_)
    to_near = _distances(vectors, open_, state["near"][open_], c.now)
    state["upper"][open_] = np.sqrt(to_near.astype(float)) * (1 + SLACK)
    still = state["upper"][open_] >= free[open_]
    open_, to_near = open_[still], to_near[still]
    to_next = _distances(vectors, open_, state["next"][open_], c.now)
    taken += len(open_)
    # The scan starts at the closer of the two remembered centroids.
    near, other = state["near"][open_].copy(), state["next"][open_].copy()
    swap = (to_next < to_near) | ((to_next == to_near) & (other < near))
    near[swap], other[swap] = other[swap], near[swap]
    best, second = np.where(swap, to_next, to_near), np.where(swap, to_near, to_next)
    for start in np.unique(near):
        own = np.flatnonzero(near == start)
        reach = np.sqrt(best[own].astype(float)) * (1 + SLACK)
        n1, d1, n2, d2 = np.full(len(own), start), best[own], other[own], second[own]
        memory = n2.copy()
        for j in c.neighbours[start]:
            # One beyond the ball around the start that reaches the second-nearest so far can't come before it.
            inside = c.gaps[start, j] <= reach + np.sqrt(d2.astype(float)) * (1 + SLACK)
            if not inside.any():
                break
            at = np.flatnonzero(inside & (memory != j))
            if not len(at):
                continue
            d = square(vectors[open_[own[at]]], c.now[j])
            taken += len(at)
            first = (d < d1[at]) | ((d == d1[at]) & (j < n1[at]))
            then = ~first & ((d < d2[at]) | ((d == d2[at]) & (j < n2[at])))
            a, b = at[first], at[then]
            n2[a], d2[a], n1[a], d1[a] = n1[a], d1[a], j, d[first]
            n2[b], d2[b] = j, d[then]
        rows = open_[own]
        state["near"][rows], state["next"][rows] = n1, n2
        state["upper"][rows] = np.sqrt(d1.astype(float)) * (1 + SLACK)
        state["lower"][rows] = np.sqrt(d2.astype(float)) * (1 - SLACK)
    return state, taken


def _distances(vectors: np.ndarray, rows: np.ndarray, which: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    gap = vectors[rows].astype(np.int64) - centroids[which]
    return np.einsum("ij,ij->i", gap, gap)


def cluster_sums(vectors: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Components and count of each cluster, flat."""
    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    for j in range(k):
        own = near == j
        out[j, :-1], out[j, -1] = vectors[own].sum(axis=0, dtype=np.int64), own.sum()
    return out


def _unpacked(packed: pa.Scalar, n: int, size: int) -> np.ndarray:
    """Rows of a block; two bytes a component where all of them fit, else four."""
    buffer = packed.as_buffer()
    return np.frombuffer(buffer, "<i2" if buffer.size == 2 * n * size else "<i4").reshape(n, size)


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``block, n, ids, vectors`` from ``vec_id, vector``: up to ``BLOCK`` vectors a row."""
    kind = rows.schema["vec_id"].dataType
    schema = pa.schema([("n", pa.int32()), ("ids", pa.list_(to_arrow_type(kind))), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(schema.field("ids").type.value_type)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), BLOCK):
                own = ids.slice(at, BLOCK)
                part = flat[at * size : (at + len(own)) * size]
                top = max(-int(part.min()), int(part.max()))
                if top >= LIMIT:
                    raise ValueError("a scaled component has 2^27 or more")
                block = part.astype("<i2" if top < 1 << 15 else "<i4").tobytes()
                listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int32()), listed, pa.array([block], pa.binary())], schema=schema)

    packed = rows.mapInArrow(run, f"n int, ids array<{kind.simpleString()}>, vectors binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class _Bucketed:
    """Tables in the shared folder that are bucketed by block, so that joins of two need no shuffle."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def write(self, df: DataFrame, what: str) -> str:
        path = fresh_path(self.spark, what)
        name = f"tidemark_{path.rsplit('-', 1)[-1]}"
        df.write.bucketBy(self.buckets, "block").option("path", path).saveAsTable(name)
        self.paths[name] = path
        return name

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        forget(self.spark, self.paths.pop(name))


def _assign(blocks: DataFrame, state: DataFrame | None, now: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """``block, state, sums`` of each block under the centroids ``now``."""
    k, size = now.shape
    rows = blocks.select("block", "n", "vectors") if state is None else blocks.join(state, "block").select("block", "n", "vectors", "state")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None if before is None else Centroids(now, before)
        for batch in batches:
            found = []
            for i, (n, packed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                vectors = _unpacked(packed, n, size)
                if places is None:
                    own = first_search(vectors, now)
                else:
                    own, _ = shallot(vectors, np.frombuffer(batch.column(3)[i].as_buffer(), STATE), places)
                found.append((own.tobytes(), cluster_sums(vectors, own["near"], k).tobytes()))
            columns = [batch.column(0), *(pa.array(c, pa.binary()) for c in zip(*found))]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "state", "sums"])

    return rows.mapInArrow(run, "block long, state binary, sums binary")


def _moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The exact floor of every cluster's mean; a cluster without vectors stays where it is."""
    k, size = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * (size + 1), np.int64)
        for batch in batches:
            for sums in batch.column(0):
                total += np.frombuffer(sums.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "n"])

    flat = np.zeros(k * (size + 1), object)
    for r in state.select("sums").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r["at"]] = r["n"]
    out = now.copy()
    for j, row in enumerate(flat.reshape(k, size + 1)):
        if row[-1]:
            out[j] = [total // row[-1] for total in row[:-1]]
    return out


def _first_centroids(rows: DataFrame, k: int, seed: int, total: int) -> np.ndarray:
    """The vectors with the ``k`` smallest id hashes; a bound on the hash leaves some thousand candidates."""
    hashed = rows.withColumn("_h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    bounds = [f"{max(1, (1 << 32) * 1000 // total):08x}", None] if total > 1_000_000 else [None]
    for bound in bounds:
        near = hashed if bound is None else hashed.filter(F.col("_h") < bound)
        got = near.select("_h", "vector").orderBy("_h", "vector").limit(k).collect()
        if len(got) == min(k, total):
            break
    return np.array([r["vector"] for r in got], np.int64)


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, size: int = 64, scale: float = 1024,
    rounds: int = 10, seed: int = 3,
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of every kept vector after ``rounds`` rounds and a last assignment, and the centroids."""
    spark = table.sparkSession
    kept = table.filter(kept_vectors(vector_col, size)).select(F.col(id_col).alias("vec_id"), integers(vector_col, scale).alias("vector"))
    total = kept.count()
    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance long"
    if not total:
        return spark.createDataFrame([], schema), np.zeros((0, size), np.int64)
    now = _first_centroids(kept, k, seed, total)
    if np.abs(now).max() >= LIMIT:
        raise ValueError("a scaled component has 2^27 or more")
    # No more buckets than blocks, and no more than the catalog takes.
    tables = _Bucketed(spark, min(100_000, -(-total // BLOCK), max(partitions(spark), total // BUCKET_ROWS)))
    blocks = tables.write(_packed(kept, size).repartition(tables.buckets, "block"), "blocks")
    state = before = None
    for turn in range(rounds + 1):
        old, state = state, tables.write(_assign(spark.table(blocks), spark.table(state).select("block", "state") if state else None, now, before), "bounds")
        if old:
            tables.drop(old)
        if turn < rounds:
            before, now = now, _moved(spark.table(state), now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (n, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2))):
                near = np.frombuffer(batch.column(3)[i].as_buffer(), STATE)["near"]
                gap = _unpacked(packed, n, size) - now[near]
                columns = [batch.column(1)[i].values, pa.array(near), pa.array(np.einsum("ij,ij->i", gap, gap))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    last = spark.table(blocks).join(spark.table(state).select("block", "state"), "block").select("n", "ids", "vectors", "state")
    found = written(last.mapInArrow(run, schema), "clusters")
    tables.drop(state)
    tables.drop(blocks)
    return found, now


def cluster_report(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """``cluster`` with the summed distances of each cluster and of all, and a digest of the centroid."""
    found, now = cluster(table, id_col, vector_col, **options)
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    inertia = F.lit(sum(sums.values())).cast("long")
    each = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    if not sums:
        return found.select("*", inertia.alias("cluster_inertia"), inertia.alias("inertia"), F.lit("").alias("centroid_sha256"))
    own = each([sums.get(j, 0) for j in range(len(now))]).cast("long")
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), inertia.alias("inertia"), each(digests).alias("centroid_sha256"))

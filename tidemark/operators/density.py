"""Density clustering on a grid, exact, without pairs inside dense cells.

Cells are cubes whose diagonal is ``eps``, so all rows of a cell are neighbours. A cell with ``min_rows`` rows has
core rows only; rows of others count their neighbours in the cells around. Cells with core rows are linked where
two of their core rows are neighbours: pairs of cells are compared by the bounding boxes of their core rows; boxes
that are near or far as a whole decide, the rest are halved until they do, down to single points. Linked cells are
components; a row that is no core joins the least cluster with a core row in reach, else it is noise.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.staging import forget, staged

#: Rows of one cell that meet their visitors together; hot cells are fewer than a millionth of the rows, so they may be broadcast.
PART_ROWS = 1_000_000


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of tables that grow with the rows: always by sorting, as what is small in a shuffle, compressed, may fill the driver as a broadcast."""
    return left.join(right.hint("merge"), on, how)


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` of the nodes of ``links`` (columns a, b): the least node that is reached, by alternating stars."""
    now, path = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _met(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = large.filter("u > v").groupBy("u").agg(F.min("v").alias("m"))
        small = _met(large.filter("u > v"), own, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", F.col("m").alias("v"))).distinct()
        after, new = staged(small, "links")
        forget(links.sparkSession, path)
        now, path = after, new
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        before = mark
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def _squared(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b)), F.lit(0.0))


def _around(dims: int) -> list[tuple[int, ...]]:
    """Offsets of the cells that may hold neighbours: the gap between the cells is below ``eps``."""
    reach = int(dims**0.5) + 1
    return [o for o in product(range(-reach, reach + 1), repeat=dims) if sum(max(0, abs(x) - 1) ** 2 for x in o) < dims]


def _shifted(cell: Column, offsets: Sequence[tuple[int, ...]], dims: int) -> Column:
    return F.explode(F.array(*[F.array(*[cell[i] + o[i] for i in range(dims)]) for o in offsets]))


def dbscan(df: DataFrame, cols: Sequence[str], id_col: str, eps: float = 0.5, min_rows: int = 10) -> DataFrame:
    """``id_col, core, cluster``: a cluster is named by the least id of its core rows, null for noise.

    Neighbours are at most ``eps`` apart, a row counts itself. Rows with a null in ``cols`` are left out.
    """
    dims, square = len(cols), float(eps) ** 2
    side = eps / dims**0.5
    xs = [F.col(f"x{i}") for i in range(dims)]
    rows = df.dropna(subset=list(cols)).select(F.col(id_col).alias("id"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    rows = rows.withColumn("cell", F.array(*[F.floor(x / side).cast("long") for x in xs]))
    rows, _ = staged(rows, "points")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("m"))
    dense = sizes.filter(F.col("m") >= min_rows).select("cell")
    # Rows of sparse cells, fewer than ``min_rows`` a cell, travel as arrays to the cells around them.
    sparse = _met(rows, dense, "cell", "left_anti")
    packed = sparse.groupBy("cell").agg(F.collect_list(F.struct("id", *xs)).alias("own"))
    offsets = _around(dims)
    # A cell with very many rows is met in parts.
    hot = sizes.filter(F.col("m") > PART_ROWS).select("cell", F.ceil(F.col("m") / PART_ROWS).alias("parts"))
    dealt = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))

    def visited(there: DataFrame, travelling: DataFrame) -> DataFrame:
        sent = travelling.select(_shifted(F.col("cell"), offsets, dims).alias("cell"), "own").join(F.broadcast(hot), "cell", "left")
        sent = sent.select("cell", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        return _met(there.join(F.broadcast(hot), "cell", "left").withColumn("part", dealt), sent, ["cell", "part"])

    met = visited(rows, packed)
    near = F.filter("own", lambda p: _squared([p[f"x{i}"] for i in range(dims)], xs) <= square)
    reached = met.select("cell", F.explode(F.transform(near, lambda p: p["id"])).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    core = _met(rows, dense, "cell", "left_semi").select("id", "cell", *xs).union(
        _met(sparse, reached.filter(F.col("k") >= min_rows).select("id"), "id", "left_semi").select("id", "cell", *xs)
    )
    core, _ = staged(core, "cores")
    cells = core.groupBy("cell").agg(F.min("id").alias("least"))
    linked = _linked_cells(core, cells, offsets, dims, square)
    roots = components(linked)
    named = _met(cells, roots, F.col("least") == F.col("node"), "left").select("cell", "least", F.coalesce("root", "least").alias("cluster"))
    named, _ = staged(named, "cells")
    # Rows of sparse cells that are no core look for core rows around; again they are the ones that travel.
    loose = _met(sparse, core.select("id"), "id", "left_anti").groupBy("cell").agg(F.collect_list(F.struct("id", *xs)).alias("own"))
    visits = _met(visited(core, loose), named.select("cell", "cluster"), "cell")
    border = visits.select("cluster", F.explode(F.transform(near, lambda p: p["id"])).alias("id")).groupBy("id").agg(F.min("cluster").alias("cluster"))
    inner = _met(core, named, "cell").select("id", F.lit(True).alias("core"), "cluster")
    outer = _met(_met(sparse, core.select("id"), "id", "left_anti"), border, "id", "left").select("id", F.lit(False).alias("core"), "cluster")
    return inner.union(outer).withColumnRenamed("id", id_col)


def _linked_cells(core: DataFrame, cells: DataFrame, offsets: Sequence[tuple[int, ...]], dims: int, square: float) -> DataFrame:
    """``a, b``: the least core ids of cells that have core rows in reach of each other."""
    spark = core.sparkSession
    half = [o for o in offsets if o > (0,) * dims]
    pairs = cells.select("cell", F.col("least").alias("a"), _shifted(F.col("cell"), half, dims).alias("other"))
    undecided = _met(pairs, cells.select(F.col("cell").alias("other"), F.col("least").alias("b")), "other").select("a", "b", "cell", "other", F.array().cast("array<int>").alias("left"), F.array().cast("array<int>").alias("right"))
    axes = range(dims)
    # A box is the path of halvings of its cell; its bounds are those of the rows in it.
    held = core.select("cell", F.array().cast("array<int>").alias("box"), *[f"x{i}" for i in axes]).distinct()
    links = None
    while True:
        bounds = held.groupBy("cell", "box").agg(*[F.min(f"x{i}").alias(f"lo{i}") for i in axes], *[F.max(f"x{i}").alias(f"hi{i}") for i in axes])
        a = bounds.select(F.col("cell"), F.col("box").alias("left"), *[F.col(f"{e}{i}").alias(f"a_{e}{i}") for e in ("lo", "hi") for i in axes])
        b = bounds.select(F.col("cell").alias("other"), F.col("box").alias("right"), *[F.col(f"{e}{i}").alias(f"b_{e}{i}") for e in ("lo", "hi") for i in axes])
        met = _met(_met(undecided, a, ["cell", "left"]), b, ["other", "right"])
        apart = [F.greatest(F.lit(0.0), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"), F.col(f"b_lo{i}") - F.col(f"a_hi{i}")) for i in axes]
        widest = [F.greatest(F.col(f"a_hi{i}") - F.col(f"b_lo{i}"), F.col(f"b_hi{i}") - F.col(f"a_lo{i}")) for i in axes]
        nil = [F.lit(0.0)] * dims
        judged, path = staged(met.select("a", "b", "cell", "other", "left", "right", (_squared(apart, nil) <= square).alias("may"), (_squared(widest, nil) <= square).alias("must")), "cell-pairs")
        sure = judged.filter("must").select("a", "b").distinct()
        found, _ = staged(sure if links is None else links.union(sure).distinct(), "cell-links")
        links = found
        open_ = _met(judged.filter("may and not must"), links, ["a", "b"], "left_anti")
        open_, _ = staged(open_, "open-pairs")
        if open_.isEmpty():
            return links
        busy = open_.select("cell").union(open_.select("other")).distinct()
        # Each box is cut at the middle of its bounds; a box of one point stays as it is.
        middle = bounds.select("cell", "box", *[((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).alias(f"m{i}") for i in axes])
        side = sum((F.when(F.col(f"x{i}") > F.col(f"m{i}"), 1 << i).otherwise(0) for i in axes), F.lit(0)).cast("int")
        cut = _met(_met(held, busy, "cell", "left_semi"), middle, ["cell", "box"]).select("cell", F.array_append("box", side).alias("box"), *[f"x{i}" for i in axes])
        held, _ = staged(cut, "boxes")
        forget(spark, path)
        sides = F.array(*[F.lit(s) for s in range(1 << dims)])
        grown = open_.select("a", "b", "cell", "other", F.explode(F.transform(sides, lambda s: F.array_append("left", s))).alias("left"), "right")
        undecided = grown.select("a", "b", "cell", "other", "left", F.explode(F.transform(sides, lambda s: F.array_append("right", s))).alias("right"))

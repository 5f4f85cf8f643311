"""Exploratory statistics over labelled tables: correlation, encodings, summaries, importance."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.operators.neighbours import nearest  # noqa: F401
from tidemark.operators.stats import exact_quantiles
from tidemark.staging import staged


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, r`` for every pair of columns (``a`` before ``b``), in one pass over the data."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("all"))
    return row.select(F.inline("all"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, n, mean, std, lowest, highest``, in one pass."""
    made = F.array(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("lowest"), F.max(c).cast("double").alias("highest"))
        for c in cols
    ])
    return df.agg(made.alias("all")).select(F.inline("all"))


def quartiles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, q, value`` for each column, exact."""
    each = [exact_quantiles(df, c, [0.25, 0.5, 0.75]).select(F.lit(c).alias("column"), "q", "value") for c in cols]
    return reduce(DataFrame.unionByName, each)


def binarise(df: DataFrame, score: str, out: str, cut: float = 0.5) -> DataFrame:
    return df.withColumn(out, (F.col(score) > cut).cast("int"))


def numbered(values: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """``values`` with ``out``: their places from 0 in ``order`` (nulls first); sorted range by range, none holds all."""
    ranges = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts, _ = staged(values.repartitionByRange(ranges, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before, starts = 0, {}
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts[r["_part"]], before = before, before + r["n"]
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])[F.col("_part")] if starts else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + start
    return parts.withColumn(out, place.cast("int")).drop("_part")


def label_encode(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """``df`` with codes by sorted category. Categories are distinct values, joined back by key."""
    codes = numbered(df.select(F.col(col).alias("_c")).distinct(), ["_c"], out)
    return df.join(codes, F.col(col).eqNullSafe(F.col("_c"))).drop("_c")


def factorize(df: DataFrame, col: str, order: str, out: str = "code") -> DataFrame:
    """``df`` with codes by first appearance in ``order``."""
    first = df.groupBy(F.col(col).alias("_c")).agg(F.min(order).alias("_o"))
    codes = numbered(first, ["_o", "_c"], out).drop("_o")
    return df.join(codes, F.col(col).eqNullSafe(F.col("_c"))).drop("_c")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), list(values), "metric", "value")


def best_variant(df: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """The row with the best score of each group; ties to the least ``tie``."""
    cols = [c for c in df.columns if c != group]
    best = F.max_by(F.struct(*cols), F.struct(F.col(score), -F.col(tie))).alias("_s")
    return df.groupBy(group).agg(best).select(group, *[F.col(f"_s.{c}").alias(c) for c in cols])


def cumulative_importance(df: DataFrame, weight: str, name: str, thresholds: Sequence[float]) -> DataFrame:
    """``threshold, n_features``: how many features, largest first, reach each share of the whole.

    Takes a table of features (a few hundred rows at most), so one ordered partition holds it.
    """
    order = Window.orderBy(F.desc(weight), name)
    run = df.withColumn("_c", F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy()))
    made = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.count_if(F.col("_c") <= t + 1e-12) + 1).alias("n_features")) for t in thresholds])
    return run.agg(made.alias("all")).select(F.inline("all"))


def sample_exactly(df: DataFrame, n: int, id_col: str, seed: int = 42, bins: int = 4096) -> DataFrame:
    """``n`` rows of ``df`` (all where it has fewer): those with the smallest hashes of an integer id and ``seed``, ties to the smaller id.

    Hashes are counted in bins; only rows of the bin in which the sample ends are put in order.
    """
    h = F.pmod((F.pmod(F.col(id_col), F.lit(1 << 31)) + seed) * F.lit(2654435761), F.lit(1 << 32))
    rows = df.withColumns({"_h": h, "_bin": F.floor(h * bins / (1 << 32))})
    # At most ``bins`` rows.
    counted = rows.groupBy(F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    before = counted.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n"))
    edge = before.filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).agg(F.max("_b").alias("_edge"), F.max(n - F.col("_before")).alias("_left"))
    placed = rows.join(F.broadcast(edge))
    whole = placed.filter(F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")))
    last = placed.filter(F.col("_bin") == F.col("_edge")).withColumn("_r", F.row_number().over(Window.orderBy("_h", id_col))).filter(F.col("_r") <= F.col("_left"))
    return whole.drop("_h", "_bin", "_edge", "_left").unionByName(last.drop("_h", "_bin", "_edge", "_left", "_r")) if n > 0 else df.limit(0)


def stratified_split(df: DataFrame, label: str, id_col: str, test_percent: int = 30, bins: int = 1024) -> DataFrame:
    """``df`` with ``is_test`` for the rows of each class with the smallest id hashes, ``test_percent`` of them to the row.

    Hashes are counted in ``bins`` per class; only rows of the bin in which a class reaches its share are ranked.
    """
    h = F.pmod(F.pmod(F.col(id_col), F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
    rows = df.withColumns({"_h": h, "_bin": F.floor(h * bins / (1 << 32))})
    counted = rows.groupBy(F.col(label).alias("_y"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    own = Window.partitionBy("_y")
    before = F.sum("_n").over(own.orderBy("_b")) - F.col("_n")
    want = F.floor((F.sum("_n").over(own) * test_percent + 50) / 100)
    edges = counted.select("_y", "_b", (want - before).alias("_left"), "_n").filter("_left >= 0 and _left < _n").groupBy("_y").agg(F.min(F.struct("_b", "_left")).alias("_e"))
    placed = rows.join(F.broadcast(edges), F.col(label).eqNullSafe(F.col("_y")), "left")
    inside = F.col("_bin") == F.col("_e._b")
    rank = F.row_number().over(Window.partitionBy("_y", F.when(inside, F.lit(-1)).otherwise(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)))).orderBy("_h", id_col))
    test = F.when(F.col("_e").isNull() | (F.col("_bin") < F.col("_e._b")), True).when(inside, rank <= F.col("_e._left")).otherwise(False)
    return placed.withColumn("is_test", test).drop("_h", "_bin", "_y", "_e")


def numeric_columns(df: DataFrame) -> DataFrame:
    """The numeric columns of ``df``."""
    return df.select(*[f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)])


def folds(df: DataFrame, id_col: str, k: int = 5) -> DataFrame:
    return df.withColumn("fold", F.pmod(F.xxhash64(id_col), F.lit(k)))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5) -> DataFrame:
    """``df`` with ``fold`` from 0 to ``k`` - 1, each with an equal share of every class, by order of the id's hash.

    Places are counted inside hash bins and those of the bins before are added, so no sort holds a class.
    """
    bins = 1 << 16
    h = F.xxhash64(F.lit(7), F.col(id_col).cast("string"))
    rows = df.withColumns({"_h": h, "_bin": F.pmod(h, F.lit(bins))})
    counted = rows.groupBy(F.col(label).alias("_y"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_n"))
    # At most 65536 rows a class.
    before = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy("_y").orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_h", id_col)) - 1
    placed = rows.withColumn("_r", inside).join(before, F.col(label).eqNullSafe(F.col("_y")) & (F.col("_bin") == F.col("_b")))
    return placed.withColumn("fold", F.pmod(F.col("_before") + F.col("_r"), F.lit(k))).drop("_h", "_bin", "_y", "_b", "_before", "_r")

"""Pool, alert and model sinks: idempotent writes keyed by window or batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.staging import forget, staged


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


INDEX = "window_id string, sensor string, visao string, bucket long, t_start long, t_end long, n_rows long, parquet_bytes long, sha256 string, path string"


def write_pool(rows: DataFrame, path: str, seconds: int = 780) -> DataFrame:
    """Append pool windows (``sensor, visao, bucket, window_id``) that the pool does not hold yet; returns the new index rows.

    Rows are clustered by window, so each window is one file. Windows are written before the index and each in
    place of what its folder holds, so a call that failed between the two can be repeated; after a call that
    went through, the same rows write nothing. The index has each window's times, rows, bytes and digest.
    """
    spark = rows.sparkSession
    known = read_or_empty(spark, f"{path}/index", INDEX)
    fresh = rows.join(known.select("window_id"), "window_id", "left_anti")
    fresh.repartition("sensor", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sensor", "visao", "bucket").parquet(f"{path}/windows")
    counted = fresh.groupBy("window_id", "sensor", "visao", "bucket").agg(F.count("*").alias("n_rows"))
    folders = F.concat(F.lit(f"{path}/windows/sensor="), "sensor", F.lit("/visao="), "visao", F.lit("/bucket="), "bucket").alias("path")
    placed, draft = staged(counted.select("*", folders), "pool-index")
    index = placed.join(window_digests(spark, [r["path"] for r in placed.select("path").toLocalIterator()]), "path").select(
        "window_id", "sensor", "visao", "bucket", (F.col("bucket") * seconds).alias("t_start"), ((F.col("bucket") + 1) * seconds).alias("t_end"), "n_rows", "parquet_bytes", "sha256", "path"
    )
    added, own = staged(index, "pool-index")
    added.write.mode("append").parquet(f"{path}/index")
    forget(spark, draft)
    return added


def window_digests(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``path, parquet_bytes, sha256`` of window folders; the digest of several files is that of their digests in order."""
    if not folders:
        return spark.createDataFrame([], "path string, parquet_bytes long, sha256 string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders)
    clean = lambda c: F.regexp_replace(c, "^file:/*", "/")
    each = files.select(F.regexp_extract(clean(F.col("path")), "^(.*)/[^/]*$", 1).alias("_folder"), "length", F.sha2("content", 256).alias("d"))
    found = each.groupBy("_folder").agg(F.sum("length").alias("parquet_bytes"), F.sort_array(F.collect_list("d")).alias("ds"))
    named = spark.createDataFrame([(f,) for f in folders], "path string").withColumn("_folder", clean(F.col("path")))
    return named.join(found, "_folder").select("path", "parquet_bytes", F.when(F.size("ds") == 1, F.col("ds")[0]).otherwise(F.sha2(F.array_join("ds", ""), 256)).alias("sha256"))


def write_alerts(scored: DataFrame, path: str, floor: float = 0.95, batch: int | None = None) -> None:
    """Append alerts at or above the ingest floor by day; a repeated batch overwrites its own rows."""
    kept = scored.filter(F.col("percentile") >= floor).withColumn("day", F.date_format(F.timestamp_seconds("t0"), "yyyy-MM-dd"))
    out = path if batch is None else f"{path}/batch={batch}"
    kept.write.mode("append" if batch is None else "overwrite").partitionBy("day").parquet(out)


def write_bundle(spark: SparkSession, bundle: dict, path: str) -> None:
    """A detector bundle as two tables: forest nodes, and one JSON row of the rest."""
    f = bundle["forest"]
    spark.createDataFrame(f.nodes).write.mode("overwrite").parquet(f"{path}/nodes")
    rest = {k: v for k, v in bundle.items() if k != "forest"} | {"sample": f.sample, "spark": spark.version}
    spark.createDataFrame([(json.dumps(rest),)], "body string").coalesce(1).write.mode("overwrite").parquet(f"{path}/bundle")


def read_bundle(spark: SparkSession, path: str) -> dict:
    """The bundle back; ``same_version`` tells whether this Spark wrote it."""
    from tidemark.operators.models import Forest

    rest = json.loads(spark.read.parquet(f"{path}/bundle").first()["body"])
    nodes = spark.read.parquet(f"{path}/nodes").toPandas()
    as_tree = lambda t: tuple(as_tree(x) if isinstance(x, list) else x for x in t) if isinstance(t, list) else t
    forest = Forest(rest["cols"], rest.pop("sample"), nodes)
    return rest | {"forest": forest, "tree": as_tree(rest["tree"]), "grid": [tuple(g) for g in rest["grid"]], "same_version": rest.pop("spark") == spark.version}


def set_current(spark: SparkSession, path: str, model: str, at: float) -> None:
    """Name the current model of a role by one more row in its own file: a reader sees the old name or the new one."""
    spark.createDataFrame([(model, float(at))], "model string, at double").coalesce(1).write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> str | None:
    """The name that was set last, None where none was."""
    return read_or_empty(spark, path, "model string, at double").agg(F.max_by("model", F.struct("at", "model"))).first()[0]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of the files (of up to 2 GB) under a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def present(index: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of an ``index`` whose folder ``path`` still holds files below ``root``, and the rows of the others."""
    spark = index.sparkSession
    clean = lambda c: F.regexp_replace(c, "^file:/*", "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root).select("path")
    folders = files.select(F.regexp_extract(clean(F.col("path")), "^(.*)/[^/]*$", 1).alias("_folder")).distinct()
    same = clean(F.col("path")) == F.col("_folder")
    return index.join(folders, same, "left_semi"), index.join(folders, same, "left_anti")


def read_windows(spark: SparkSession, index: DataFrame, root: str) -> tuple[DataFrame | None, int]:
    """Rows of the windows of ``index`` that are still there, and how many windows have vanished; None where none is left.

    A file that goes between the listing and the read is skipped too.
    """
    held, gone = present(index, root)
    paths = [r["path"] for r in held.select("path").toLocalIterator()]
    rows = spark.read.option("basePath", root).option("ignoreMissingFiles", "true").parquet(*paths) if paths else None
    return rows, gone.count()

"""Shared folder handling and small session helpers for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}

#: ASCII white space as the corpus contracts define it: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"
#: One word is a run of anything else.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: One key with more than this part of all rows is hot.
HOT = 10_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that is unset, a temporary folder of this process takes its place on a session of one
    machine (``local``); on a cluster ``RuntimeError`` is raised.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        if "dir" not in _FALLBACK:
            _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        base = _FALLBACK["dir"]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def hash_share(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return h / F.lit(2.0**64) + 0.5


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other call has got."""
    return f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` cut from its lineage: written as Parquet to the shared folder and read back.

    A lost executor then costs a re-read, not a recomputation, and no block lives on one machine.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def hot(df: DataFrame, rows: str, total: int) -> Column:
    """Whether the key of a row of ``df`` holds over a ``HOT``-th of all ``total`` rows of another table.

    ``rows`` is the number of them that hold the key, so fewer than ``HOT`` keys are hot and may be broadcast.
    """
    return df[rows] * HOT > total


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session, at least one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

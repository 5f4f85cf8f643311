"""Tables that cut lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder on ``local`` masters, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if not base:
        base = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="tidemark-"))
    return base.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/staged/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """``df`` as written Parquet, and its path: a lost executor costs a re-read."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def opened(path: str) -> pa.NativeFile:
    """A file of any store that Arrow knows, to be read by a task."""
    store, place = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))
    return store.open_input_file(place)

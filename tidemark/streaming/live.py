"""The live path on Structured Streaming: anchored windows, scoring, alerts and pool windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import bucket, window_id
from tidemark.operators.flows import flow_features
from tidemark.operators.stats import percentile_lookup
from tidemark.sinks import write_alerts, write_pool
from tidemark.staging import forget, staged

TAGGED = "sensor string, ts double, src string, dst string, proto int, length int, sport int, dport int, flags string, w_start double"


def tag_anchored(packets: DataFrame, seconds: float = 10.0, order: str = "ts") -> DataFrame:
    """A packet stream (with ``sensor``) tagged by the start of its data-anchored window.

    The state of a sensor is one number, the open window's start. Packets of a batch are taken in the order of
    the column ``order`` (an arrival number, say); one with an earlier time joins the window that is open then.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        starts = []
        for t in rows["ts"].tolist():
            if start is None or t - start >= seconds:
                start = t
            starts.append(start)
        if starts:
            state.update((start,))
        yield rows.assign(w_start=starts)[[c.split()[0] for c in TAGGED.split(", ")]]

    return packets.groupBy("sensor").applyInPandasWithState(run, TAGGED, "start double", "append", GroupStateTimeout.NoTimeout)


def bucket_counts(flows: DataFrame, seconds: int = 780, delay: str = "0 seconds") -> DataFrame:
    """Rows of each epoch-aligned pool window under a watermark, from a stream of flows."""
    timed = flows.withColumn("at", F.timestamp_seconds("t0")).withWatermark("at", delay)
    return timed.groupBy(F.window("at", f"{seconds} seconds"), "sensor").agg(F.count("*").alias("n_rows"))


class LiveSink:
    """``foreachBatch`` target: each batch is a frame; alerts are written first, then pool windows close.

    A frame closes every open window below its largest; rows of closed windows are counted as late and not
    stored, though their alerts are. Rows of open windows wait in folders by bucket and are read once, when
    their window closes. What is open and closed and how many rows came late is a small table that each batch
    reads from the one before it and writes last, so a restarted query goes on where it stopped and a repeated
    batch changes nothing. Closed windows older than ``keep`` buckets below a sensor's largest are dropped from
    the table; rows that far back are late whether their window had been open or not.
    """

    STATE = "kind string, sensor string, bucket long, n long"

    def __init__(self, path: str, score: Callable[[DataFrame], DataFrame], grid: list[tuple[float, float]], view: str = "flow", seconds: int = 780, floor: float = 0.95, keep: int = 20_000):
        self.path, self.score, self.grid, self.view, self.seconds, self.floor, self.keep = path, score, grid, view, seconds, floor, keep

    def __call__(self, packets: DataFrame, batch: int) -> None:
        flows = flow_features(packets, ("sensor", "w_start"))
        self.take(percentile_lookup(self.score(flows), "score", self.grid), batch)

    def take(self, scored: DataFrame, batch: int) -> None:
        """One frame of scored rows (``sensor, t0, score, percentile`` and features)."""
        spark = scored.sparkSession
        frame = f"{self.path}/frames/frame={batch}"
        scored.withColumn("bucket", bucket(F.col("t0"), self.seconds)).write.mode("overwrite").parquet(frame)
        rows = spark.read.parquet(frame)
        write_alerts(rows, f"{self.path}/alerts", self.floor, batch)
        before = self.state(spark, batch)
        known = rows.join(before.filter("kind = 'closed'").select("sensor", "bucket", F.lit(True).alias("_shut")), ["sensor", "bucket"], "left")
        known = known.join(before.filter("kind = 'floor'").select("sensor", F.col("bucket").alias("_floor")), "sensor", "left")
        late = F.col("_shut").isNotNull() | F.coalesce(F.col("bucket") < F.col("_floor"), F.lit(False))
        fresh = known.filter(~late).drop("_shut", "_floor").withColumn("frame", F.lit(batch).cast("long"))
        fresh.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "frame").parquet(f"{self.path}/open")
        counts = known.groupBy("sensor", "bucket").agg(F.count_if(late).alias("_late"), F.count_if(~late).alias("_fresh"))
        seen = before.filter("kind = 'open'").select("sensor", "bucket").union(counts.filter("_fresh > 0").select("sensor", "bucket")).distinct()
        tops = rows.groupBy("sensor").agg(F.max("bucket").alias("_top"))
        judged = seen.join(tops, "sensor", "left").select("sensor", "bucket", F.coalesce(F.col("bucket") < F.col("_top"), F.lit(False)).alias("_shut"))
        self._advance(spark, before, judged, batch, counts.groupBy("sensor").agg(F.sum("_late").alias("n")), tops)
        forget(spark, frame)

    def _advance(self, spark: SparkSession, before: DataFrame, judged: DataFrame, batch: int, late: DataFrame, tops: DataFrame) -> None:
        """Move the windows that close now into the pool, then write the state after ``batch``."""
        none = F.lit(None).cast("long")
        closing = judged.filter("_shut").select("sensor", "bucket")
        closed = before.filter("kind = 'closed'").select("sensor", "bucket").union(closing)
        floors = before.filter("kind = 'floor'").select("sensor", "bucket").union(tops.select("sensor", F.col("_top") - self.keep)).groupBy("sensor").agg(F.max("bucket").alias("bucket"))
        kept = closed.join(floors.withColumnRenamed("bucket", "_floor"), "sensor", "left").filter(F.coalesce(F.col("bucket") >= F.col("_floor"), F.lit(True)))
        lates = before.filter("kind = 'late'").select("sensor", "n").union(late.select("sensor", "n")).groupBy("sensor").agg(F.sum("n").alias("n"))
        after = (
            judged.filter("not _shut").select(F.lit("open").alias("kind"), "sensor", "bucket", none.alias("n"))
            .union(kept.select(F.lit("closed"), "sensor", "bucket", none)).union(floors.select(F.lit("floor"), "sensor", "bucket", none)).union(lates.select(F.lit("late"), "sensor", none, "n"))
        )
        draft, path = staged(after, "live-state")
        self._pool(spark, closing)
        draft.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/frame={batch}")
        forget(spark, path)
        # The batch before is through, so nothing will ask again for what it closed.
        idle = before.filter("kind = 'closed'").select("bucket").distinct().join(before.filter("kind = 'open'").select("bucket").distinct(), "bucket", "left_anti")
        left = [r["bucket"] for r in idle.join(self._waiting(spark), "bucket").collect()]
        for b in left:
            forget(spark, f"{self.path}/open/bucket={b}")
        for old in self._frames(spark):
            if old < batch - 1:
                forget(spark, f"{self.path}/state/frame={old}")

    def _pool(self, spark: SparkSession, closing: DataFrame) -> None:
        buckets = [r["bucket"] for r in closing.select("bucket").distinct().collect()]
        if buckets:
            rows = spark.read.option("basePath", f"{self.path}/open").parquet(*[f"{self.path}/open/bucket={b}" for b in buckets]).drop("frame")
            ids = window_id(F.col("bucket"), self.seconds, F.col("sensor"), F.lit(self.view))
            closed = rows.withColumn("bucket", F.col("bucket").cast("long")).join(closing, ["sensor", "bucket"], "left_semi")
            write_pool(closed.withColumn("visao", F.lit(self.view)).withColumn("window_id", ids), f"{self.path}/pool", self.seconds)

    def _folders(self, spark: SparkSession, what: str, name: str) -> list[int]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        store = place.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))

    def _frames(self, spark: SparkSession) -> list[int]:
        return self._folders(spark, "state", "frame")

    def _waiting(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(b,) for b in self._folders(spark, "open", "bucket")], "bucket long")

    def state(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """``kind, sensor, bucket, n`` before ``batch``, or the newest: open and closed windows, the least bucket taken, rows that came late."""
        known = [f for f in self._frames(spark) if batch is None or f < batch]
        return spark.read.schema(self.STATE).parquet(f"{self.path}/state/frame={known[-1]}") if known else spark.createDataFrame([], self.STATE)

    def late(self, spark: SparkSession) -> DataFrame:
        """``sensor, n``: rows that came after their window had closed."""
        return self.state(spark).filter("kind = 'late'").select("sensor", "n")

    def finish(self, spark: SparkSession) -> None:
        """Close every window that is open, at the end of a stream."""
        frames = self._frames(spark)
        before, batch = self.state(spark), (frames[-1] if frames else 0) + 1
        judged = before.filter("kind = 'open'").select("sensor", "bucket", F.lit(True).alias("_shut"))
        none = spark.createDataFrame([], "sensor string, n long")
        self._advance(spark, before, judged, batch, none, spark.createDataFrame([], "sensor string, _top long"))

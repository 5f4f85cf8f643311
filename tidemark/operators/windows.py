"""Time windows of the live path in batch form: pool buckets, anchored windows, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import bucket, window_id
from tidemark.operators.chains import chain_starts, in_links


def pool_windows(flows: DataFrame, view: str = "flow", seconds: int = 780, sensor: str = "sensor") -> DataFrame:
    """``flows`` with ``bucket`` and ``window_id``."""
    b = bucket(F.col("t0"), seconds)
    return flows.withColumn("bucket", b).withColumn("window_id", window_id(F.col("bucket"), seconds, F.col(sensor), F.lit(view)))


def pool_index(windows: DataFrame, seconds: int = 780) -> DataFrame:
    """One row per pool window: ``window_id, sensor, bucket, t_start, t_end, n_rows, first_t0, last_t0``."""
    return windows.groupBy("window_id", "sensor", "bucket").agg(F.count("*").alias("n_rows"), F.min("t0").alias("first_t0"), F.max("t0").alias("last_t0")).select(
        "window_id", "sensor", "bucket", (F.col("bucket") * seconds).alias("t_start"), ((F.col("bucket") + 1) * seconds).alias("t_end"), "n_rows", "first_t0", "last_t0"
    )


def anchored_windows(packets: DataFrame, seconds: float = 10.0, sensor: str = "sensor", spans: int = 4096) -> DataFrame:
    """``sensor, w_start, w_last, n_packets``: windows that start at a packet and end before the first one ``seconds`` later.

    Windows of a sensor follow from each other; blocks of ``spans`` windows' time are mapped on their own and composed.
    """
    links = chain_starts(packets.withColumn("sensor", F.col(sensor)), ["sensor"], span=seconds, spans=spans)
    return links.select("sensor", F.col("start").alias("w_start"), F.col("last").alias("w_last"), F.col("n").alias("n_packets"))


def in_anchored_windows(packets: DataFrame, seconds: float = 10.0, min_packets: int = 3, grain: float = 3600.0) -> DataFrame:
    """``packets`` with ``w_start`` of their anchored window; windows below ``min_packets`` are dropped.

    Windows meet packets on the time cells they touch, an equi-join with the interval as residue.
    """
    found = chain_starts(packets, ["sensor"], span=seconds).filter(F.col("n") >= min_packets)
    return in_links(packets, found, ["sensor"], grain=grain).withColumnRenamed("start", "w_start")


def next_greater(tops: DataFrame, fan: int = 512) -> DataFrame:
    """``_s, _f, _shut`` from ``_s, _f, _top``: the first later frame of a sensor with a larger top; rows without one are left out.

    Frames are cut into blocks of ``fan`` numbers, blocks into blocks, up to one block per sensor. A frame looks for
    a larger top in its own block, then for a later block with a larger one, level by level, and down again.
    """
    reach = tops.agg(F.min("_f"), F.max("_f")).first()
    low, span = (reach[0] or 0), (reach[1] or 0) - (reach[0] or 0) + 1
    elements = tops.select("_s", (F.col("_f") - low).alias("_pos"), F.col("_top").alias("_v"))
    levels = []
    while True:
        block = F.floor(F.col("_pos") / fan).cast("long").alias("_block")
        levels.append(elements.groupBy("_s", block).agg(F.sort_array(F.collect_list(F.struct(F.col("_pos").cast("long").alias("p"), F.col("_v").alias("v")))).alias("_own")))
        if span <= fan:
            break
        span = -(-span // fan)
        elements = elements.groupBy("_s", block).agg(F.max("_v").alias("_v")).withColumnRenamed("_block", "_pos")

    def look(rows: DataFrame, level: int, block, after) -> DataFrame:
        there = levels[level].select(F.col("_s").alias("_s2"), F.col("_block").alias("_b2"), "_own")
        hit = F.get(F.filter("_own", lambda x: (x["p"] > after) & (x["v"] > F.col("_top"))), F.lit(0))["p"]
        held = rows.withColumn("_want", block.cast("long")).join(there, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_want") == F.col("_b2")))
        return held.withColumn("_hit", hit).select("_s", "_f", "_top", "_at", "_hit")

    seeking = tops.select("_s", "_f", "_top", (F.col("_f") - low).cast("long").alias("_at"))
    out = None
    for level in range(len(levels)):
        tried = look(seeking, level, F.floor(F.col("_at") / fan), F.col("_at"))
        found = tried.filter(F.col("_hit").isNotNull())
        for down in range(level - 1, -1, -1):
            found = look(found.withColumn("_at", F.col("_hit")), down, F.col("_at"), F.lit(-1))
        found = found.select("_s", "_f", (F.col("_hit") + low).alias("_shut"))
        out = found if out is None else out.unionByName(found)
        seeking = tried.filter(F.col("_hit").isNull()).withColumn("_at", F.floor(F.col("_at") / fan).cast("long")).drop("_hit")
    return out


def late_rows(rows: DataFrame, frame: str = "frame", bucket_col: str = "bucket", sensor: str = "sensor", fan: int = 512) -> DataFrame:
    """``rows`` with ``late``: whether their bucket had been closed by an earlier frame of their sensor.

    A frame closes every open bucket below its largest; a bucket that is first seen after larger ones is
    accepted until its frame ends. So a bucket is closed by its first frame where that holds a larger one,
    else it is its first frame's largest, and closed by the next frame with a larger one.
    """
    pairs = rows.select(F.col(sensor).alias("_s"), F.col(frame).alias("_f"), F.col(bucket_col).alias("_b")).distinct()
    tops = pairs.groupBy("_s", "_f").agg(F.max("_b").alias("_top"))
    first = pairs.groupBy("_s", "_b").agg(F.min("_f").alias("_f")).join(tops, ["_s", "_f"])
    at_once = first.filter(F.col("_top") > F.col("_b")).select("_s", "_b", F.col("_f").alias("_shut"))
    waiting = first.filter(F.col("_top") == F.col("_b"))
    later = waiting.select("_s", "_f", "_b").join(next_greater(tops, fan), ["_s", "_f"]).select("_s", "_b", "_shut")
    shut = at_once.unionByName(later)
    joined = rows.join(shut, (F.col(sensor) == F.col("_s")) & (F.col(bucket_col) == F.col("_b")), "left")
    return joined.withColumn("late", F.coalesce(F.col(frame) > F.col("_shut"), F.lit(False))).drop("_s", "_b", "_shut")


def top_per_window(rows: DataFrame, score: str, k: int, ties: tuple[str, ...]) -> DataFrame:
    """The ``k`` rows of each window with the highest score, with their ``place``."""
    order = Window.partitionBy("window_id").orderBy(F.desc(score), *ties)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)

"""Attack schedules: interval labels of flows and attack labels of hosts."""

from __future__ import annotations

import calendar
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.staging import staged


def compile_schedule(spark: SparkSession, entries: Sequence[tuple], utc_offset: int = -3, margin: int = 0) -> DataFrame:
    """``pos, start, stop, name, attackers, victims`` from (date, from, to, name, attackers, victims) in local time.

    A list that a caller states is at most ``10_000`` entries; longer schedules are tables of these columns.
    """
    if len(entries) > 10_000:
        raise ValueError("a schedule holds at most 10000 entries")
    rows = []
    for date, begin, end, name, attackers, victims in entries:
        year, month, day = map(int, date.split("-"))
        epoch = lambda clock: calendar.timegm((year, month, day, int(clock[:2]) - utc_offset, int(clock[3:]), 0))  # noqa: B023, E731
        rows.append((float(epoch(begin) - margin), float(epoch(end) + margin), name, list(attackers), list(victims)))
    rows.sort(key=lambda r: r[0])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos int, start double, stop double, name string, attackers array<string>, victims array<string>")


#: Rows of an index that may be broadcast; beyond it, the joins are shuffled.
BROADCAST_ROWS = 500_000


def schedule_index(schedule: DataFrame, grain: float = 3600.0) -> DataFrame:
    """``_cell, _ip, _entries``: the entries of each time cell and attacker, in order of position."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor(F.col("stop") / grain))).alias("_cell")
    each = schedule.filter("start <= stop").select(cells, F.explode(F.array_distinct("attackers")).alias("_ip"), F.struct("pos", "start", "stop", "name", "victims").alias("e"))
    return each.groupBy("_cell", "_ip").agg(F.sort_array(F.collect_list("e")).alias("_entries"))


def label_flows(flows: DataFrame, schedule: DataFrame, ts: str = "t0", a: str = "src", b: str = "dst", grain: float = 3600.0) -> DataFrame:
    """``flows`` with ``attack``: the first schedule entry that holds the time and the pair of addresses, in either order.

    The index has one row per time cell and attacker, so a flow meets at most two of them, by equal keys: those of
    its cell and either end. Flows are neither multiplied nor compared with entries of other cells or addresses.
    """
    index, _ = staged(schedule_index(schedule, grain), "schedule-index")
    small = index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    t = F.col(ts)
    out = flows.withColumn("_at", F.floor(t / grain))
    for side, address in (("_ab", a), ("_ba", b)):
        part = index.select(F.col("_cell").alias(f"{side}_cell"), F.col("_ip").alias(f"{side}_ip"), F.col("_entries").alias(side))
        same = (F.col("_at") == F.col(f"{side}_cell")) & (F.col(address) == F.col(f"{side}_ip"))
        out = out.join(F.broadcast(part) if small else part, same, "left").drop(f"{side}_cell", f"{side}_ip")

    def first(side: str, victim: str):
        fits = lambda e: (e["start"] <= t) & (t <= e["stop"]) & ((F.size(e["victims"]) == 0) | F.array_contains(e["victims"], F.col(victim)))
        hit = F.get(F.filter(side, fits), F.lit(0))
        return F.when(hit.isNotNull(), F.struct(hit["pos"].alias("pos"), hit["name"].alias("name")))

    return out.withColumn("attack", F.least(first("_ab", b), first("_ba", a))["name"]).drop("_at", "_ab", "_ba")


def attack_hosts(hosts: DataFrame, schedule: DataFrame, first: float, last: float, address: str = "src") -> DataFrame:
    """``hosts`` with ``label``: 1 for addresses that take part in an entry overlapping ``first`` to ``last``."""
    over = schedule.filter((F.col("start") <= last) & (F.col("stop") >= first))
    ips = over.select(F.explode(F.array_union("attackers", "victims")).alias("_ip")).distinct()
    return hosts.join(F.broadcast(ips), F.col(address) == F.col("_ip"), "left").withColumn("label", F.col("_ip").isNotNull().cast("int")).drop("_ip")

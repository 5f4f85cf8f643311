"""Packets to bidirectional flows and source hosts.

A flow's packets may be a third of the input, so they are ordered within time slices of
``slice_seconds``; slices give partial counts, sums and squared deviations, and only these meet per
flow, where the gaps between neighbouring slices are added. Inter-arrival figures are those of
sorted time. Null ports compare below all others. Lengths are summed as decimals, so no order of
rows or slices moves a sum across a threshold or parts equal ones.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import exact, flag_count, floor_one_ratio, guarded_rate
from tidemark.operators.chains import chain_starts, in_links
from tidemark.staging import staged

KEY = ("src", "dst", "portA", "portB", "proto")
_FLAGS = {"syn": "S", "ack": "A", "fin": "F", "rst": "R", "psh": "P"}


def keyed(packets: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Packets under their canonical key: the lesser (address, port) end first, by text order."""
    a = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port"))
    b = F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    lo, hi = F.least(a, b), F.greatest(a, b)
    flags = [flag_count(F.col("flags"), c).alias(f"_{k}") for k, c in _FLAGS.items()]
    return packets.select(
        *extra, lo["ip"].alias("src"), hi["ip"].alias("dst"), lo["port"].alias("portA"), hi["port"].alias("portB"), "proto", "ts", F.col("length").cast("double").alias("length"), *flags
    )


def _pooled(n: Column, mean: Column, m2: Column, whole: Column) -> Column:
    """Squared deviations of all parts from the mean of the whole."""
    return F.sum(m2 + n * (mean - whole) * (mean - whole))


def flow_features(packets: DataFrame, extra_keys: tuple[str, ...] = (), slice_seconds: float = 3600.0) -> DataFrame:
    """Flow rows: keys, ``t0`` and the 17 features. ``extra_keys`` are further grouping columns of ``packets``."""
    key = [*extra_keys, *KEY]
    rows = keyed(packets, extra_keys).withColumn("_slice", F.floor(F.col("ts") / slice_seconds))
    near = Window.partitionBy(*key, "_slice").orderBy("ts")
    gaps = rows.withColumn("_gap", F.col("ts") - F.lag("ts").over(near))
    parts = gaps.groupBy(*key, "_slice").agg(
        F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(exact(F.col("length"))).alias("exact"), F.count_if(F.col("length").isNotNull() & exact(F.col("length")).isNull()).alias("rough"),
        F.min("ts").alias("first"), F.max("ts").alias("last"), (F.var_pop("length") * F.count("length")).alias("len_m2"), F.min("length").alias("lo"), F.max("length").alias("hi"),
        F.count("_gap").alias("gaps"), F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("gap_mean"),
        F.coalesce(F.var_pop("_gap") * F.count("_gap"), F.lit(0.0)).alias("gap_m2"), *[F.sum(f"_{k}").alias(k) for k in _FLAGS],
    )
    flow = Window.partitionBy(*key)
    step = F.col("first") - F.lag("last").over(flow.orderBy("_slice"))
    total = F.sum("n").over(flow)
    joined = parts.withColumns({
        "step": step, "all_mean": F.sum("bytes").over(flow) / total,
        "all_gap": (F.max("last").over(flow) - F.min("first").over(flow)) / F.greatest(total - 1, F.lit(1)),
    })
    summed = joined.groupBy(*key).agg(
        F.min("first").alias("t0"), F.sum("n").alias("n_packets"), F.when(F.sum("rough") > 0, F.sum("bytes")).otherwise(F.sum("exact").cast("double")).alias("n_bytes"), (F.max("last") - F.min("first")).alias("duration"),
        F.min("lo").alias("min_len"), F.max("hi").alias("max_len"), _pooled(F.col("n"), F.col("bytes") / F.col("n"), F.col("len_m2"), F.col("all_mean")).alias("len_m2"),
        (_pooled(F.col("gaps"), F.col("gap_mean"), F.col("gap_m2"), F.col("all_gap")) + F.coalesce(F.sum((F.col("step") - F.col("all_gap")) * (F.col("step") - F.col("all_gap"))), F.lit(0.0))).alias("gap_m2"),
        *[F.sum(k).alias(k) for k in _FLAGS],
    )
    n, dur = F.col("n_packets"), F.col("duration")
    return summed.select(
        *key, "t0", "n_packets", "n_bytes", "duration", guarded_rate(F.col("n_bytes"), dur).alias("bytes_per_sec"), guarded_rate(n, dur).alias("pkts_per_sec"),
        (F.col("n_bytes") / n).alias("mean_len"), F.sqrt(F.col("len_m2") / n).alias("std_len"), "min_len", "max_len",
        F.when(n > 1, dur / (n - 1)).otherwise(0.0).alias("mean_iat"), F.when(n > 1, F.sqrt(F.col("gap_m2") / (n - 1))).otherwise(0.0).alias("std_iat"),
        *[(F.col(k) / n).alias(f"{k}_ratio") for k in _FLAGS], F.when((F.col("syn") > 0) & (F.col("ack") == 0), 1.0).otherwise(0.0).alias("syn_no_ack"),
    )


def summed_in_time(flows: DataFrame, packets: DataFrame, cuts: dict[str, set[float]], order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """``flows`` as whoever compares ``n_bytes`` and ``mean_len`` with ``cuts`` would have them from doubles added one by one in ``order``.

    Only flows whose exact sum is so near a cut that the rounding of doubles may cross it are added anew, a running sum each;
    on which side all others lie hangs on no order.
    """
    flows, _ = staged(flows, "flows")
    n = F.col("n_packets")
    # Far more than n additions lose by rounding.
    slack = 4 * n * n * F.greatest(F.abs("min_len"), F.abs("max_len")) * 2.0**-52
    near = F.lit(False)
    for name, whole in (("n_bytes", F.lit(1)), ("mean_len", n)):
        for cut in sorted(cuts.get(name, ())):
            near = near | (F.abs(F.col("n_bytes") - cut * whole) <= slack)
    same = lambda a, b: reduce(and_, [a[k].eqNullSafe(b[f"_{k}"]) for k in KEY])
    close = flows.filter(near).select(*[F.col(k).alias(f"_{k}") for k in KEY])
    rows = keyed(packets, tuple(c for c in order if c != "ts"))
    rows = rows.join(close, same(rows, close), "left_semi")
    run = F.sum("length").over(Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    added = rows.withColumn("_run", run).groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max_by("_run", F.struct(*order)).alias("_bytes"))
    joined = flows.join(added, same(flows, added), "left")
    changed = {"n_bytes": F.coalesce("_bytes", "n_bytes"), "mean_len": F.coalesce(F.col("_bytes") / n, "mean_len")}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in flows.columns])


def flow_onepass(packets: DataFrame) -> DataFrame:
    """Flow rows by one grouping of the packets as they come, without a sort: what needs no order of packets.

    ``std_len`` is the root of E[x2] - E[x]2, clamped at 0; the mean gap is that of the whole time span.
    """
    x = F.col("length")
    sums = keyed(packets).groupBy(*KEY).agg(
        F.min("ts").alias("t0"), F.count("*").alias("n_packets"), F.sum(x).alias("n_bytes"), (F.max("ts") - F.min("ts")).alias("duration"),
        F.sum(x * x).alias("_squares"), F.min(x).alias("min_len"), F.max(x).alias("max_len"), *[F.sum(f"_{k}").alias(k) for k in _FLAGS],
    )
    n, dur = F.col("n_packets"), F.col("duration")
    mean = F.col("n_bytes") / n
    return sums.select(
        *KEY, "t0", "n_packets", "n_bytes", "duration", guarded_rate(F.col("n_bytes"), dur).alias("bytes_per_sec"), guarded_rate(n, dur).alias("pkts_per_sec"), mean.alias("mean_len"),
        F.sqrt(F.greatest(F.col("_squares") / n - mean * mean, F.lit(0.0))).alias("std_len"), "min_len", "max_len", F.when(n > 1, dur / (n - 1)).otherwise(0.0).alias("mean_iat"),
        *[(F.col(k) / n).alias(f"{k}_ratio") for k in _FLAGS], F.when((F.col("syn") > 0) & (F.col("ack") == 0), 1.0).otherwise(0.0).alias("syn_no_ack"),
    )


def host_features(packets: DataFrame, max_ports: int | None = None) -> DataFrame:
    """Host rows by source address: ``src, t0`` and the 11 features; ``max_ports`` caps the port count.

    Distinct pairs are found first, so that a source with a third of all packets is pre-aggregated.
    """
    flags = {k: flag_count(F.col("flags"), c) for k, c in _FLAGS.items()}
    parts = packets.groupBy("src", "dst", "dport").agg(
        F.count("*").alias("n"), F.sum(F.col("length").cast("double")).alias("bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        *[F.sum(flags[k]).alias(k) for k in ("syn", "ack", "rst")],
    )
    summed = parts.groupBy("src").agg(
        F.min("first").alias("t0"), F.max("last").alias("t1"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.countDistinct("dst").alias("n_dst"),
        F.countDistinct("dport").alias("ports"), *[F.sum(k).alias(k) for k in ("syn", "ack", "rst")],
    )
    ports = F.col("ports") if max_ports is None else F.least(F.col("ports"), F.lit(max_ports))
    n = F.col("n")
    return summed.select(
        "src", "t0", n.alias("h_packets"), F.col("bytes").alias("h_bytes"), "n_dst", ports.alias("n_dports"), floor_one_ratio(ports, F.col("n_dst")).alias("dports_per_dst"),
        (F.col("syn") / n).alias("h_syn_ratio"), (F.col("ack") / n).alias("h_ack_ratio"), (F.col("rst") / n).alias("h_rst_ratio"),
        ((F.col("syn") - F.col("ack")) / n).alias("syn_ack_gap"), floor_one_ratio(n, F.col("n_dst")).alias("pkts_per_dst"),
        guarded_rate(n, F.col("t1") - F.col("t0")).alias("h_pkts_per_sec"),
    )


def host_rollup(flows: DataFrame) -> DataFrame:
    """Hosts from flow rows: sums by the flows' first address, distinct peers and service ports."""
    return flows.groupBy("src").agg(
        F.min("t0").alias("t0"), F.sum("n_packets").alias("h_packets"), F.sum("n_bytes").alias("h_bytes"), F.countDistinct("dst").alias("n_dst"),
        F.countDistinct("portB").alias("n_dports"), (F.max(F.col("t0") + F.col("duration")) - F.min("t0")).alias("seconds"),
    ).select("src", "t0", "h_packets", "h_bytes", "n_dst", "n_dports", floor_one_ratio(F.col("h_packets"), F.col("n_dst")).alias("pkts_per_dst"), guarded_rate(F.col("h_packets"), F.col("seconds")).alias("h_pkts_per_sec"))


def idle_sessions(packets: DataFrame, idle: float = 15.0, spans: int = 4096) -> DataFrame:
    """Flow keys cut into sessions where no packet came for more than ``idle`` seconds: ``session, t0, t1, n_packets``.

    Packets are cut into blocks of time; only a flow's sessions are numbered together.
    """
    links = chain_starts(keyed(packets), KEY, idle=idle, spans=spans)
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("start")) - 1
    return links.select(*KEY, number.cast("long").alias("session"), F.col("start").alias("t0"), F.col("last").alias("t1"), F.col("n").alias("n_packets"))


def active_sessions(packets: DataFrame, idle: float = 15.0, active: float = 120.0, spans: int = 64) -> DataFrame:
    """Flow keys cut as an extractor with two timeouts cuts them: ``t0, t1, n_packets``.

    A packet begins a new flow where none came for more than ``idle`` seconds, and where ``active`` seconds or
    more have passed since the first packet of the flow that is open; both clocks then start at this packet.
    """
    links = chain_starts(keyed(packets), KEY, span=active, idle=idle, spans=spans)
    return links.select(*KEY, F.col("start").alias("t0"), F.col("last").alias("t1"), F.col("n").alias("n_packets"))


def extracted_flows(packets: DataFrame, idle: float = 15.0, active: float = 120.0, grain: float = 3600.0, spans: int = 64) -> DataFrame:
    """The table of an extractor with timeouts, in milliseconds: ``src_ip, ..., bidirectional_packets, ...`` as ``flows_from_extractor`` reads it."""
    rows = keyed(packets)
    links = chain_starts(rows, KEY, span=active, idle=idle, spans=spans)
    held = in_links(rows, links, KEY, grain=grain)
    # An extracted flow is no longer than ``active`` seconds, so its packets may be ordered together.
    gap = (F.col("ts") - F.lag("ts").over(Window.partitionBy(*KEY, "start").orderBy("ts"))) * 1000
    b = lambda c, name: c.alias(f"bidirectional_{name}")
    made = held.withColumn("_gap", gap).groupBy(*KEY, "start").agg(
        b((F.max("ts") - F.min("ts")) * 1000, "duration_ms"), b(F.count("*"), "packets"), b(F.sum("length"), "bytes"), b(F.avg("length"), "mean_ps"),
        b(F.stddev_pop("length"), "stddev_ps"), b(F.min("length"), "min_ps"), b(F.max("length"), "max_ps"), b(F.coalesce(F.avg("_gap"), F.lit(0.0)), "mean_piat_ms"),
        b(F.coalesce(F.stddev_pop("_gap"), F.lit(0.0)), "stddev_piat_ms"), *[b(F.count_if(F.col(f"_{k}") > 0), f"{k}_packets") for k in _FLAGS],
    )
    return made.select(
        F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"), F.col("portA").alias("src_port"), F.col("portB").alias("dst_port"), F.col("proto").alias("protocol"),
        b(F.col("start") * 1000, "first_seen_ms"), *[c for c in made.columns if c.startswith("bidirectional_")],
    )

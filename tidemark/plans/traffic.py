"""Queries over packets, flows, hosts, windows and attack schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.operators import flows, labels, stats, windows
from tidemark.plans.inputs import SECONDS, Registry, duck, flows_duck, r4_sql, rounded, view
from tidemark.schemas import FLOW_FEATURES, HOST_FEATURES
from tidemark.sources import captures
from tidemark.sources.packets import flows_from_extractor, parse_tcpdump
from tidemark.staging import fresh_path

R = Registry()
FL_COLS = "src, dst, portA, portB, proto, t0, CAST(n_packets AS BIGINT) AS n_packets, " + r4_sql(*[c for c in FLOW_FEATURES if c != "n_packets"])


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.flow_features(view(spark, sf_dir, "packets"))


@R.add(duck("packets", then="SELECT event_id, round(ts, 6) AS ts, src, dst, proto, length, sport, dport, flags FROM packets"))
def packet_view(spark, sf_dir):
    return view(spark, sf_dir, "packets").select("event_id", F.round("ts", 6).alias("ts"), "src", "dst", "proto", "length", "sport", "dport", "flags")


@R.add(duck("packets", then="SELECT round(ts, 6) AS ts, src, dst, 6 AS proto, CAST(floor(length) AS INT) AS length, sport, dport, replace(flags, 'A', '.') AS flags FROM packets"))
def tcpdump_text_parse(spark, sf_dir):
    p = view(spark, sf_dir, "packets")
    line = F.format_string("%.6f IP %s.%d > %s.%d: Flags [%s], length %d", "ts", "src", "sport", "dst", "dport", F.replace("flags", F.lit("A"), F.lit(".")), F.floor("length").cast("int"))
    return parse_tcpdump(p.select(line.alias("value")).union(p.select(F.lit("ARP, Request who-has").alias("value")).limit(3)))


@R.add(duck("packets", then="SELECT round(ts, 6) AS ts, src, dst, 6 AS proto, CAST(greatest(54, floor(length)) AS INT) AS length, sport, dport, flags FROM packets"))
def pcap_packets(spark, sf_dir):
    """Packets through captures: written by two tasks, read in ranges of 64 KB."""
    path = fresh_path(spark, "pcap")
    p = view(spark, sf_dir, "packets")
    captures.write_pcap(p.withColumn("length", F.floor("length").cast("int")).repartition(2, "event_id"), path)
    return captures.read_pcap(spark, path, split_bytes=1 << 16).withColumn("ts", F.round("ts", 6))


@R.add(flows_duck(then=f"SELECT {FL_COLS} FROM flows"))
def flow_features(spark, sf_dir):
    return _rounded_flows(_flows(spark, sf_dir))


def _rounded_flows(df):
    t0 = F.col("t0")
    return rounded(df.withColumn("t0", t0.cast("string"))).withColumn("t0", F.col("t0").cast("double"))


@R.add(duck("packets", then="""SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*) AS n_packets, round(sum(length) + 1e-7, 4) AS n_bytes, round(sqrt(greatest(avg(length * length) - avg(length) ** 2, 0)) + 1e-7, 3) AS std_len,
  round(CASE WHEN count(*) > 1 THEN (max(ts) - min(ts)) / (count(*) - 1) ELSE 0 END + 1e-7, 3) AS mean_iat, round(avg((flags = 'S')::INT) + 1e-7, 4) AS syn_ratio FROM packets GROUP BY 1, 2, greatest(sport, dport), proto"""))
def flow_onepass(spark, sf_dir):
    f = flows.flow_onepass(view(spark, sf_dir, "packets"))
    r3 = lambda c: F.round(F.col(c) + 1e-7, 3).alias(c)
    return f.select("src", "dst", "n_packets", F.round(F.col("n_bytes") + 1e-7, 4).alias("n_bytes"), r3("std_len"), r3("mean_iat"), F.round(F.col("syn_ratio") + 1e-7, 4).alias("syn_ratio"))


@R.add(duck("packets", then="SELECT src, least(count(DISTINCT dport), 5) AS n_dports, round(least(count(DISTINCT dport), 5) / greatest(1, count(DISTINCT dst)) + 1e-7, 4) AS dports_per_dst FROM packets GROUP BY 1"))
def host_port_cap(spark, sf_dir):
    return rounded(flows.host_features(view(spark, sf_dir, "packets"), max_ports=5).select("src", "n_dports", "dports_per_dst"))


@R.add(flows_duck(then=f"SELECT {FL_COLS} FROM flows ORDER BY flows.n_bytes DESC, flows.src, flows.dst, flows.portA, flows.portB LIMIT 10"))
def flow_topk(spark, sf_dir):
    return _rounded_flows(_flows(spark, sf_dir).orderBy(F.desc("n_bytes"), "src", "dst", "portA", "portB").limit(10))


HOST_SQL = """SELECT src, min(ts) AS t0, count(*) AS h_packets, round(sum(length) + 1e-7, 4) AS h_bytes, count(DISTINCT dst) AS n_dst, count(DISTINCT dport) AS n_dports,
  round(count(DISTINCT dport) / greatest(1, count(DISTINCT dst)) + 1e-7, 4) AS dports_per_dst,
  round(sum(s) / count(*) + 1e-7, 4) AS h_syn_ratio, round(sum(a) / count(*) + 1e-7, 4) AS h_ack_ratio, round(sum(r) / count(*) + 1e-7, 4) AS h_rst_ratio,
  round((sum(s) - sum(a)) / count(*) + 1e-7, 4) AS syn_ack_gap, round(count(*) / greatest(1, count(DISTINCT dst)) + 1e-7, 4) AS pkts_per_dst,
  round(CASE WHEN max(ts) > min(ts) THEN count(*) / (max(ts) - min(ts)) ELSE count(*) END + 1e-7, 4) AS h_pkts_per_sec
  FROM (SELECT *, (flags = 'S')::INT AS s, (flags LIKE '%A%')::INT AS a, (flags = 'R')::INT AS r FROM packets) p GROUP BY src"""


@R.add(duck("packets", then=HOST_SQL))
def host_profiles(spark, sf_dir):
    return _rounded_flows(flows.host_features(view(spark, sf_dir, "packets"))).select("src", "t0", *HOST_FEATURES)


@R.add(flows_duck(then="""SELECT src, min(t0) AS t0, CAST(sum(n_packets) AS BIGINT) AS h_packets, round(sum(n_bytes) + 1e-7, 4) AS h_bytes, count(DISTINCT dst) AS n_dst, count(DISTINCT portB) AS n_dports,
  round(sum(n_packets) / greatest(1, count(DISTINCT dst)) + 1e-7, 4) AS pkts_per_dst,
  round(CASE WHEN max(t0 + duration) > min(t0) THEN sum(n_packets) / (max(t0 + duration) - min(t0)) ELSE sum(n_packets) END + 1e-7, 4) AS h_pkts_per_sec FROM flows GROUP BY src"""))
def host_rollup(spark, sf_dir):
    return _rounded_flows(flows.host_rollup(_flows(spark, sf_dir)))


# Timeouts of ten days and of four, as a flow's events are days apart.
IDLE, ACTIVE = 864000.0, 345600.0
_SESSIONS = """, k AS (SELECT *, ts - lag(ts) OVER (PARTITION BY src, dst, portA, portB, proto ORDER BY ts) AS gap FROM (
    SELECT CASE WHEN ab THEN src ELSE dst END AS src, CASE WHEN ab THEN dst ELSE src END AS dst, CASE WHEN ab THEN sport ELSE dport END AS portA,
           CASE WHEN ab THEN dport ELSE sport END AS portB, proto, ts, length, flags FROM (SELECT *, src < dst OR (src = dst AND sport <= dport) AS ab FROM packets) p) q),
  begun AS (
    SELECT src, dst, portA, portB, proto, min(ts) AS w FROM k GROUP BY ALL
    UNION ALL
    SELECT src, dst, portA, portB, proto, (SELECT min(p.ts) FROM k p WHERE p.src = s.src AND p.dst = s.dst AND p.portA = s.portA AND p.portB = s.portB AND p.proto = s.proto
      AND p.ts > s.w AND (p.ts - s.w >= 345600 OR p.gap > 864000)) FROM begun s WHERE s.w IS NOT NULL),
  spans AS (SELECT *, lead(w) OVER (PARTITION BY src, dst, portA, portB, proto ORDER BY w) AS nxt FROM begun WHERE w IS NOT NULL),
  parts AS (SELECT k.*, b.w AS t0 FROM k JOIN spans b USING (src, dst, portA, portB, proto) WHERE k.ts >= b.w AND (b.nxt IS NULL OR k.ts < b.nxt)) """


@R.add(duck("packets", then=_SESSIONS + "SELECT src, dst, portA, portB, proto, t0, max(ts) AS t1, count(*) AS n_packets FROM parts GROUP BY src, dst, portA, portB, proto, t0"))
def active_sessions(spark, sf_dir):
    return flows.active_sessions(view(spark, sf_dir, "packets"), IDLE, ACTIVE)


_LETTER = lambda c: f"count(*) FILTER (WHERE flags LIKE '%{c}%')"


@R.add(duck("packets", then=_SESSIONS + f""", x AS (SELECT *, CASE WHEN ts > t0 THEN gap END AS piat FROM parts),
  g AS (SELECT src, dst, portA, portB, proto, t0, count(*) AS n_packets, sum(length) AS n_bytes, max(ts) - min(ts) AS duration, avg(length) AS mean_len, stddev_pop(length) AS std_len,
    min(length) AS min_len, max(length) AS max_len, coalesce(avg(piat), 0) AS mean_iat, coalesce(stddev_pop(piat), 0) AS std_iat,
    {_LETTER('S')} AS s, {_LETTER('A')} AS a, {_LETTER('F')} AS f, {_LETTER('R')} AS r, {_LETTER('P')} AS p FROM x GROUP BY src, dst, portA, portB, proto, t0)
  SELECT src, dst, portA, portB, proto, n_packets, round(t0, 6) AS t0, {r4_sql('n_bytes', 'duration', 'mean_len', 'std_len', 'min_len', 'max_len')}, round(mean_iat + 1e-7, 3) AS mean_iat, round(std_iat + 1e-7, 3) AS std_iat,
    round(n_bytes / CASE WHEN duration > 0 THEN duration ELSE 1 END + 1e-7, 4) AS bytes_per_sec, round(n_packets / CASE WHEN duration > 0 THEN duration ELSE 1 END + 1e-7, 4) AS pkts_per_sec,
    round(s / n_packets + 1e-7, 4) AS syn_ratio, round(a / n_packets + 1e-7, 4) AS ack_ratio, round(f / n_packets + 1e-7, 4) AS fin_ratio, round(r / n_packets + 1e-7, 4) AS rst_ratio,
    round(p / n_packets + 1e-7, 4) AS psh_ratio, CASE WHEN s > 0 AND a = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS syn_no_ack FROM g"""))
def extractor_flows(spark, sf_dir):
    f = flows_from_extractor(flows.extracted_flows(view(spark, sf_dir, "packets"), IDLE, ACTIVE, grain=43200.0))
    places = {"t0": 6, "mean_iat": 3, "std_iat": 3}
    return f.select(*[F.round(F.col(c) + (0 if c == "t0" else 1e-7), places.get(c, 4)).alias(c) if t == "double" else c for c, t in f.dtypes])


@R.add(flows_duck(then="SELECT src, dst, portA, portB, round(CASE WHEN std_iat > 0 THEN duration / std_iat ELSE 0 END + 1e-7, 4) AS clean FROM flows"))
def clean_nonfinite(spark, sf_dir):
    odd = F.when(F.col("std_iat") > 1e-9, F.col("duration") / F.col("std_iat")).when(F.col("n_packets") == 1, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return rounded(_flows(spark, sf_dir).select("src", "dst", "portA", "portB", finite(odd).alias("clean")))


_Z = ("n_packets", "n_bytes", "mean_len")


@R.add(flows_duck(then="SELECT src, dst, portA, portB, " + ", ".join(f"round((f.{c} - avg(f.{c}) OVER ()) / stddev_pop(f.{c}) OVER () + 1e-7, 4) AS {c}" for c in _Z) + " FROM flows f"))
def zscore_flow(spark, sf_dir):
    return rounded(stats.zscore(_flows(spark, sf_dir), _Z).select("src", "dst", "portA", "portB", *_Z))


FL_SENSOR = "'s' || CAST(portA % 3 AS VARCHAR)"


def _windowed(spark, sf_dir):
    f = _flows(spark, sf_dir).withColumn("sensor", F.concat(F.lit("s"), (F.col("portA") % 3).cast("string")))
    return windows.pool_windows(f, "flow", SECONDS)


_WID = f"strftime(make_timestamp(CAST(floor(t0 / 780) * 780000000 AS BIGINT)), '%Y%m%dT%H%M%SZ') || '-' || {FL_SENSOR} || '-flow'"


@R.add(flows_duck(then=f"SELECT src, dst, portA, portB, t0, CAST(floor(t0 / 780) AS BIGINT) AS bucket, {_WID} AS window_id FROM flows"))
def pool_windows(spark, sf_dir):
    return _windowed(spark, sf_dir).select("src", "dst", "portA", "portB", "t0", "bucket", "window_id")


@R.add(flows_duck(then=f"""SELECT {_WID} AS window_id, {FL_SENSOR} AS sensor, CAST(floor(t0 / 780) AS BIGINT) AS bucket, CAST(floor(t0 / 780) * 780 AS BIGINT) AS t_start,
  CAST((floor(t0 / 780) + 1) * 780 AS BIGINT) AS t_end, count(*) AS n_rows, min(t0) AS first_t0, max(t0) AS last_t0 FROM flows GROUP BY 1, 2, 3, 4, 5"""))
def pool_index(spark, sf_dir):
    return windows.pool_index(_windowed(spark, sf_dir), SECONDS)


# Windows of six hours, as events are minutes apart.
_ANCHOR = """, starts AS (
  SELECT sensor, min(ts) AS w FROM packets GROUP BY sensor
  UNION ALL
  SELECT s.sensor, (SELECT min(p.ts) FROM packets p WHERE p.sensor = s.sensor AND p.ts - s.w >= 21600) FROM starts s WHERE s.w IS NOT NULL
), bounds AS (SELECT sensor, w, lead(w) OVER (PARTITION BY sensor ORDER BY w) AS nxt FROM starts WHERE w IS NOT NULL),
placed AS (SELECT p.*, b.w AS w_start FROM packets p JOIN bounds b ON p.sensor = b.sensor AND p.ts >= b.w AND (b.nxt IS NULL OR p.ts < b.nxt)) """


@R.add(duck("packets", then=_ANCHOR + "SELECT sensor, w_start, max(ts) AS w_last, count(*) AS n_packets FROM placed GROUP BY sensor, w_start"))
def anchored_windows(spark, sf_dir):
    return windows.anchored_windows(view(spark, sf_dir, "packets"), 21600.0)


@R.add(duck("packets", then=_ANCHOR + """SELECT sensor, w_start, src, count(*) AS n_packets, round(sum(length) + 1e-7, 4) AS n_bytes FROM placed
  WHERE (sensor, w_start) IN (SELECT (sensor, w_start) FROM placed GROUP BY sensor, w_start HAVING count(*) >= 3) GROUP BY sensor, w_start, src"""))
def anchored_host_rows(spark, sf_dir):
    held = windows.in_anchored_windows(view(spark, sf_dir, "packets"), 21600.0)
    return held.groupBy("sensor", "w_start", "src").agg(F.count("*").alias("n_packets"), F.round(F.sum("length") + 1e-7, 4).alias("n_bytes"))


@R.add(duck("packets", then=_ANCHOR + """, w AS (SELECT sensor, w_start, least(src, dst) AS src, greatest(src, dst) AS dst, sport + dport AS ports, length, count(*) OVER (PARTITION BY sensor, w_start) AS held FROM placed)
  SELECT sensor, w_start, src, dst, count(*) AS n_packets, round(sum(length) + 1e-7, 4) AS n_bytes FROM w WHERE held >= 3 GROUP BY sensor, w_start, src, dst, ports"""))
def anchored_flow_rows(spark, sf_dir):
    """A flow that crosses the end of an anchored window gives one row per window."""
    f = flows.flow_features(windows.in_anchored_windows(view(spark, sf_dir, "packets"), 21600.0), ("sensor", "w_start"))
    return f.select("sensor", "w_start", "src", "dst", "n_packets", F.round(F.col("n_bytes") + 1e-7, 4).alias("n_bytes"))


@R.add(flows_duck(then=f""", w AS (SELECT {_WID} AS window_id, src, dst, portA, portB, n_bytes FROM flows)
  SELECT window_id, src, dst, round(n_bytes + 1e-7, 4) AS n_bytes, place FROM (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY n_bytes DESC, src, dst, portA, portB) AS place FROM w) r WHERE place <= 2"""))
def window_top(spark, sf_dir):
    return rounded(windows.top_per_window(_windowed(spark, sf_dir), "n_bytes", 2, ("src", "dst", "portA", "portB")).select("window_id", "src", "dst", "n_bytes", "place"))


@R.add(duck("packets", then=""", r AS (SELECT event_id, sensor, CAST(floor((event_id * 7919 % 1009) / 50) AS BIGINT) AS frame, CAST(floor(event_id / 97) % 40 AS BIGINT) AS bucket FROM packets),
  tops AS (SELECT sensor, frame, max(bucket) AS top FROM r GROUP BY 1, 2), firsts AS (SELECT sensor, bucket, min(frame) AS f0 FROM r GROUP BY 1, 2),
  closes AS (SELECT f.sensor, f.bucket, min(t.frame) AS shut FROM firsts f JOIN tops t ON t.sensor = f.sensor AND t.frame >= f.f0 AND t.top > f.bucket GROUP BY 1, 2)
  SELECT r.event_id, r.frame, r.bucket, coalesce(r.frame > c.shut, false) AS late FROM r LEFT JOIN closes c ON c.sensor = r.sensor AND c.bucket = r.bucket"""))
def late_rows(spark, sf_dir):
    p = view(spark, sf_dir, "packets").select(
        "event_id", "sensor", F.floor((F.col("event_id") * 7919 % 1009) / 50).alias("frame"), (F.floor(F.col("event_id") / 97) % 40).alias("bucket")
    )
    return windows.late_rows(p).select("event_id", "frame", "bucket", "late")


@R.add(duck("packets", then=""", k AS (SELECT CASE WHEN src < dst THEN src ELSE dst END AS src, CASE WHEN src < dst THEN dst ELSE src END AS dst, CASE WHEN src < dst THEN sport ELSE dport END AS portA,
  CASE WHEN src < dst THEN dport ELSE sport END AS portB, proto, ts FROM packets),
  c AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > 86400 THEN 1 ELSE 0 END AS cut FROM k WINDOW w AS (PARTITION BY src, dst, portA, portB, proto ORDER BY ts)),
  s AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY src, dst, portA, portB, proto ORDER BY ts) AS BIGINT) AS session FROM c)
  SELECT src, dst, portA, portB, proto, session, min(ts) AS t0, max(ts) AS t1, count(*) AS n_packets FROM s GROUP BY ALL"""))
def idle_sessions(spark, sf_dir):
    return flows.idle_sessions(view(spark, sf_dir, "packets"), 86400.0)


_VISTA, _OUT = "10.1.0.3", "10.0.0.7"
SCHEDULE = [
    ("2024-01-02", "00:00", "23:00", "early", [_OUT, "10.0.0.9"], []), ("2024-01-02", "06:00", "23:59", "second", [_OUT], [_VISTA]),
    ("2024-01-05", "00:00", "20:00", "inner", [_VISTA], ["10.0.0.11", "10.0.0.12", "10.0.0.13"]), ("2024-01-09", "00:00", "23:59", "wide", [_VISTA, "10.1.0.4"], []),
]
SCHEDULE_SQL = """, sched AS (SELECT * FROM (VALUES
  (0, 1704164400.0, 1704247200.0, 'early', ['10.0.0.7', '10.0.0.9'], []::VARCHAR[]), (1, 1704186000.0, 1704250740.0, 'second', ['10.0.0.7'], ['10.1.0.3']),
  (2, 1704423600.0, 1704495600.0, 'inner', ['10.1.0.3'], ['10.0.0.11', '10.0.0.12', '10.0.0.13']), (3, 1704769200.0, 1704855540.0, 'wide', ['10.1.0.3', '10.1.0.4'], []::VARCHAR[])) AS t(pos, start, stop, name, att, vic)) """


@R.add(duck("packets", then=SCHEDULE_SQL + """SELECT p.event_id, (SELECT min_by(s.name, s.pos) FROM sched s WHERE p.ts BETWEEN s.start AND s.stop AND
  ((list_contains(s.att, p.src) AND (len(s.vic) = 0 OR list_contains(s.vic, p.dst))) OR (list_contains(s.att, p.dst) AND (len(s.vic) = 0 OR list_contains(s.vic, p.src))))) AS attack FROM packets p"""))
def interval_label(spark, sf_dir):
    return labels.label_flows(view(spark, sf_dir, "packets"), labels.compile_schedule(spark, SCHEDULE), "ts").select("event_id", "attack")


@R.add(duck("packets", then=SCHEDULE_SQL + """, ips AS (SELECT DISTINCT unnest(list_concat(att, vic)) AS ip FROM sched WHERE start <= 1704500000 AND stop >= 1704180000)
  SELECT src, count(*) AS n, CAST(src IN (SELECT ip FROM ips) AS INT) AS label FROM packets GROUP BY src"""))
def host_attack_label(spark, sf_dir):
    hosts = view(spark, sf_dir, "packets").groupBy("src").agg(F.count("*").alias("n"))
    return labels.attack_hosts(hosts, labels.compile_schedule(spark, SCHEDULE), 1704180000.0, 1704500000.0)

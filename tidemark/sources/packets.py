"""Packet sources: tcpdump text, flow tables of an external extractor, CSV, and a demo capture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import floor_one_ratio, guarded_rate

_LINE = r"^(\d+\.\d+) IP6? (\S+) > (\S+): (?:Flags \[([^\]]*)\])?.*?length (\d+)"


def parse_tcpdump(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Packets of ``tcpdump -nn -tt`` lines; other lines are dropped. An end is ``address.port`` or an address."""
    part = lambda i: F.regexp_extract(text_col, _LINE, i)
    found = lines.filter(F.col(text_col).rlike(_LINE)).select(
        part(1).cast("double").alias("ts"), part(2).alias("a"), part(3).alias("b"), part(4).alias("flags"), part(5).cast("int").alias("length")
    )

    def host(c):
        return F.when(c.rlike(r"^\d+\.\d+\.\d+\.\d+$"), c).otherwise(F.regexp_extract(c, r"^(.*)\.\d+$", 1))

    def port(c):
        return F.when(~c.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.regexp_extract(c, r"\.(\d+)$", 1).try_cast("int"))

    return found.select(
        "ts", host(F.col("a")).alias("src"), host(F.col("b")).alias("dst"), F.when(F.col("flags") != "", 6).otherwise(17).alias("proto"),
        "length", port(F.col("a")).alias("sport"), port(F.col("b")).alias("dport"), "flags",
    )


def read_tcpdump(spark: SparkSession, path: str) -> DataFrame:
    return parse_tcpdump(spark.read.text(path))


def flows_from_extractor(raw: DataFrame) -> DataFrame:
    """Flow rows from a table of bidirectional flows in milliseconds (``src_ip``, ``bidirectional_packets``, ...)."""
    b = lambda name: F.col(f"bidirectional_{name}")
    seconds, n = b("duration_ms") / 1000.0, b("packets")
    part = lambda flag: floor_one_ratio(b(f"{flag}_packets"), n)
    return raw.select(
        F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), F.col("src_port").alias("portA"), F.col("dst_port").alias("portB"),
        F.col("protocol").alias("proto"), (b("first_seen_ms") / 1000.0).alias("t0"), n.alias("n_packets"), b("bytes").alias("n_bytes"),
        seconds.alias("duration"), guarded_rate(b("bytes"), seconds).alias("bytes_per_sec"), guarded_rate(n, seconds).alias("pkts_per_sec"),
        b("mean_ps").alias("mean_len"), b("stddev_ps").alias("std_len"), b("min_ps").alias("min_len"), b("max_ps").alias("max_len"),
        (b("mean_piat_ms") / 1000.0).alias("mean_iat"), (b("stddev_piat_ms") / 1000.0).alias("std_iat"), part("syn").alias("syn_ratio"),
        part("ack").alias("ack_ratio"), part("fin").alias("fin_ratio"), part("rst").alias("rst_ratio"), part("psh").alias("psh_ratio"),
        F.when((b("syn_packets") > 0) & (b("ack_packets") == 0), 1.0).otherwise(0.0).alias("syn_no_ack"),
    )


def demo_packets(spark: SparkSession, clients: int = 5, scan_ports: int = 399, exfil: int = 300) -> DataFrame:
    """A deterministic capture: clients over HTTPS, one SYN scan and one exfiltration."""
    web = spark.range(clients * 40).select(
        (F.lit(1.7e9) + F.col("id") * 0.25).alias("ts"), F.format_string("10.0.0.%d", 10 + F.col("id") % clients).alias("src"), F.lit("93.184.216.34").alias("dst"),
        F.lit(6).alias("proto"), (F.lit(60) + F.col("id") * 37 % 1200).cast("int").alias("length"), (F.lit(40000) + F.col("id") % clients).cast("int").alias("sport"), F.lit(443).alias("dport"),
        F.when(F.col("id") < clients, "S").otherwise("PA").alias("flags"),
    )
    scan = spark.range(1, scan_ports + 1).select(
        (F.lit(1.7e9 + 20) + F.col("id") * 0.002).alias("ts"), F.lit("10.0.0.66").alias("src"), F.lit("10.0.0.1").alias("dst"), F.lit(6).alias("proto"),
        F.lit(40).alias("length"), F.lit(51000).alias("sport"), F.col("id").cast("int").alias("dport"), F.lit("S").alias("flags"),
    )
    leak = spark.range(exfil).select(
        (F.lit(1.7e9 + 30) + F.col("id") * 0.01).alias("ts"), F.lit("10.0.0.12").alias("src"), F.lit("185.220.101.1").alias("dst"), F.lit(6).alias("proto"),
        F.lit(1400).alias("length"), F.lit(52000).alias("sport"), F.lit(8443).alias("dport"), F.lit("PA").alias("flags"),
    )
    return web.unionByName(scan).unionByName(leak)


def read_headerless_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file without header under a stated schema, as the labelled connection records have."""
    return spark.read.csv(path, schema=schema, header=False)


def read_headed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of a CSV file by their names in its first line, white space around names left out, as flow exports have them.

    ``schema`` names the columns that are wanted; a value that is no number of its type is null.
    """
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.strip(): c for c in raw.columns}
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*[F.expr(f"try_cast(`{named[f.name]}` AS {f.dataType.simpleString()})").alias(f.name) for f in wanted])

"""Captures cut at every byte against a reader that starts at the front, with captures inside packets."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.sources import captures
from tidemark.sources import packets as sources

ROWS = [(1.7e9 + i * 0.25, f"10.0.0.{i % 7}", "10.1.0.2", (6, 17, 1)[i % 3], 60 + i % 40, 1000 + i, 443, "SA" if i % 3 == 0 else "") for i in range(40)]


def record(sec, data, order="<"):
    return struct.pack(order + "IIII", sec, 5, len(data), len(data)) + data


def front_reader(body):
    """Places of all records, one after the other."""
    at, out = captures.HEAD, []
    while at + 16 <= len(body):
        out.append(at)
        at += 16 + struct.unpack_from("<I", body, at + 8)[0]
    return out


def head(order="<", link=1):
    return struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)


@pytest.fixture(scope="module")
def body():
    inner = captures.encode(ROWS[:12])  # records inside a packet, up to its very end
    frame = b"\0" * 12 + b"\x08\x06" + inner
    return head() + captures.encode(ROWS[:20]) + record(1700000010, frame) + captures.encode(ROWS[20:]) + record(1700000099, b"x" * 40)[:-25]


def test_every_cut_gives_the_rows_of_the_whole_file(spark, tmp_path, body):
    path = str(tmp_path / "x.pcap")
    (tmp_path / "x.pcap").write_bytes(body)
    want = front_reader(body)
    for split in (64, 301, len(body)):
        ranges = captures.capture_ranges(spark, path, split)
        found = ranges.orderBy("k").collect()
        assert [r["k"] for r in found] == list(range(-(-len(body) // split)))
        assert [r["n"] for r in found] == [sum(r["low"] <= a < r["high"] for a in want) for r in found]
        got = sorted(map(tuple, captures.read_ranges(ranges).collect()))
        assert [r[0] for r in got] == [r[0] for r in ROWS] and [r[4] for r in got] == [max(r[4], 54 if r[3] == 6 else 38) for r in ROWS]


def test_one_cut_at_each_byte(spark, tmp_path, body):
    """A range from each byte on, entered where the range before it left, begins at the next record."""
    (tmp_path / "x.pcap").write_bytes(body)
    want = front_reader(body)
    with captures.opened(str(tmp_path / "x.pcap")) as file:
        kind, pages = captures.Kind.of(file), captures._Pages(file)
        ends = {at: at + 16 + kept for at, kept in captures._follow(pages, kind, captures.HEAD, len(body))}
        assert list(ends) == want
        for cut in range(captures.HEAD + 1, len(body)):
            first = [at for at, _ in captures._follow(pages, kind, captures.HEAD, cut)]
            rest = [at for at, _ in captures._follow(pages, kind, ends[first[-1]], len(body))]
            assert first + rest == want
        inside = body.index(captures.encode(ROWS[:12]), 24 + len(captures.encode(ROWS[:20])))
        assert captures.resynchronise(pages, kind, inside, len(body)) == inside  # a guess that only the range before can refute


def test_byte_orders_links_and_broken_frames():
    ip = bytes([0x45, 0, 0, 44, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HHIIBB", 51514, 443, 0, 0, 0x50, 0x12) + b"\0" * 8
    tagged = b"\0" * 12 + b"\x81\x00\x00\x05\x08\x00" + ip
    for order, link, frame, rows in ((">", 101, ip, 1), ("<", 1, tagged, 1), ("<", 1, b"\0" * 13, 0), ("<", 1, b"\0" * 12 + b"\x86\xdd" + ip, 0), ("<", 101, ip[:19], 0), ("<", 101, ip[:22], 1)):
        data = record(1700000000, frame, order)
        kind = captures.Kind(order, 10**6, link, 65535, 1700000000)
        got = captures.decode(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(frame)]), kind).to_pylist()
        assert len(got) == rows
        if rows:
            assert (got[0]["src"], got[0]["ts"], got[0]["length"]) == ("10.0.0.1", 1700000000.000005, len(frame))
            assert (got[0]["sport"], got[0]["flags"]) == ((51514, "SA") if len(frame) > 24 else (None, ""))
    with pytest.raises(ValueError):
        captures.Kind.of(pa.PythonFile(__import__("io").BytesIO(b"nothing like a capture at all"), mode="r"))


def test_written_captures_come_back(spark, tmp_path):
    p = sources.demo_packets(spark).withColumn("length", F.greatest("length", F.lit(54)))
    files = captures.write_pcap(p.repartition(3, "src"), str(tmp_path / "out")).collect()
    assert sum(r["n"] for r in files) == p.count() and len(list((tmp_path / "out").iterdir())) == 3
    back = captures.read_pcap(spark, str(tmp_path / "out"), split_bytes=5000)
    r6 = lambda df: df.withColumn("ts", F.round("ts", 5))
    assert r6(back).exceptAll(r6(p)).count() == 0 and back.count() == p.count()
    assert back.rdd.getNumPartitions() > 10
    (tmp_path / "none").mkdir()
    (tmp_path / "none/empty.pcap").write_bytes(head())
    assert captures.read_pcap(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("few", [100, 0])
def test_ends_that_do_not_fit_come_back(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(captures, "FEW_NAMES", few)
    ends = [("10.0.0.1499", 41499), ("10.0.0.7", 70007), ("10.0.0.1499", 141499), ("240.0.0.0", 80), ("010.0.0.1", 1), ("host", 65535), ("1.2.3", 0), ("10.0.0.7", -5), (None, 9), ("10.0.0.7", 443)]
    rows = [(1.7e9 + i, *a, *ends[i * 7 % 10]) for i, a in enumerate(ends * 2)]
    p = spark.createDataFrame(rows, "ts double, src string, sport int, dst string, dport int").selectExpr("ts", "src", "dst", "6 AS proto", "60 AS length", "sport", "dport", "'SA' AS flags")
    path = str(tmp_path / "out")
    assert sum(r["n"] for r in captures.write_pcap(p.repartition(3), path).collect()) == 20
    assert len(list((tmp_path / "out").iterdir())) == 3
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(captures.read_pcap(spark, path, split_bytes=300)) == key(p)

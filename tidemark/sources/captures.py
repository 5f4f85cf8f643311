"""Packet captures read by byte range: one capture is many tasks, and every packet is read once.

A record header says only where the next one is, so a range that begins inside a file must find one. It takes
the first offset from which a run of plausible headers follows; that may be a capture inside a packet, so it is
a guess only. Each range reports where its chain of records begins and where it leaves the range, and a range
counts once its begin is where the range before it left; others are followed anew from there. By induction the
table of ranges is that of a reader that began at the front of the file, whatever the packets hold.

Files are opened through ``pyarrow.fs``, so they may lie on any store that it knows.

A capture holds four bytes of an address and two of a port. An end that does not fit, by its name or by a larger
port, is written under an address of the reserved block 240.0.0.0/4 with the low bits of its port; the table of
these names lies beside the captures, as a hosts file does, and readers put the names back.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.explore import numbered
from tidemark.schemas import PACKET
from tidemark.staging import opened, staged

# Magic numbers with byte order and ticks a second, TCP flags by bit, the largest frame that capture tools write.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 10**6), b"\xa1\xb2\xc3\xd4": (">", 10**6), b"\x4d\x3c\xb2\xa1": ("<", 10**9), b"\xa1\xb2\x3c\x4d": (">", 10**9)}
_FLAGS = ((1, "F"), (2, "S"), (4, "R"), (8, "P"), (16, "A"), (32, "U"), (64, "E"), (128, "C"))
MAX_FRAME = 262_144

HEAD, RECORD, ETHERNET = 24, 16, 1
#: Tables of at most so many names are broadcast.
FEW_NAMES = 200_000
_RESERVED, _OCTET = 240 << 24, r"\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PLAIN = r"\A(?:2[0-3]\d|1\d\d|[1-9]?\d)(?:" + _OCTET + r"){3}\z"
_ENDS = (("src", "sport"), ("dst", "dport"))
_FLAG_NAMES = pa.array(["".join(name for bit, name in _FLAGS if value & bit) for value in range(256)])
_READ = 8 << 20


@dataclass(frozen=True)
class Kind:
    """What the head of a capture says, with the time of its first record."""

    order: str
    ticks: int
    link: int
    limit: int
    first_sec: int

    @classmethod
    def of(cls, file: pa.NativeFile) -> Kind:
        head = file.read_at(min(HEAD + 4, file.size()), 0)
        if head[:4] not in _MAGIC or len(head) < HEAD:
            raise ValueError("not a pcap file")
        order, ticks = _MAGIC[head[:4]]
        snap, link = struct.unpack_from(order + "II", head, 16)
        first = struct.unpack_from(order + "I", head, HEAD)[0] if len(head) == HEAD + 4 else 0
        return cls(order, ticks, link & 0x0FFFFFFF, snap if 0 < snap < MAX_FRAME else MAX_FRAME, first)


class _Pages:
    """Bytes of a file around the place that was asked for last."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.data = file, file.size(), 0, b""

    def get(self, at: int, n: int) -> memoryview:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.at, self.data = at, self.file.read_at(min(max(n, _READ), self.size - at), at)
        return memoryview(self.data)[at - self.at : at - self.at + n]


def _follow(pages: _Pages, kind: Kind, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """Place and captured length of the records that begin in ``[at, stop)``; a last one may be cut short by the end of the file."""
    length = struct.Struct(kind.order + "I")
    while at < stop and at + RECORD <= pages.size:
        (kept,) = length.unpack(pages.get(at + 8, 4))
        yield at, kept
        at += RECORD + kept


def plausible(data: bytes, kind: Kind) -> np.ndarray:
    """Whether a record header may begin at each byte of ``data`` but the last fifteen."""
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(raw) - RECORD + 1
    word = lambda k: sum(raw[k + i : k + i + n] << (8 * i if kind.order == "<" else 24 - 8 * i) for i in range(4))
    sec, part, kept, full = (word(k) for k in (0, 4, 8, 12))
    near = abs(sec - kind.first_sec) < 10 * 366 * 86400
    return near & (part < kind.ticks) & (kept > 0) & (kept <= kind.limit) & (full >= kept)


def resynchronise(pages: _Pages, kind: Kind, low: int, high: int, run: int = 8) -> int | None:
    """The first place in ``[low, high)`` from which ``run`` plausible headers follow each other, or fewer up to the very end of the file."""
    at = low
    while at < high:
        page = bytes(pages.get(at, min(1 << 20, pages.size - at)))
        if len(page) < RECORD:
            return None
        for guess in np.flatnonzero(plausible(page, kind)):
            here, seen = at + int(guess), 0
            if here >= high:
                return None
            first = here
            while seen < run and here + RECORD <= pages.size:
                head = bytes(pages.get(here, RECORD))
                if not plausible(head, kind)[0]:
                    break
                here += RECORD + struct.unpack_from(kind.order + "I", head, 8)[0]
                seen += 1
            if seen == run or (seen and here == pages.size):
                return first
        at += len(page) - RECORD + 1
    return None


def _scanned(ranges: DataFrame) -> DataFrame:
    """``path, k, low, high, start, stop, n`` from ``path, k, low, high, entry``: the chain of each range, from ``entry`` where one is given."""
    schema = pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in ("k", "low", "high", "start", "stop", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with opened(row["path"]) as file:
                    kind, pages = Kind.of(file), _Pages(file)
                    start = row["entry"]
                    if start is None:
                        start = HEAD if row["k"] == 0 else resynchronise(pages, kind, row["low"], row["high"])
                    n, stop = 0, start
                    for at, kept in _follow(pages, kind, start, row["high"]) if start is not None else ():
                        n, stop = n + 1, at + RECORD + kept
                    out.append({c: row[c] for c in ("path", "k", "low", "high")} | {"start": start, "stop": stop, "n": n})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ranges.select("path", "k", "low", "high", "entry").mapInArrow(run, "path string, k long, low long, high long, start long, stop long, n long")


def capture_ranges(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """``path, k, low, high, start, stop, n`` of the captures at ``path``: where the records of each range begin and end, and how many there are."""
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") >= HEAD).select("path", "length")
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / split_bytes)), F.lit(0))).first()[0]
    cut = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / split_bytes))).alias("k"))
    low = F.col("k") * split_bytes
    ranges = cut.select("path", "k", low.alias("low"), F.least(low + split_bytes, F.col("length")).alias("high"), F.lit(None).cast("long").alias("entry"))
    found, _ = staged(_scanned(ranges.repartition(max(1, int(total)))), "capture-ranges")
    before = F.lag("stop").over(Window.partitionBy("path").orderBy("k"))
    while True:
        checked = found.withColumn("entry", F.when(F.col("k") > 0, before))
        wrong = checked.filter((F.col("k") > 0) & ~F.col("start").eqNullSafe(F.col("entry")))
        n = wrong.count()
        if not n:
            return found
        right = checked.filter((F.col("k") == 0) | F.col("start").eqNullSafe(F.col("entry"))).drop("entry")
        found, _ = staged(right.unionByName(_scanned(wrong.repartition(n))), "capture-ranges")


def decode(data: np.ndarray, at: np.ndarray, kept: np.ndarray, kind: Kind) -> pa.RecordBatch:
    """Packet rows of the records at ``at`` in ``data``; what is not IPv4, over Ethernet (with or without a VLAN tag) or bare, is left out."""
    byte = np.concatenate([data, np.zeros(64, np.uint8)])
    frame = at + RECORD
    kept = np.minimum(kept, len(data) - frame)
    skip = np.zeros(len(at), np.int64)
    fine = np.ones(len(at), bool)
    pair = lambda place: byte[place].astype(np.int64) << 8 | byte[place + 1]
    if kind.link == ETHERNET:
        inside = kept >= 18
        tagged = inside & (pair(np.where(inside, frame + 12, 0)) == 0x8100)
        skip = np.where(tagged, 18, 14)
        fine = inside & (pair(np.where(inside, frame + skip - 2, 0)) == 0x0800)
    fine &= kept - skip >= 20
    at, frame, kept, skip = at[fine], frame[fine], kept[fine], skip[fine]
    ip = frame + skip
    fine = byte[ip] >> 4 == 4
    at, ip, kept, skip = at[fine], ip[fine], kept[fine], skip[fine]
    times = byte[at[:, None] + np.arange(8)].view(f"{kind.order}u4").astype(float)
    body = ip + (byte[ip] & 15).astype(np.int64) * 4
    left = ip + kept - skip - body
    proto = byte[ip + 9]
    ports = np.isin(proto, (6, 17)) & (left >= 4)
    tcp = (proto == 6) & (left >= 14)
    body = np.where(ports, body, 0)
    flags = np.where(tcp, byte[np.minimum(body + 13, len(byte) - 1)], 0)

    def dotted(place: np.ndarray) -> pa.Array:
        codes, back = np.unique(byte[place[:, None] + np.arange(4)].view(">u4").ravel(), return_inverse=True)
        names = pa.array([".".join(map(str, int(c).to_bytes(4, "big"))) for c in codes], pa.string())
        return names.take(pa.array(back))

    columns = [
        pa.array(times[:, 0] + times[:, 1] / kind.ticks), dotted(ip + 12), dotted(ip + 16), pa.array(proto.astype(np.int32)), pa.array(kept.astype(np.int32)),
        pa.array(pair(body).astype(np.int32), mask=~ports), pa.array(pair(body + 2).astype(np.int32), mask=~ports), _FLAG_NAMES.take(pa.array(flags.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKET.split(", ")])


def read_ranges(ranges: DataFrame, batch_rows: int = 20_000) -> DataFrame:
    """Packets of a table of ranges, each range in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop"))):
                with opened(path) as file:
                    kind, pages, held = Kind.of(file), _Pages(file), []

                    def made(held=held, kind=kind, pages=pages, file=file) -> pa.RecordBatch:
                        low = held[0][0]
                        data = file.read_at(min(held[-1][0] + RECORD + held[-1][1], pages.size) - low, low)
                        at, kept = np.array(held, np.int64).T
                        return decode(np.frombuffer(data, np.uint8), at - low, kept, kind)

                    for place in _follow(pages, kind, start, stop):
                        held.append(place)
                        if len(held) == batch_rows or place[0] - held[0][0] >= _READ:
                            yield made()
                            held.clear()
                    if held:
                        yield made()

    full = ranges.filter("n > 0")
    return full.select("path", "start", "stop").repartition(max(1, full.count())).mapInArrow(run, PACKET)


def read_pcap(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """Packets of the captures at ``path``, ranges of ``split_bytes`` read side by side; ``length`` is that of the captured frame.

    Ends that a table beside the captures names have their names.
    """
    packets = read_ranges(capture_ranges(spark, path, split_bytes))
    store, place = fs.FileSystem.from_uri(_names_path(path).replace("file:///", "/").replace("file:/", "/"))
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return packets
    names = spark.read.schema("address string, name string, high int").parquet(_names_path(path))
    return under_names(packets, names, names.count() <= FEW_NAMES)


def encode(rows: list[tuple]) -> bytes:
    """Records of Ethernet frames from ``ts, src, dst, proto, length, sport, dport, flags``; frames are filled up to ``length`` bytes."""
    bits = {name: bit for bit, name in _FLAGS}
    out = []
    for ts, src, dst, proto, length, sport, dport, flags in rows:
        body = struct.pack(">HH", sport or 0, dport or 0) if proto in (6, 17) else b""
        if proto == 6:
            body += struct.pack(">IIBBHHH", 0, 0, 0x50, sum(bits[c] for c in flags or ""), 0, 0, 0)
        size = max(34 + len(body), min(int(length or 0), 65_535))
        address = lambda a: bytes(map(int, a.split(".")))
        ip = struct.pack(">BBHHHBBH", 0x45, 0, size - 14, 0, 0, 64, proto, 0) + address(src) + address(dst)
        micros = round(ts * 1e6)
        frame = (b"\0" * 12 + b"\x08\x00" + ip + body).ljust(size, b"\0")
        out.append(struct.pack("<IIII", micros // 10**6, micros % 10**6, size, size) + frame)
    return b"".join(out)


def _unfit(address: Column, port: Column) -> Column:
    """The port's bits above the low sixteen where a capture cannot hold an end as it is, else null; addresses of the reserved block are names too."""
    fits = F.coalesce(address.rlike(_PLAIN), F.lit(False)) & F.coalesce(port.between(0, 65_535), F.lit(True))
    return F.when(~fits, F.floor(F.coalesce(port, F.lit(0)) / 65_536).cast("int"))


def _names_path(path: str) -> str:
    return path.rstrip("/") + ".names"


def end_names(packets: DataFrame) -> DataFrame:
    """``address, name, high``: an address of the reserved block for each name and high part of a port that do not fit."""
    ends = [packets.select(F.col(a).alias("name"), _unfit(F.col(a), F.col(p)).alias("high")).filter("high is not null") for a, p in _ENDS]
    placed = numbered(ends[0].union(ends[1]).distinct(), ["name", "high"], "place")
    number = F.lit(_RESERVED).cast("long") + F.col("place")
    return placed.select(F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(255) for s in (24, 16, 8, 0)]).alias("address"), "name", "high")


def _at_ends(packets: DataFrame, names: DataFrame, few: bool, on, made) -> DataFrame:
    """``packets`` with either end joined to its name and replaced by ``made``; few names are broadcast."""
    known = names.select(F.col("address").alias("_address"), F.col("name").alias("_name"), F.col("high").alias("_high"))
    for a, p in _ENDS:
        met = packets.join(F.broadcast(known) if few else known.hint("merge"), on(F.col(a), F.col(p)), "left")
        found = F.col("_address").isNotNull()
        packets = met.withColumns({c: F.when(found, v).otherwise(F.col(c)) for c, v in zip((a, p), made(F.col(p)))}).drop("_address", "_name", "_high")
    return packets


def under_addresses(packets: DataFrame, names: DataFrame, few: bool) -> DataFrame:
    """``packets`` with ends as a capture holds them."""
    same = lambda a, p: a.eqNullSafe(F.col("_name")) & (_unfit(a, p) == F.col("_high"))
    return _at_ends(packets, names, few, same, lambda p: (F.col("_address"), F.pmod(p, F.lit(65_536)).cast("int")))


def under_names(packets: DataFrame, names: DataFrame, few: bool) -> DataFrame:
    """Packets of captures with the names of their ends put back."""
    return _at_ends(packets, names, few, lambda a, p: a == F.col("_address"), lambda p: (F.col("_name"), (p + F.col("_high") * 65_536).cast("int")))


def write_pcap(packets: DataFrame, path: str) -> DataFrame:
    """Write packets as captures, one per partition, in the order of time within it; returns ``path, n`` of the files.

    A file is written under another name and moved, so a repeated task leaves one file. Names of ends that do not fit a
    capture are a table beside it, ``path`` and ``.names``.
    """
    odd = end_names(packets)
    if n_odd := odd.count():
        if n_odd > 1 << 28:
            raise ValueError("more names than the reserved block has addresses")
        odd.write.mode("overwrite").parquet(_names_path(path))
        odd = packets.sparkSession.read.schema(odd.schema).parquet(_names_path(path))
        few = n_odd <= FEW_NAMES
        parts = packets if few else packets.withColumn("_part", F.spark_partition_id())
        packets = under_addresses(parts, odd, few)
        if not few:
            packets = packets.repartitionById(parts.rdd.getNumPartitions(), "_part")
    names = [c.split()[0] for c in PACKET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(path.replace("file:///", "/").replace("file:/", "/"))
        store.create_dir(place, recursive=True)
        final, n = f"{place}/part-{TaskContext.get().partitionId():06d}.pcap", 0
        draft = f"{final}.{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65_535, ETHERNET))
            for batch in batches:
                out.write(encode(list(zip(*(batch.column(c).to_pylist() for c in names)))))
                n += batch.num_rows
        store.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([n], pa.int64())], names=["path", "n"])

    made, _ = staged(packets.select(*names).sortWithinPartitions("ts").mapInArrow(run, "path string, n long"), "captures")
    return made

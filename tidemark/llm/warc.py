"""WARC archives in zstandard form: one dictionary up front, one frame per record.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every
record follows as a frame of its own, so a record is reached without unpacking those before it.
Spark writes the files with its text sink, whose line separator is an empty skippable frame: any
store that Spark can write to holds them, and any reader of the format skips the separators.

Edge cases: a null payload counts as empty; a null URL is written as ``urn:unknown``; line breaks in
URLs are percent-encoded; null ids sort before all others, so they are responses only where no copy
has an id; rows with the largest id of their copies are all responses; an empty table gives no
archive and reads back as an empty result; too few samples to train on give an empty dictionary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import hash_share, hot

DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame (magic 0x184D2A50, length 0), plain ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 1 << 16


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def skippable_frame(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url) if url else "urn:unknown"


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str):
    inner = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def page_record(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to, date: str) -> bytes:
    """A response record with the payload, or a revisit that keeps its HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _urn(refers_to))]
    return record_bytes(headers, http if revisit else http + payload)


def parse_record(data: bytes) -> Record:
    """Exactly one record, its headers and its lengths checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not mark or not first.startswith(b"WARC/1."):
        raise WarcError(f"no record starts with {data[:20]!r}")
    headers: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip() or name.strip().lower() in headers:
            raise WarcError(f"bad or repeated header {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise WarcError(f"header {need} is missing")
    length = headers["content-length"]
    if not length.isascii() or not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"content length {length} where the frame holds {len(rest) - 4}")
    return Record(headers, rest[:-4])


def read_frames(data: bytes) -> Iterator[bytes]:
    """Contents of an archive's zstandard frames, unpacked with the dictionary of its first frame."""
    view = memoryview(data)
    if not len(view):
        return
    if len(view) < 8 or int.from_bytes(view[:4], "little") != DICTIONARY_MAGIC:
        raise WarcError("the archive does not start with a dictionary frame")
    at = 8 + int.from_bytes(view[4:8], "little")
    dictionary = bytes(view[8:at])
    if len(dictionary) != at - 8:
        raise WarcError("the dictionary frame is cut off")
    if int.from_bytes(dictionary[:4], "little") == FRAME_MAGIC:
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE and at + 8 <= len(view):
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            if at > len(view):
                raise WarcError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"no frame starts at byte {at}")
        one, parts = unpack.decompressobj(), []
        try:
            while not one.eof:
                if at >= len(view):
                    raise WarcError("a frame is cut off")
                fed = view[at : at + _STEP]
                parts.append(one.decompress(fed))
                at += len(fed) - len(one.unused_data)
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be unpacked: {e}") from e
        yield b"".join(parts)


def page_row(record: Record) -> dict:
    """The page that a record stands for; digests and lengths of responses are checked."""
    head, mark, payload = record.block.partition(b"\r\n\r\n")
    http = dict(line.lower().split(b": ", 1) for line in head.split(b"\r\n")[1:])
    digest = record.headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = int(http.get(b"content-length", b"-1"))
    if not mark or len(digest) != 40 or size < 0:
        raise WarcError(f"{record.headers['warc-record-id']}: no HTTP headers, digest or length")
    if record.kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise WarcError(f"{record.headers['warc-record-id']}: the payload does not match its length or digest")
    elif record.kind != "revisit" or payload or "warc-refers-to" not in record.headers:
        raise WarcError(f"{record.headers['warc-record-id']}: not a response and no valid revisit")
    return {
        "page_id": _page(record.headers["warc-record-id"]), "url": record.headers.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest, "record_type": record.kind,
        "refers_to": _page(record.headers["warc-refers-to"]) if record.kind == "revisit" else None, "payload": payload,
    }


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, payload_digest, revisit, refers_to`` per row of pages (page_id, url, html).

    Copies are counted with map-side aggregation on digests and sizes alone. Digests of more than a
    ``HOT``-th of all pages meet their rows by a broadcast; rows that can't be copies get keys of their
    own in the shuffled join of the others, so that no key of it is large.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"),
        F.octet_length(payload).alias("_size"),
    )
    copies = (
        rows.filter(F.col("_size") >= min_bytes).groupBy("payload_digest", "_size")
        .agg(F.count("*").alias("_n"), F.max("page_id").alias("_first")).filter("_n > 1")
    )
    total = pages.count()
    many = copies.filter(hot(copies, "_n", total)).select(F.col("payload_digest").alias("_hot"), F.col("_size").alias("_hot_size"), F.col("_first").alias("_hot_first"))
    few = copies.filter(~hot(copies, "_n", total)).select(F.concat_ws("/", "payload_digest", "_size").alias("_key"), F.col("_first").alias("_cold_first"), F.lit(True).alias("_cold"))
    told = rows.join(F.broadcast(many), (F.col("payload_digest") == F.col("_hot")) & (F.col("_size") == F.col("_hot_size")), "left")
    key = F.when((F.col("_size") >= min_bytes) & F.col("_hot").isNull(), F.concat_ws("/", "payload_digest", "_size")).otherwise(
        F.concat_ws("-", F.lit("alone"), "page_id", F.xxhash64("url", "page_id"))
    )
    joined = told.withColumn("_key", key).join(few, "_key", "left").withColumn("_first", F.coalesce("_hot_first", "_cold_first"))
    revisit = (F.col("_hot").isNotNull() | F.col("_cold").isNotNull()) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_digest", revisit.alias("revisit"), F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z", dict_pages: int = 200,
    dict_bytes: int = 65_536, level: int = 3, file_records: int = 4096,
) -> None:
    """Write archive files of at most ``file_records`` records below ``path``.

    The dictionary is trained on at most ``dict_pages`` pages, those with the smallest hashes.
    """
    order = F.xxhash64("page_id", "html")
    # About four times what is wanted passes the bound on the hash, however many partitions there are.
    near = hash_share(order) * max(1, pages.count()) <= 4 * dict_pages + 64
    few = (
        pages.filter(near).select(F.coalesce("html", F.lit("")).alias("html"), order.alias("_o")).orderBy("_o").limit(dict_pages).agg(F.collect_list("html")).first()[0]
    )
    # Aggregated by a task: a bare ordered limit sends the candidates of every partition to the driver.
    samples = sorted(h.encode() for h in few)
    try:
        dictionary = zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        dictionary = b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, **used)
        done = 0
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                frames = []
                for r in whole.slice(at, 256).to_pylist():
                    if done % file_records == 0:  # the writer starts a file here
                        frames.append(skippable_frame(DICTIONARY_MAGIC, dictionary))
                    record = page_record(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["revisit"], r["refers_to"], date)
                    frames.append(packer.compress(record))
                    done += 1
                yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = mark_revisits(pages, min_bytes).mapInArrow(run, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", file_records + 1).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Pages of every archive below ``path``, each record validated; a broken one raises ``WarcError``."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held: list[dict] = []
                for i, frame in enumerate(read_frames(content.as_buffer())):
                    try:
                        held.append(page_row(parse_record(frame)))
                    except WarcError as e:
                        raise WarcError(f"{name}, record {i}: {e}") from e
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()),
    ] + [("payload", pa.binary())] * with_payload
    schema = pa.schema(kinds)
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.mapInArrow(run, ddl + ", payload binary" * with_payload)

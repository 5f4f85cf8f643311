"""Token-id files: documents as id arrays, each compressed with one shared zstandard dictionary.

A file set has two tables below one path:

* ``dictionary``: one row, ``dict_sha256`` and ``dictionary`` (the trained bytes);
* ``blocks``: up to ``block_docs`` documents a row, in ascending id order over (part, block):
  ``part, block, dict_sha256, first_token`` (ids before it in its part), ``doc_ids``, ``n_tokens``,
  ``offsets`` (where each document's frame starts in ``frames``) and ``frames`` (one zstandard frame
  per document, ids as little-endian unsigned integers of ``width`` bytes).

A short document is read by the block whose id range holds it, one slice and one small frame. Ids
come from the tokenizers library, which keeps its own treatment of added tokens such as
``<|endoftext|>``; the ids of pieces of text are kept in a bounded cache (see ``ByteEncoder``). Every
``verify_every``-th text is checked whole.

Edge cases: a null text counts as empty and holds the end id only; ids are whole numbers (a column of
another type raises ``TypeError``); null ids come first; equal ids are ordered by the hash of their
text; repeated rows are stored again; an empty table gives an empty set with an empty dictionary;
other columns are ignored. A hot id is split over partitions by its texts.
"""

from __future__ import annotations

import gc
import hashlib
import re
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from tokenizers import Tokenizer

from tidemark.llm.workspace import hash_share, partitions

#: Fixed value: the published pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte-level vocabularies spell each byte as a visible character: printable Latin-1 bytes stay, the
#: others follow in order from U+0100.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
VISIBLE = "".join(chr(b if b in _PRINTABLE else next(_OTHERS)) for b in range(256))
SPACE = VISIBLE[32]
RUN_WORDS = 64
#: Characters of text whose new words are merged together.
SLICE_CHARS = 2 << 20
CACHE_PIECES, CACHE_MARKS = 900_000, 65_536
MARKS = frozenset(".,;:!?")
_UNSAFE = re.compile(r"\s\s")
_CROSSES = re.compile("[^\\W\\d_] |\ufffd ")


class ByteEncoder:
    """Ids of texts by the tokenizers library, with a bounded cache of pieces of text.

    The pre-tokenizer never reaches over a white space character that stands between two others, but
    for a space, which it takes along with what follows. So a text without two of them in a row is cut
    before each space and each line feed: a piece is what follows a space, or a line feed and what
    follows it. A line feed is put before each text for its first piece and its id taken off again.
    Other texts, and those that hold an added token, go through the library whole.
    """

    def __init__(self, tokenizer_json: str, verify_every: int = 200):
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = regex.compile(PATTERN).findall
        # A copy, whose own cache of ten thousand words costs more here than it saves.
        self.model = Tokenizer.from_str(tokenizer_json).model
        self.model._resize_cache(0)
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids start with a space.
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[:1] == SPACE]] = True
        # No token reaches from a letter over a space, so words of letters may be merged in one run.
        inner = (bytes(map(VISIBLE.find, t)).decode(errors="replace") for t in vocabulary if SPACE in t[1:] and set(t) <= set(VISIBLE))
        self.run = 1 if any(_CROSSES.search(t) for t in inner) else RUN_WORDS
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.dtype = np.dtype(f"<u{self.width}")
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.verify_every = verify_every
        self.seen = 0

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _merged(self, text: str) -> list[int]:
        """Ids of one pre-token, or of words in a row, by the library's merge model over its visible byte alphabet."""
        return [t.id for t in self.model.tokenize(charmap_decode(text.encode(), "strict", VISIBLE)[0])]

    def _part(self, part: str) -> bytes:
        return array(self.code, self._merged(part)).tobytes()

    def _mark(self, part: str) -> bytes:
        """Ids of a pre-token that holds no letter."""
        ids = self.marks.get(part)
        if ids is None:
            if len(self.marks) >= CACHE_MARKS:
                self.marks.clear()
            ids = self.marks[part] = self._part(part)
        return ids

    def _piece(self, piece: str) -> bytes:
        before, word = ("", piece[1:]) if piece[:1] == "\n" else (" ", piece)
        lead = b"" if before else self._mark("\n")
        return lead + b"".join([self._part(p) if p[-1].isalpha() else self._mark(p) for p in self.split(before + word)])

    def _learn(self, words: list[str]) -> None:
        """Keep the ids of words of letters with a space before them, merged in runs."""
        for at in range(0, len(words), self.run):
            run = words[at : at + self.run]
            ids = np.array(self._merged(" " + " ".join(run)), dtype=self.dtype)
            edges = [*(np.flatnonzero(self.spaced[ids]) * self.width).tolist(), len(ids) * self.width]
            packed = ids.tobytes()
            self.known.update(zip(run, [packed[a:b] for a, b in zip(edges, edges[1:])]))

    def _add(self, fresh: set[str]) -> None:
        """Keep the ids of pieces; a word with a mark after it is put together from both."""
        words: dict[str, None] = {}
        marked = []
        for piece in fresh:
            if piece.isalpha():
                words[piece] = None
            elif piece[-1:] in MARKS and piece[:-1].isalpha():
                marked.append(piece)
                if piece[:-1] not in self.known:
                    words[piece[:-1]] = None
            else:
                self.known[piece] = self._piece(piece)
        self._learn(list(words))
        for piece in marked:
            self.known[piece] = self.known[piece[:-1]] + self._mark(piece[-1])

    def _slice(self, texts: list[str]) -> list[bytes]:
        # Lists of words hold no cycles; looking for some takes a tenth of the time.
        gc.disable()
        try:
            return self._encoded(texts)
        finally:
            gc.enable()

    def _encoded(self, texts: list[str]) -> list[bytes]:
        known, size = self.known.get, self.width
        cut: list[tuple[list, list] | None] = []
        fresh: set[str] = set()
        for text in texts:
            if _UNSAFE.search(text) or any(t in text for t in self.added):
                cut.append(None)
                continue
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = "\n" + pieces[0]
            found = list(map(known, pieces))
            if None in found:
                fresh.update([p for p, ids in zip(pieces, found) if ids is None])
            cut.append((pieces, found))
        self._add(fresh)
        out = []
        for text, own in zip(texts, cut):
            if own is None:
                ids = self._library(text)
            else:
                ids = b"".join([known(p) if ids is None else ids for p, ids in zip(*own)] if None in own[1] else own[1])[size:]
            self.seen += 1
            if self.verify_every and self.seen % self.verify_every == 0 and self._library(text) != ids:
                raise RuntimeError(f"the tokenizers library gives other ids for a text of {len(text)} characters")
            out.append(ids)
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Number and ids in file form, without an end id, of each text of ``column``."""
        start, held, texts = 0, 0, []
        for i in range(len(column)):
            texts.append(column[i].as_py())
            held += len(texts[-1])
            if held >= SLICE_CHARS or i == len(column) - 1:
                yield from enumerate(self._slice(texts), start)
                start, held, texts = i + 1, 0, []


#: One encoder a worker process, whatever the number of tasks it runs.
_ENCODERS: dict[str, ByteEncoder] = {}


def _encoder(tokenizer_json: str) -> ByteEncoder:
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteEncoder(tokenizer_json)
    return _ENCODERS[key]


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of ``size`` bytes at most; empty where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _loaded(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write_token_files(
    docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    dict_docs: int = 400, dict_bytes: int = 65_536, block_docs: int = 512, block_bytes: int = 1 << 20, level: int = 3,
) -> None:
    """Write the token files of ``docs`` below ``path``.

    The dictionary is trained on at most ``dict_docs`` documents, those with the smallest hashes; it
    changes sizes only. Documents are range-partitioned and sorted by id, so a part holds ids below
    those of the next.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} holds {docs.schema[id_col].dataType.simpleString()}, not whole numbers")
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tail = rows.withColumn("th", F.xxhash64("text"))
    share = spark.sparkContext.broadcast(tokenizer_json)

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(share.value)
        for batch in batches:
            found = [ids for _, ids in encoder.encode(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    # About four times what is wanted passes the bound on the hash, however many partitions there are.
    near = hash_share(F.xxhash64("doc_id", "th")) * max(1, rows.count()) <= 4 * dict_docs + 64
    picked = tail.filter(near).select("text", F.xxhash64("doc_id", "th").alias("_o")).orderBy("_o").limit(dict_docs).select("text")
    samples = sorted(bytes(r[0]) for r in picked.mapInArrow(serialized, "ids binary").collect())
    dictionary = train_dictionary(samples, dict_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(share.value)
        end = np.array([end_id], dtype=encoder.dtype).tobytes()
        packer = zstandard.ZstdCompressor(level=level, **_loaded(dictionary))
        part, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sizes: list[int] = []
        frames: list[bytes] = []

        def full() -> pa.RecordBatch:
            nonlocal block, first
            lengths = [len(f) for f in frames]
            row = {
                "part": [part], "block": [block], "dict_sha256": [digest], "width": [encoder.width], "first_token": [first],
                "doc_ids": [list(ids)], "n_tokens": [list(sizes)],
                "offsets": [np.cumsum([0, *lengths[:-1]]).tolist()], "frames": [b"".join(frames)],
            }
            block, first = block + 1, first + sum(sizes)
            ids.clear(), sizes.clear(), frames.clear()
            return pa.RecordBatch.from_pydict(row, schema=_BLOCK_ARROW)

        held = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, found in encoder.encode(batch.column(1)):
                frame = packer.compress(found + end)
                ids.append(doc_ids[i])
                sizes.append(len(found) // encoder.width + 1)
                frames.append(frame)
                held += len(frame)
                if len(ids) >= block_docs or held >= block_bytes:
                    held = 0
                    yield full()
        if ids:
            yield full()

    ordered = (
        tail.repartitionByRange(partitions(spark), "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    )
    ordered.mapInArrow(blocks, _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


_BLOCK_SCHEMA = (
    "part int, block int, dict_sha256 string, width int, first_token long, doc_ids array<long>, n_tokens array<int>, "
    "offsets array<int>, frames binary"
)
_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("width", pa.int32()), ("first_token", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("frames", pa.binary()),
])


def _opened(spark: SparkSession, path: str) -> tuple[str, bytes]:
    digest, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(dictionary).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} does not match its hash")
    return digest, bytes(dictionary)


def _documents(blocks: DataFrame, digest: str, dictionary: bytes, wanted: set[int] | None, with_ids: bool) -> DataFrame:
    """Documents of block rows that have a ``before`` column: ids before their part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_loaded(dictionary))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError(f"part {row['part']}, block {row['block']}: compressed with another dictionary")
                start, frames = row["before"] + row["first_token"], memoryview(row["frames"])
                ends = [*row["offsets"][1:], len(frames)]
                out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for doc_id, n, a, b in zip(row["doc_ids"], row["n_tokens"], row["offsets"], ends):
                    if wanted is None or doc_id in wanted:
                        ids = np.frombuffer(unpack.decompress(frames[a:b]), f"<u{row['width']}").astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"document {doc_id}: {len(ids)} ids where the index has {n}")
                        for k, v in (("doc_id", doc_id), ("start", start), ("n_tokens", n), ("ids_crc32", zlib.crc32(ids.tobytes()))):
                            out[k].append(v)
                        out["ids"].append(ids.astype(np.int32) if with_ids else None)
                    start += n
                names = list(out) if with_ids else list(out)[:-1]
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds)], names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return blocks.mapInArrow(read, schema)


def read_token_files(spark: SparkSession, path: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """Documents of a file set: ``doc_id, start, n_tokens, ids_crc32`` and ``ids`` if asked for.

    ``wanted`` (a short list of ids) reads only blocks whose id range holds one of them, and only
    their frames.
    """
    digest, dictionary = _opened(spark, path)
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # One row a part, as many as the writer had partitions.
    before = totals.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = blocks.join(before, F.col("part") == F.col("_part"))
    if wanted is not None:
        held = [F.exists("doc_ids", lambda x: x.isin(wanted))]
        placed = placed.filter(held[0])
    return _documents(placed, digest, dictionary, None if wanted is None else set(wanted), with_ids)

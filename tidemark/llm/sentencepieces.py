"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: the pair whose merged piece scores
highest (leftmost on ties) is merged, its new neighbours enter the agenda, stale entries are
skipped. A pair of characters that no piece holds side by side can never be merged over, so a text
is cut at such places, and the merges of a cut depend on nothing outside it. In particular no piece
goes on into a further word, so words are encoded once per worker and looked up from a bounded
cache. Every word that enters a cache is checked against the sentencepiece library within its
Arrow batch, and so is every ``verify_every``-th whole text, encoded and decoded; a difference
raises ``MismatchError``.

Edge cases: a null text counts as empty and gives the begin and end ids only; characters outside
the vocabulary become byte pieces; any number of spaces and line ends round-trips; repeated rows
give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Piece types of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: Words held per worker before its cache starts anew.
CACHE_WORDS = 700_000


class MismatchError(RuntimeError):
    """The agenda and the sentencepiece library disagree."""


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one serialized protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class MergeVocabulary:
    """Pieces, scores and settings of a BPE model file, with the agenda and the decoder over them."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: list[float] = []
        normalizer = trainer = b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = value
            elif number == 3:
                normalizer = value
        spec, rules = dict(_fields(trainer)), dict(_fields(normalizer))
        if spec.get(3, 1) != 2 or rules.get(2) or rules.get(4, 1) or not rules.get(3, 1) or not rules.get(5, 1):
            raise ValueError("a BPE model with an identity normalizer, a dummy prefix and kept spaces is needed")
        if {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        #: Pieces of one score share a rank; the leftmost of them goes first.
        order = {score: r for r, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[self.scores[i]] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.joined = {pair for p in self.ids for pair in zip(p, p[1:])}
        if any(a != SPACE and b == SPACE for a, b in self.joined):
            raise ValueError("a piece goes on into a further word")
        self.raw = [self._raw(i) for i in range(len(self.pieces))]

    def _raw(self, i: int) -> bytes:
        if self.kinds[i] == CONTROL:
            return b""
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][3:5], 16)])
        return " ⁇ ".encode() if self.kinds[i] == UNKNOWN else self.pieces[i].replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """Symbols left when no adjacent pair forms a piece any more, best score first."""
        symbols = list(text)
        n = len(symbols)
        following, preceding = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        # One integer an entry, rank of the merged piece and left position, so that the agenda orders itself.
        agenda = [rank[pair] << 32 | i for i in range(n - 1) if (pair := text[i : i + 2]) in rank]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            left = entry & 0xFFFFFFFF
            right = following[left]
            if right >= n or not symbols[left] or rank.get(piece := symbols[left] + symbols[right]) != entry >> 32:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = piece, ""
            after = following[left] = following[right]
            if after < n:
                preceding[after] = left
                if (r := rank.get(piece + symbols[after])) is not None:
                    heapq.heappush(agenda, r << 32 | left)
            if (before := preceding[left]) >= 0 and (r := rank.get(symbols[before] + piece)) is not None:
                heapq.heappush(agenda, r << 32 | before)
        return [s for s in symbols if s]

    def piece_ids(self, symbols: list[str]) -> list[int]:
        """Ids of symbols; one outside the vocabulary becomes its bytes (or unknown without byte pieces)."""
        out: list[int] = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def cuts(self, text: str) -> list[str]:
        """``text`` cut wherever no piece holds the two characters side by side."""
        if len(text) > 2 and text[1:-1].isalpha() and (text[-2], text[-1]) not in self.joined:
            return [text[:-1], text[-1]]
        marks = [i + 1 for i, pair in enumerate(zip(text, text[1:])) if pair not in self.joined]
        return [text[a:b] for a, b in zip([0, *marks], [*marks, len(text)])] if text else []

    def decode(self, ids) -> str | None:
        """Text of ids, or None where byte pieces do not form UTF-8 (the library then decides)."""
        raw = self.raw
        data = b"".join([raw[i] for i in ids])
        try:
            return data.removeprefix(b" ").decode()
        except UnicodeDecodeError:
            return None


class _Words(dict):
    """Packed ids by word; a missing word is encoded, kept and noted for the check of its batch."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.new: list[tuple[str, list[int]]] = []

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self.codec.encode_chunk(SPACE + word)
        self.new.append((word, ids))
        packed = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return packed


class Codec:
    """Encoder and decoder of one worker: vocabulary, library and caches."""

    def __init__(self, model: bytes, verify_every: int = 50):
        self.vocabulary = MergeVocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.begin, self.end = (struct.pack("<I", i) for i in (self.library.bos_id(), self.library.eos_id()))
        self.verify_every = verify_every
        self.seen = 0
        self.words = _Words(self)
        self.parts: dict[str, tuple[int, ...]] = {}

    def _part(self, part: str) -> tuple[int, ...]:
        if (ids := self.parts.get(part)) is None:
            if len(self.parts) >= CACHE_WORDS:
                self.parts.clear()
            ids = self.parts[part] = tuple(self.vocabulary.piece_ids(self.vocabulary.merge(part)))
        return ids

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a chunk that starts with the escaped space."""
        if chunk[-2:].isalpha():  # mostly a plain word, merged as one
            return self.vocabulary.piece_ids(self.vocabulary.merge(chunk))
        return [i for part in self.vocabulary.cuts(chunk) for i in self._part(part)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, begin and end included."""
        out = [self.begin + self._body(t) + self.end for t in texts]
        words = [w for w, _ in self.words.new]
        for (word, ours), theirs in zip(self.words.new, self.library.encode(words, num_threads=1)):
            if ours != theirs:
                raise MismatchError(f"{word!r}: {ours} and {theirs}")
        self.words.new.clear()
        return out

    def _body(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            chunks = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
            ids = [i for c in chunks for i in self.encode_chunk(c)]
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def decode(self, ids: list[int]) -> str:
        found = self.vocabulary.decode(ids)
        return self.library.decode(ids) if found is None else found

    def verify(self, text: str, packed: bytes, decoded: str) -> None:
        """Compare every ``verify_every``-th whole text with the library."""
        self.seen += 1
        if self.verify_every and self.seen % self.verify_every == 0:
            theirs = self.library.encode(text, add_bos=True, add_eos=True)
            if list(memoryview(packed).cast("I")) != theirs or decoded != self.library.decode(theirs):
                raise MismatchError(f"a text of {len(text)} characters, from {text[:60]!r}")


#: One codec a worker process, whatever the number of tasks it runs.
_CODECS: dict[tuple[str, int], Codec] = {}


def _codec(model: bytes, verify_every: int) -> Codec:
    key = (hashlib.sha256(model).hexdigest(), verify_every)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model, verify_every)
    return _CODECS[key]


#: Columns that ``encode_documents`` can return, with their Spark types.
OUTPUTS = {
    "n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string",
}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    outputs: tuple[str, ...] = ("n_tokens", "ids"), verify_every: int = 50, group: int = 200,
) -> DataFrame:
    """Encode every whole text and decode its ids again: ``doc_id`` and the chosen ``outputs``.

    The model file is read once on the driver and travels with the task. ``group`` bounds the texts
    that are encoded at a time within an Arrow batch.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    MergeVocabulary(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model, verify_every)
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                out: dict[str, list] = {k: [] for k in outputs}
                for text, packed in zip(texts, codec.encode(texts)):
                    ids = list(memoryview(packed).cast("I"))
                    decoded = codec.decode(ids)
                    codec.verify(text, packed, decoded)
                    for k in outputs:
                        out[k].append(
                            len(ids) if k == "n_tokens" else ids if k == "ids" else decoded if k == "decoded"
                            else hashlib.sha256(packed if k == "ids_sha256" else decoded.encode()).hexdigest()
                        )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(out[k], _ARROW[k]) for k in outputs)], names=["doc_id", *outputs]
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {OUTPUTS[k]}" for k in outputs))

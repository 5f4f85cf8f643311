"""Secrets in text: three fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as outside (O), begin (B) or inside (I). A token is a run of letters, digits and
bytes beyond ASCII, or one other character that isn't white space; its features are its shape (length,
kinds of characters, changes between letters and digits, hexadecimal digits only), the shapes of its
neighbours, the words around it, and features of the whole text. It is fitted on what the patterns find
in a bounded sample and on copies of it with other values, half of them without the name and sign before
the value, so that shape alone can tell. Long mixed tokens that no pattern holds are neither secret nor not: their windows aren't used.

Decoding is Viterbi's. Where O leads B and I by more than two transitions can make up, every best path
has O, so only the runs of tokens between such ones are searched, all of a batch side by side.

Edge cases: a null or empty text has no spans; a text is tagged in pieces of at most ``PIECE`` bytes that
end in white space where there is some, so texts of any length are read whole; pattern spans are those
of the whole text and always stay, and tagged spans that touch one or are shorter than ``min_bytes``
are left out; repeated rows get equal results; without a pattern span in the sample only patterns count;
other columns are ignored, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import hash_share

KINDS = ("assign", "access", "hex", "tagged")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")

#: Bytes of one chain of tokens, and of the texts that are worked on at a time.
PIECE = 1 << 18
O, B, I = 0, 1, 2
#: Tokens on either side of the one that a training window is about.
REACH = 12

_N = np.arange(256)
_DIGIT, _UPPER, _LOWER = (_N >= 48) & (_N <= 57), (_N >= 65) & (_N <= 90), (_N >= 97) & (_N <= 122)
_HIGH = _N >= 128
_WORD = _DIGIT | _UPPER | _LOWER | _HIGH
_MARK = (_N > 32) & (_N < 127) & ~_WORD
_HEX = _DIGIT | ((_N >= 97) & (_N <= 102))
_FOLD = np.where(_UPPER, _N + 32, _N).astype(np.uint64)

#: Letters of the values that training makes up: hexadecimal, base 32, letters and digits, base 64 of two kinds.
_ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ALPHABETS = [np.frombuffer(a, np.uint8) for a in (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _ALNUM, _ALNUM + b"+/", _ALNUM + b"-_")]

_HASHED = 1 << 12
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 24, 32, 48])
_CHANGES = np.array([1, 2, 3, 5, 8])
#: Size of each block of features, in the order of the columns of ``features``.
_SIZES = np.array([10 + 256, 64, 60, 20, 640, 640, 64, 1, _HASHED, _HASHED, _HASHED, _HASHED])
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
N_FEATURES = int(_FIRST[-1])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def pattern_spans(data: bytes, at: int, end: int) -> list[tuple[int, int, int, int]]:
    """``kind, start, stop, secret`` of the patterns' matches in ``data[at:end]``; ``secret`` is where the value begins."""
    found = []
    if data.find(b":", at, end) >= 0 or data.find(b"=", at, end) >= 0:
        found += [(0, m.start(), m.end(), m.start(1)) for m in _ASSIGN.finditer(data, at, end) if m.end(1) - m.start(1) >= 8]
    if data.find(b"AKIA", at, end) >= 0:
        found += [(1, m.start(), m.end(), m.start()) for m in _ACCESS.finditer(data, at, end) if m.end() - m.start() >= 16]
    return found


def hex_spans(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``start, stop`` of the runs of 32 or more lower-case hexadecimal digits, ended by ``bounds``."""
    held = _HEX[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(held & (cut[:-1] | ~np.concatenate([[False], held[:-1]])))
    stop = np.flatnonzero(held & (cut[1:] | ~np.append(held[1:], False))) + 1
    long = stop - start >= 32
    return np.stack([start[long], stop[long]], axis=1)


@dataclass
class Tokens:
    start: np.ndarray
    stop: np.ndarray
    chain: np.ndarray
    features: np.ndarray
    unknown: np.ndarray


def _running(mask: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])


def file_code(data: np.ndarray, at: int, end: int) -> int:
    """Features of a whole text as one of 64: shares of digits and of marks, and of signs that assign."""
    own = data[at:end]
    size = max(1, len(own))
    share = lambda mask, cuts: int(np.searchsorted(cuts, np.count_nonzero(mask[own]) / size))
    signs = np.count_nonzero((own == 58) | (own == 61)) / size
    return (share(_DIGIT, [0.01, 0.05, 0.2]) * 4 + share(_MARK, [0.02, 0.06, 0.15])) * 4 + int(np.searchsorted([0.0005, 0.005, 0.02], signs))


def tokenize(data: np.ndarray, bounds: np.ndarray, files: np.ndarray) -> Tokens:
    """Tokens of the chains ``data[bounds[i] : bounds[i + 1]]`` with their feature codes; ``files`` are the codes of their texts."""
    word, mark = _WORD[data], _MARK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    start = np.flatnonzero(mark | (word & (cut[:-1] | ~np.concatenate([[False], word[:-1]]))))
    stop = np.flatnonzero(mark | (word & (cut[1:] | ~np.append(word[1:], False)))) + 1
    chain = np.searchsorted(bounds, start, "right") - 1
    size = stop - start
    count = lambda table: np.diff(_running(table[data])[np.stack([start, stop])], axis=0)[0]
    digits, upper, lower, high = count(_DIGIT), count(_UPPER), count(_LOWER), count(_HIGH)
    kind = _DIGIT[data].astype(np.int8)
    change = _running(np.concatenate([[False], kind[1:] != kind[:-1]]))
    changes = change[stop] - change[start + 1]
    is_mark = mark[start]
    length = np.searchsorted(_LENGTHS, size)
    mixed = (upper > 0) * 1 + (lower > 0) * 2 + (digits > 0) * 4 + (high > 0) * 8
    shape = np.where(is_mark, 0, 1 + length) * 16 + mixed
    powers = np.full(len(data) + 1, _BASE)
    powers[0] = 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(powers, dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(powers[:-1] * (_FOLD[data] + np.uint64(1)), dtype=np.uint64)])
        back = np.full(len(data) + 1, _INVERSE)
        back[0] = 1
        back = np.cumprod(back, dtype=np.uint64)
        code = (sums[stop] - sums[start]) * back[start] * np.uint64(0xD6E8FEB86659FD93)
    hashed = (code >> np.uint64(52)).astype(np.int64)

    def beside(values: np.ndarray, step: int, blank: int) -> np.ndarray:
        out = np.full(len(values), blank, np.int64)
        if abs(step) < len(values):
            src, dst = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
            same = chain[src] == chain[dst]
            out[dst] = np.where(same, values[src], blank)
        return out

    # The nearest word before, at most four tokens away: marks stand between a name and its value.
    before = np.zeros(len(start), np.int64)
    for step in (4, 3, 2, 1):
        is_word = beside((~is_mark).astype(np.int64), step, 0) == 1
        before = np.where(is_word, beside(hashed, step, 0), before)
    columns = [
        np.where(is_mark, 10 + data[start], length), mixed * 4 + np.searchsorted([8, 16, 32], size), np.searchsorted(_CHANGES, changes) * 10 + length,
        (_running(_HEX[data])[stop] - _running(_HEX[data])[start] == size) * 10 + length, beside(shape, 1, 639), beside(shape, -1, 639), files[chain],
        np.zeros(len(start), np.int64), beside(hashed, 1, 0), beside(hashed, 2, 0), before, beside(hashed, -1, 0),
    ]
    unknown = (size >= 16) & (digits > 0) & (upper + lower > 0) & (changes >= 3)
    return Tokens(start, stop, chain, np.stack(columns, axis=1) + _FIRST[:-1], unknown)


@dataclass
class Field:
    """Weights of every feature and label, and of every pair of neighbouring labels."""

    weights: np.ndarray
    steps: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for column in features.T:
            out += np.take(self.weights, column, axis=0)
        return out


def viterbi(scores: np.ndarray, steps: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The best labels of all chains; before and after each chain stands O, ties go to the smaller label."""
    label = np.zeros(len(scores), np.int8)
    slack = 2 * (steps.max() - steps.min())
    open_ = np.flatnonzero(scores[:, O] - scores[:, 1:].max(axis=1) <= slack)
    if not len(open_):
        return label
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) > 1) | (chain[open_[1:]] != chain[open_[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(open_)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    best = steps[O] + scores[open_[first]]
    back = np.zeros((len(open_), 3), np.int8)
    for t in range(1, size[0]):
        n = np.searchsorted(-size, -t, "left")
        ways = best[:n, :, None] + steps[None]
        back[first[:n] + t] = ways.argmax(axis=1)
        best[:n] = ways.max(axis=1) + scores[open_[first[:n] + t]]
    last = (best + steps[:, O]).argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        n = np.searchsorted(-size, -t, "left")
        at = first[:n] + t
        label[open_[at]] = last[:n]
        last[:n] = back[at, last[:n]]
    return label


def likelihood(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of padded windows, and its gradient by feature weights and steps.

    ``features`` is (windows, tokens, columns), ``labels`` (windows, tokens); a window begins and ends beside an O.
    """
    n, t, _ = features.shape
    held = np.arange(t) < lengths[:, None]
    scores = field.scores(features.reshape(n * t, -1)).reshape(n, t, 3)
    rows = np.arange(n)
    lse = lambda a, axis: np.logaddexp.reduce(a, axis=axis)
    ahead, behind = np.zeros((n, t, 3)), np.zeros((n, t, 3))
    ahead[:, 0] = field.steps[O] + scores[:, 0]
    for i in range(1, t):
        ahead[:, i] = lse(ahead[:, i - 1, :, None] + field.steps[None], 1) + scores[:, i]
    for i in range(t - 1, -1, -1):
        end = lengths - 1 == i
        if i + 1 < t:
            behind[:, i] = lse(field.steps[None] + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        behind[end, i] = field.steps[:, O]
    total = lse(ahead[rows, lengths - 1] + field.steps[:, O], 1)
    share = np.exp(ahead + behind - total[:, None, None]) * held[:, :, None]
    truth = np.eye(3)[labels] * held[:, :, None]
    pull = (truth - share).reshape(n * t, 3)
    d_weights = np.zeros_like(field.weights)
    for y in range(3):
        for column in features.reshape(n * t, -1).T:
            d_weights[:, y] += np.bincount(column, pull[:, y], N_FEATURES)
    d_steps = np.zeros((3, 3))
    value = (scores * truth).sum() + field.steps[O, labels[:, 0]].sum() + field.steps[labels[rows, lengths - 1], O].sum() - total.sum()
    d_steps[O] += (truth[:, 0] - share[:, 0]).sum(axis=0)
    d_steps[:, O] += (truth[rows, lengths - 1] - share[rows, lengths - 1]).sum(axis=0)
    for i in range(1, t):
        both = ahead[:, i - 1, :, None] + field.steps[None] + (scores[:, i] + behind[:, i])[:, None, :] - total[:, None, None]
        d_steps += ((truth[:, i - 1, :, None] * truth[:, i, None, :]) - np.exp(both) * held[:, i, None, None]).sum(axis=0)
        value += (field.steps[labels[:, i - 1], labels[:, i]] * held[:, i]).sum()
    return float(value), d_weights, d_steps


def train(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.15, l2: float = 0.02) -> Field:
    """Adam on the penalised likelihood; weights and steps start at 0, so the result follows from the windows alone."""
    field = Field(np.zeros((N_FEATURES, 3)), np.zeros((3, 3)))
    parts = [field.weights, field.steps]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for r in range(1, rounds + 1):
        _, *pulls = likelihood(features, labels, lengths, field)
        for p, pull, m, v in zip(parts, pulls, mean, square):
            g = pull - l2 * p
            m[:] = 0.9 * m + 0.1 * g
            v[:] = 0.99 * v + 0.01 * g * g
            p += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return field


def _pieces(data: np.ndarray, at: int, end: int) -> list[int]:
    """Ends of the pieces of a text: in white space where the last ``PIECE`` bytes have some."""
    out = []
    while end - at > PIECE:
        white = np.flatnonzero(data[at : at + PIECE] <= 32)
        at += int(white[-1]) + 1 if len(white) else PIECE
        out.append(at)
    return [*out, end]


@dataclass
class Group:
    """Some texts of a batch: their bytes, where each begins, and the pattern spans of each in order."""

    data: np.ndarray
    bounds: np.ndarray
    spans: list[list[tuple[int, int, int, int]]]

    def parts(self) -> Iterator[tuple[Tokens, np.ndarray]]:
        """Tokens of about ``PIECE`` bytes at a time, and the text that each is of."""
        chains, texts, files = [0], [], []
        for i, (at, end) in enumerate(zip(self.bounds.tolist(), self.bounds[1:].tolist())):
            ends = _pieces(self.data, at, end) if end > at else []
            code = file_code(self.data, at, end) if ends else 0
            chains, texts, files = chains + ends, texts + [i] * len(ends), files + [code] * len(ends)
        a = 0
        while a < len(texts):
            b = a + 1
            while b < len(texts) and chains[b + 1] - chains[a] <= PIECE:
                b += 1
            at = chains[a]
            t = tokenize(self.data[at : chains[b]], np.array(chains[a : b + 1]) - at, np.array(files[a:b]))
            yield Tokens(t.start + at, t.stop + at, t.chain, t.features, t.unknown), np.array(texts[a:b])[t.chain]
            a = b


def groups(texts: pa.Array) -> Iterator[Group]:
    """The texts of a batch in groups of about ``PIECE`` bytes, a longer text by itself; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        raw = buffer[offsets[at] : offsets[to]].to_pybytes()
        data, own = np.frombuffer(raw, np.uint8), offsets[at : to + 1] - offsets[at]
        spans = [pattern_spans(raw, a, b) for a, b in zip(own.tolist(), own[1:].tolist())]
        for a, b in hex_spans(data, own).tolist():
            spans[int(np.searchsorted(own, a, "right")) - 1].append((2, a, b, a))
        yield Group(data, own, [sorted(s, key=lambda x: (x[1], x[0])) for s in spans])
        at = to


def _labels(t: Tokens, spans: list[tuple[int, int, int, int]]) -> np.ndarray:
    """B and I where a token lies in the value of a pattern span."""
    label = np.zeros(len(t.start), np.int8)
    for _, _, stop, secret in spans:
        a, b = np.searchsorted(t.start, [secret, stop])
        if b > a:
            label[a:b] = I
            label[a] = B
    return label


def respelled(data: np.ndarray, at: int, end: int, span: tuple[int, int, int, int]) -> Iterator[tuple[np.ndarray, tuple[int, int, int, int]]]:
    """Two copies of a span's surroundings with another value of random letters: after its name and sign, and without them."""
    _, start, stop, secret = span
    old = data[secret:stop].tobytes()
    before, name = data[max(at, start - 200) : start].tobytes(), data[start:secret].tobytes()
    after = data[stop : min(end, stop + 200)].tobytes().lstrip(b"\"'")
    for copy, head in enumerate((before + name, before + b" ")):
        rng = np.random.default_rng(np.frombuffer(hashlib.sha256(old + bytes([copy])).digest(), "<u4"))
        letters = ALPHABETS[rng.integers(len(ALPHABETS))]
        value = letters[rng.integers(len(letters), size=rng.integers(16, 65))].tobytes()
        text = np.frombuffer(head + value + b" " + after, np.uint8)
        yield text, (0, len(head), len(head) + len(value), len(head))


def _windows(docs: DataFrame, id_col: str, text_col: str, share: float) -> DataFrame:
    """``key, positive, labels, features`` of training windows: around pattern spans, and around the longest other token of a text."""
    rows = docs.filter(hash_share(F.xxhash64(F.col(id_col).cast("string"))) < share).select(F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("key", pa.binary()), ("positive", pa.bool_()), ("labels", pa.binary()), ("features", pa.binary())])

    def window(t: Tokens, label: np.ndarray, centre: int, positive: bool) -> Iterator[dict]:
        own = np.arange(max(0, centre - REACH), min(len(label), centre + REACH + 1))
        own = own[t.chain[own] == t.chain[centre]]
        if not (t.unknown[own] & (label[own] == O)).any() and (positive or not label[own].any()) and label[own[0]] != I:
            codes, marks = t.features[own].astype("<i4").tobytes(), label[own].tobytes()
            yield {"key": hashlib.sha256(codes + marks).digest(), "positive": positive, "labels": marks, "features": codes}

    def found(group: Group) -> Iterator[dict]:
        for i, spans in enumerate(group.spans):
            for span in spans:
                for data, value in respelled(group.data, group.bounds[i], group.bounds[i + 1], span):
                    t = tokenize(data, np.array([0, len(data)]), np.array([file_code(group.data, group.bounds[i], group.bounds[i + 1])]))
                    label = _labels(t, [value])
                    for centre in np.flatnonzero(label == B):
                        yield from window(t, label, int(centre), True)
        for t, text in group.parts():
            label = _labels(t, [s for i in np.unique(text) for s in group.spans[i]])
            other = np.where(label == O, t.stop - t.start, 0)
            longest = np.lexsort((-other, text))[np.flatnonzero(np.diff(text, prepend=-1))]
            for positive, centres in ((True, np.flatnonzero(label == B)), (False, longest)):
                for centre in centres.tolist():
                    yield from window(t, label, centre, positive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in groups(batch.column(0)):
                yield pa.RecordBatch.from_pylist(list(found(group)), schema=schema)

    return rows.mapInArrow(run, "key binary, positive boolean, labels binary, features binary")


def fit_tagger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000, max_windows: int = 2_000, **options) -> Field | None:
    """A field fitted on about ``max_docs`` documents, those with the smallest id hashes, and on at most ``max_windows``
    windows with a pattern span and as many without; None where no window has one.
    """
    found = _windows(docs, id_col, text_col, max_docs / max(1, docs.count())).dropDuplicates(["key"])
    got = []
    for positive in (True, False):
        got += found.filter(F.col("positive") == positive).orderBy("key").limit(max_windows).collect()
    if not any(r["positive"] for r in got):
        return None
    got.sort(key=lambda r: bytes(r["key"]))
    width = 2 * REACH + 1
    features = np.tile(_FIRST[:-1], (len(got), width, 1))
    labels, lengths = np.zeros((len(got), width), np.int64), np.zeros(len(got), np.int64)
    for i, r in enumerate(got):
        own = np.frombuffer(r["labels"], np.int8)
        lengths[i] = len(own)
        labels[i, : len(own)], features[i, : len(own)] = own, np.frombuffer(r["features"], "<i4").reshape(-1, len(_SIZES))
    return train(features, labels, lengths, **options)


def tagged_spans(group: Group, field: Field, min_bytes: int) -> list[list[tuple[int, int]]]:
    """Byte spans that the field finds in each text, apart from pattern spans."""
    out: list[list[tuple[int, int]]] = [[] for _ in group.spans]
    for t, text in group.parts():
        label = viterbi(field.scores(t.features), field.steps, t.chain)
        held = np.flatnonzero(label)
        begin = np.ones(len(held), bool)
        begin[1:] = (label[held[1:]] == B) | (np.diff(held) > 1) | (t.chain[held[1:]] != t.chain[held[:-1]])
        first = np.flatnonzero(begin)
        for a, b in zip(held[first], held[np.append(first[1:], len(held))[: len(first)] - 1]):
            if t.stop[b] - t.start[a] >= min_bytes:
                out[text[a]].append((int(t.start[a]), int(t.stop[b])))
    return [[s for s in own if not _touches(fixed, *s)] for own, fixed in zip(out, map(_cover, group.spans))]


def _cover(spans: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Begins in order, and the largest end so far."""
    return np.array([s[1] for s in spans], np.int64), np.maximum.accumulate(np.array([s[2] for s in spans], np.int64))


def _touches(cover: tuple[np.ndarray, np.ndarray], start: int, stop: int) -> bool:
    at = np.searchsorted(cover[0], stop)
    return bool(at and cover[1][at - 1] > start)


def find_secrets(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 12) -> DataFrame:
    """``doc_id, spans`` of every whole text; a span is ``kind, start, stop``, in order of start and then of ``KINDS``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            out = []
            for group in groups(batch.column(1)):
                tagged = [[] for _ in group.spans] if field is None else tagged_spans(group, field, min_bytes)
                for at, end, spans, more in zip(group.bounds, group.bounds[1:], group.spans, tagged):
                    found = sorted([s[:3] for s in spans] + [(3, *s) for s in more], key=lambda s: (s[1], s[0]))
                    points = _running((group.data[at:end] & 0xC0) != 0x80) if found else None
                    out.append([{"kind": KINDS[k], "start": points[a - at], "stop": points[b - at]} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    key = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {key}, spans array<struct<kind:string,start:bigint,stop:bigint>>")


def secret_report(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id``, the pattern counts, a digest of the pattern spans, all spans as text, and the number of tagged ones."""
    found = find_secrets(docs, field, id_col, text_col, **options)
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(listed(F.filter(spans, lambda s: s["kind"] != "tagged")), 256).alias("base_sha256"), listed(spans).alias("spans"), n("tagged").alias("n_tagged"),
    )

"""Language-model scores by deleted interpolation of bigrams and unigrams.

P(w | h) = lambda(b) * c(h, w) / c(h) + (1 - lambda(b)) * (c(w) + a) / (N + a (V + 1)), where b is the
power of two below c(h). The weights are learned by expectation-maximisation on counts of a fold
that the maximum-likelihood estimates leave out; final estimates use all training documents.

Every word is a history of its own and every (history, word) count is exact. Blocks of documents
send each of their distinct words and pairs once, with its counts in the block, to the range of
hashes it falls in; the totals come back to the block. So a hot pair costs one entry per block, and
nothing that grows with the vocabulary is broadcast or collected. There is a range for every
``RANGE_BYTES`` of text, and Spark sorts what a task reads by range and by block, so that a task holds
one range or one block at a time, however many of them it gets. As a history is followed by exactly one
token, c(h) is the count of the word h. The weights need the ratio of the two estimates at each
token of the fold only: a histogram of ratios per b, in steps of 1 / ``STEPS`` of an octave and with
the mean ratio of each step, goes to the driver (a fixed size).

Words and pairs are told apart by 63-bit hashes.

Edge cases: a null or empty text has the end token only; a null id has the remainder of the empty
text; repeated rows are separate documents; with no training documents N and V are 0 and only the
add-``a`` estimate is left; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import partitions, written

BLOCK_DOCS, BLOCK_BYTES = 8192, 16 << 20
RANGE_BYTES = 32 << 20
STEPS = 64
MAIN, FOLD, HELD = 0, 1, 2
#: The step of a ratio of zero.
NEVER = -(1 << 30)


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; the end mark is added by position."""
    return (text or "").encode().lower().split()


def remainder(doc_id, modulus: int = 10) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def bucket_weights(bucket: np.ndarray, ratio: np.ndarray, n: np.ndarray, size: int, rounds: int = 40) -> np.ndarray:
    """Bigram weight of each bucket, by EM on ``n`` tokens whose bigram estimate is ``ratio`` times the unigram estimate."""
    weight = np.full(size, 0.5)
    total = np.maximum(np.bincount(bucket, n, size), 1e-12)
    for _ in range(rounds):
        share = weight[bucket] * ratio
        weight = np.clip(np.bincount(bucket, n * share / (share + 1 - weight[bucket]), size) / total, 1e-4, 1 - 1e-4)
    return weight


def mixture_weights(main: np.ndarray, held: np.ndarray, buckets: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Bigram weight of each bucket, by EM on the held counts under estimates from the main counts."""
    c, w = np.nonzero(held)
    high = main[c, w] / np.maximum(main.sum(axis=1), 1)[c]
    unigram = main.sum(axis=0) + 0.1
    return bucket_weights(buckets[c], high / (unigram / unigram.sum())[w], held[c, w].astype(float), int(buckets.max()) + 1, rounds)


def _octave(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 1).astype(float))[1] - 1


def _packed(values: np.ndarray) -> bytes:
    """Numbers at or above zero, by byte planes."""
    if not len(values):
        return b""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd", compression_level=6).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


_HEAD = np.dtype([("id", "<i8"), ("none", "?"), ("split", "u1"), ("n", "<i8")])
_ROWS = "bucket int, block long, head boolean, n long, a binary, b binary, c binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("head", pa.bool_()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_TALLIED = "block long, heads binary, words binary, pairs binary, octave int, step int, n long, total double"
_TALLIED_ARROW = pa.schema([
    ("block", pa.int64()), ("heads", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()),
    ("octave", pa.int32()), ("step", pa.int32()), ("n", pa.int64()), ("total", pa.float64()),
])
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Rows beside the blocks: the histogram of ratios, and types, main tokens and fold tokens.
_RATIOS, _TOTALS = -1, -2


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > start and (i - start == BLOCK_DOCS or size + n > BLOCK_BYTES):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if batch.num_rows:
        yield batch.slice(start)


def _starts(n_ranges: int) -> np.ndarray:
    return np.array([(b << 64) // n_ranges for b in range(n_ranges)], dtype=np.uint64)


def _keys(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray):
    """Keys of a block's words (odd) and pairs (even), the pair of each token, and the keys' order with the edges of the ranges."""
    code = np.concatenate([ids[-1:], ids[:-1]]) * np.int64(len(hashes)) + ids
    pairs, pair = np.unique(code, return_inverse=True)
    h, w = hashes[pairs // len(hashes)], hashes[pairs % len(hashes)]
    mixed = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (w + (h >> np.uint64(29)))
    for by, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(by)
    mixed ^= mixed >> np.uint64(31)
    keys = np.concatenate([hashes | np.uint64(1), mixed & ~np.uint64(1)])
    # Sorted keys are sent by their differences.
    order = np.argsort(keys)
    return keys, pair, order, np.append(np.searchsorted(keys[order], starts), len(keys))


def _tallied(docs: DataFrame, held_out: tuple[int, int], fold: int, smooth: float, n_ranges: int) -> DataFrame:
    """One row per block with the counts c(w) and c(h, w) of its tokens, and the rows of ``_RATIOS`` and ``_TOTALS``."""
    n_parts = partitions(docs.sparkSession)
    starts = _starts(n_ranges)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for batch in (s for whole in batches for s in _slices(whole)):
            head = np.zeros(batch.num_rows, _HEAD)
            index: dict[bytes | None, int] = {None: 0}
            flat: list[int] = []
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                found = tokens(text.as_py())
                flat += [index.setdefault(w, len(index)) for w in found]
                flat.append(0)
                r = remainder(doc_id, held_out[0])
                head[i] = (doc_id or 0, doc_id is None, HELD if r == held_out[1] else FOLD if r == fold else MAIN, len(found) + 1)
            ids = np.array(flat, dtype=np.int64)
            # No word holds a space, so the end mark has a hash of its own.
            hashes = np.array([xxhash.xxh64_intdigest(b" " if w is None else w, 42) for w in index], dtype=np.uint64)
            keys, pair, order, edges = _keys(hashes, ids, starts)
            split = np.repeat(head["split"], head["n"])
            main, held = (
                np.concatenate([np.bincount(ids[split == s], minlength=len(hashes)), np.bincount(pair[split == s], minlength=len(keys) - len(hashes))])
                for s in (MAIN, FOLD)
            )
            key = part << 32 | block
            rows = {"bucket": [-1], "block": [key], "head": [True], "n": [len(ids)], "a": [head.tobytes()], "b": [hashes.tobytes()], "c": [_packed(ids)]}
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                for k, v in zip(rows, (b, key, False, len(at), _packed(np.diff(keys[at], prepend=np.uint64(0))), _packed(main[at]), _packed(held[at]))):
                    rows[k].append(v)
            block += 1
            yield pa.RecordBatch.from_pydict(rows, schema=_ARROW)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                if one.column(2)[0].as_py():
                    yield one
                    continue
                row = one.to_pylist()[0]
                if entries and entries[0][0] != row["bucket"]:
                    yield from summed(entries)
                    entries = []
                own = np.cumsum(_unpacked(row["a"], row["n"]).view(np.uint64), dtype=np.uint64)
                entries.append((row["bucket"], row["block"], own, row["b"], row["c"]))
        if entries:
            yield from summed(entries)

    def summed(entries: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The entries of one range with their totals."""
        keys, inverse = np.unique(np.concatenate([e[2] for e in entries]), return_inverse=True)
        totals = []
        for i in (3, 4):
            counts = np.concatenate([_unpacked(e[i], len(e[2])) for e in entries])
            totals.append(np.bincount(inverse, counts, len(keys)).astype(np.int64))
        main, held = totals
        word = (keys & np.uint64(1)).astype(bool)
        sums = [int((word & (main + held > 0)).sum()), int(main[word].sum()), int(held[word].sum())]
        yield pa.RecordBatch.from_pylist([{"bucket": 0, "block": -1 - entries[0][0], "head": False, "n": 3, "a": np.array(sums, "<i8").tobytes()}], schema=_ARROW)
        at = 0
        for bucket, block, own, _, _ in entries:
            here = inverse[at : at + len(own)]
            at += len(own)
            row = {"bucket": bucket, "block": block, "head": False, "n": len(own), "b": _packed(main[here]), "c": _packed(held[here])}
            yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3, np.int64)
        ratios: dict[tuple[int, int], list] = {}

        def blocks() -> Iterator[tuple[dict, list[dict]]]:
            """The head of each block and what came back of it, in the order of ranges."""
            head, back = None, []
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    if row["block"] < 0:
                        np.add(sums, np.frombuffer(row["a"], "<i8"), out=sums)
                    elif row["head"]:
                        if head:
                            yield head, back
                        head, back = row, []
                    else:
                        back.append(row)
            if head:
                yield head, back

        for row, parts in blocks():
            block = row["block"]
            head, hashes, ids = np.frombuffer(row["a"], _HEAD), np.frombuffer(row["b"], "<u8"), _unpacked(row["c"], row["n"])
            keys, pair, order, _ = _keys(hashes, ids, starts)
            main, held = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
            main[order] = np.concatenate([_unpacked(p["b"], p["n"]) for p in parts])
            held[order] = np.concatenate([_unpacked(p["c"], p["n"]) for p in parts])
            both = main + held
            # The end mark before the first token is the last token of any document.
            before = np.concatenate([ids[-1:], ids[:-1]])
            pair += len(hashes)
            yield pa.RecordBatch.from_pylist([{"block": block, "heads": row["a"], "words": _packed(both[ids]), "pairs": _packed(both[pair])}], schema=_TALLIED_ARROW)
            at = np.flatnonzero(np.repeat(head["split"], head["n"]) == FOLD)
            h, w, p = before[at], ids[at], pair[at]
            ratio = main[p] / np.maximum(main[h], 1) / (main[w] + smooth)
            step = np.full(len(at), NEVER)
            step[ratio > 0] = np.floor(np.log2(ratio[ratio > 0]) * STEPS)
            places_, where = np.unique(np.stack([_octave(both[h]), step]), axis=1, return_inverse=True)
            n, total = np.bincount(where.ravel()), np.bincount(where.ravel(), ratio)
            for (o, s), k, t in zip(places_.T.tolist(), n.tolist(), total.tolist()):
                found = ratios.setdefault((o, s), [0, 0.0])
                found[0] += k
                found[1] += t
        rows = [{"block": _TOTALS, "octave": 0, "step": i, "n": n, "total": 0.0} for i, n in enumerate(sums.tolist())]
        rows += [{"block": _RATIOS, "octave": o, "step": s, "n": k, "total": t} for (o, s), (k, t) in ratios.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_TALLIED_ARROW)

    home = F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(n_parts)).cast("int")
    own = F.floor(F.col("bucket").cast("long") * n_parts / n_ranges).cast("int")
    dealt = docs.mapInArrow(places, _ROWS).repartitionById(n_parts, F.when(F.col("head"), home).otherwise(own))
    # With a partition for each range there is nothing to bring together.
    ranged = dealt if n_ranges <= n_parts else dealt.sortWithinPartitions("bucket")
    return ranged.mapInArrow(counted, _ROWS).repartitionById(n_parts, home).sortWithinPartitions("block", "bucket").mapInArrow(joined, _TALLIED)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (10, 0), fold: int = 1, smooth: float = 0.1,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Fits on the documents whose id remainder is not ``held_out[1]``; no word or history is left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_ranges = max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    tallied = written(_tallied(rows, held_out, fold, smooth, n_ranges), "tallied")
    small = tallied.filter("block < 0").groupBy("block", "octave", "step").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow().to_pandas()
    sums = small[small["block"] == _TOTALS].groupby("step")["n"].sum()
    n_types, n_main, n_fold = (int(sums.get(i, 0)) for i in range(3))
    n_train = n_main + n_fold
    ratios = small[small["block"] == _RATIOS].sort_values(["octave", "step"])
    unit = n_main + smooth * (n_types + 1)
    weight = bucket_weights(ratios["octave"].to_numpy(np.int64), (unit * ratios["total"] / ratios["n"]).to_numpy(float), ratios["n"].to_numpy(float), 64)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                head = np.frombuffer(row["heads"], _HEAD)
                start, n = np.cumsum(head["n"]) - head["n"], int(head["n"].sum())
                words, pairs = _unpacked(row["words"], n), _unpacked(row["pairs"], n)
                before = np.concatenate([words[-1:], words[:-1]])
                w = np.where(before > 0, weight[_octave(before)], 0.0)
                low = (words + smooth) / (n_train + smooth * (n_types + 1))
                value = np.log10(w * pairs / np.maximum(before, 1) + (1 - w) * low)
                known, base, score = (np.add.reduceat(x, start) for x in ((words > 0).astype(np.int64), np.log10(low), value))
                columns = [
                    pa.array(head["id"], mask=head["none"]), pa.array(head["split"] == HELD), pa.array(head["n"]), pa.array(known),
                    pa.array(np.full(len(head), n_train, np.int64)), pa.array(base), pa.array(score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return tallied.filter("block >= 0").select("heads", "words", "pairs").mapInArrow(scored, _SCORES)

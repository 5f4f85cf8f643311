"""Target-distribution importance resampling over hashed word n-grams.

Features are the runs of one to three consecutive words of a text; each falls into the bucket of its
bytes' CRC-32. CRCs are computed on length-bucketed matrices: the distinct features of a slice of
words are grouped by byte length into two-dimensional uint8 arrays, all CRCs of a group advance
column by column, and the buckets are scattered back to every occurrence.

One pass over the texts writes each document's sorted buckets (deltas of two bytes, a fraction of
the text); counts, weights and ranks come from that table. A bucket's gain is the scaled log ratio
of its smoothed shares in the target and in the documents, a weight the sum of gains, a score the
weight with Gumbel noise that depends on the id alone; the highest scores are drawn. Ranks follow
from a range partitioning by score with the row counts of its parts: no task orders the table.

Edge cases: a null text counts as empty; a text without words has no features and weight 0; a null
id is hashed as an empty id; repeated rows get equal scores and ranks of their own; ties go to the
smaller id, null first; an empty target or an empty table of documents is a count of zero; texts
and words of any length are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import fresh_path, partitions, written

#: Words of more than this many bytes make matrices of few rows; their CRCs are taken row by row.
LONG_SPAN = 1024
#: Bytes of text and words of one text that are worked on at a time.
SLICE_BYTES = 1 << 19
SLICE_WORDS = 1 << 17

_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table.astype(np.uint32)


_CRC = _crc_table()


def crc_of_spans(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each ``data[start : start + length]``, one matrix per byte length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, at, end in zip(sizes.tolist(), first, [*first[1:], len(order)]):
        rows = order[at:end]
        if size > LONG_SPAN:
            out[rows] = [zlib.crc32(data[s : s + size]) for s in start[rows]]
            continue
        matrix = data[np.arange(size)[:, None] + start[rows][None, :]]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in matrix:
            crc = _CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number among the distinct ones, and where each distinct one is found first."""
    codes = values.dictionary_encode().indices.to_numpy()
    first = np.empty(codes.max() + 1, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes.astype(np.int64), first


def _slice_buckets(low: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, count: int, buckets: int, max_words: int):
    """``doc, bucket`` of every feature that begins at one of the first ``count`` words of the slice."""
    size = end - start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    stream = low[np.repeat(start - at[:-1], size + 1) + np.arange(at[-1])]
    stream[at[1:] - 1] = 32
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(stream)])
    word, first = _codes(words)
    run, distinct = word, len(first)
    docs, found = [doc[:count]], []
    found.append((crc_of_spans(stream, at[first], size[first]) % buckets)[word[:count]])
    for n in range(2, max_words + 1):
        if len(run) < 2:
            break
        run, first = _codes(pa.array(run[:-1] * np.int64(distinct) + word[n - 1 :]))
        held = np.flatnonzero(doc[: len(run)] == doc[n - 1 :])
        held = held[held < count]
        used = np.unique(run[held])
        crc = np.zeros(len(first), np.uint32)
        crc[used] = crc_of_spans(stream, at[first[used]], (at[first[used] + n] - 1) - at[first[used]])
        docs.append(doc[held])
        found.append((crc % buckets)[run[held]])
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)


def bucket_runs(texts: pa.Array, buckets: int = 10_000, max_words: int = 3) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Number of words and sorted buckets of all features of each text, some texts at a time; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        low = np.append(_LOWER[data[offsets[at] : offsets[to]]], np.uint8(32))
        word = _WORD[low]
        edge = np.zeros(len(low) + 1, bool)
        edge[own] = True
        start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        end = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
        doc = np.searchsorted(own, start, "right") - 1
        keys = [np.zeros(0, np.int64)]
        for a in range(0, len(start), SLICE_WORDS):
            b = min(a + SLICE_WORDS, len(start))
            c = min(b + max_words - 1, len(start))
            docs, found = _slice_buckets(low, start[a:c], end[a:c], doc[a:c], b - a, buckets, max_words)
            keys.append(docs * buckets + found)
        key = np.sort(np.concatenate(keys))
        bounds = np.searchsorted(key, np.arange(to - at + 1) * buckets)
        yield np.bincount(doc, minlength=to - at), [key[i:j] - d * buckets for d, (i, j) in enumerate(zip(bounds, bounds[1:]))]
        at = to


def _packed(run: np.ndarray) -> bytes:
    return np.diff(run, prepend=0).astype("<u2").tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all rows one after the other, and where each row begins, with the end."""
    parts = [np.frombuffer(v.as_buffer(), "<u2") for v in column]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    total = np.cumsum(np.concatenate(parts) if parts else np.zeros(0), dtype=np.int64)
    before = np.concatenate([[0], total])[bounds[:-1]]
    return total - np.repeat(before, np.diff(bounds)), bounds


def features(docs: DataFrame, id_col: str, text_col: str, buckets: int = 10_000, max_words: int = 3) -> DataFrame:
    """``doc_id, n_words, runs`` of each row, written to the shared folder; at most 65,536 buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be from 1 to 65536")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n_words, runs in bucket_runs(batch.column(1), buckets, max_words):
                packed = pa.array([_packed(r) for r in runs], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(runs)), pa.array(n_words), packed], names=["doc_id", "n_words", "runs"])
                at += len(runs)

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs binary")
    path = fresh_path(docs.sparkSession, "features")
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket is met in all rows: every task sends its own counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("runs").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the ratio of smoothed shares) of each bucket."""
    k, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in pairs], np.int64)


def _weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, bounds = _unpacked(batch.column(2))
            total = np.concatenate([[0], np.cumsum(gain[bucket])])
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(total[bounds[1:]] - total[bounds[:-1]])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_words", "runs").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def _ranked(scored: DataFrame, eligible: str, percent: int) -> DataFrame:
    """``scored`` with ``rank`` 1, 2, ... of the drawn rows, null for all others."""
    spark = scored.sparkSession
    order = [F.col(eligible).desc(), F.col("score").desc(), F.col("doc_id").asc(), F.col("_row").asc()]
    parts = written(scored.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "scored")
    sizes = {r["_part"]: (r["n"], r["m"]) for r in parts.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(eligible).alias("m")).collect()}
    draw = percent * sum(m for _, m in sizes.values()) // 100
    before, offsets = 0, {}
    for part in sorted(sizes):
        if before < draw:
            offsets[part] = before
        before += sizes[part][0]
    if not offsets:
        return parts.withColumn("rank", F.lit(None).cast("long"))
    begin = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + begin[F.col("_part")]
    last = max(offsets)
    drawn = parts.filter(F.col("_part") <= last).withColumn("_place", place.cast("long"))
    ranked = drawn.withColumn("rank", F.when(F.col("_place") <= draw, F.col("_place"))).drop("_place")
    return ranked.unionByName(parts.filter(F.col("_part") > last).withColumn("rank", F.lit(None).cast("long")))


def importance_report(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = 5, min_words: int = 20, seed: int = 42, buckets: int = 10_000, max_words: int = 3,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null where it isn't drawn.

    ``percent`` of the documents with ``min_words`` words or more are drawn, those with the highest scores.
    """
    found = features(docs, id_col, text_col, buckets, max_words)
    wanted = features(target, target_text_col, target_text_col, buckets, max_words)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    noise = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(noise, 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighted = written(_weighted(found, gain).withColumn("_row", F.monotonically_increasing_id()), "weighted")
    scored = weighted.withColumn("score", F.col("weight") + gumbel).withColumn("_enough", F.col("n_words") >= min_words)
    return _ranked(scored, "_enough", percent).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that share a drawn id come together."""
    report = importance_report(docs, target, id_col, **options).filter("rank IS NOT NULL")
    drawn = report.select(F.col("doc_id").alias("__tm_drawn")).distinct()
    return docs.join(drawn, docs[id_col].eqNullSafe(F.col("__tm_drawn")), "left_semi")

"""Line dedup over whole corpora with DataFrame functions only.

Every line gets a 128-bit hash of its key (white space stripped at both ends, A-Z lower-cased). The
hashes are range-partitioned with a secondary sort by document and position, first occurrences and
document counts are streamed from that order, and each document gets back a run-length coded keep
bitmap. Texts never travel with the hashes.

Skew: a line that a third of all documents hold is spread over ``salts`` sort groups by the hash of
its document; the groups are summed with map-side partial aggregation. Only lines common enough to
be dropped are joined back to their occurrences, once per salt group in use, so that no join key
holds more than its share of a hot line.

Edge cases: a null or empty text is one empty line; keys shorter than ``min_key_chars`` are never
dropped; repeated rows count as documents of their own and get the same bitmap; an empty table
gives an empty result; other columns of the input are ignored by ``keep_bitmaps`` and kept
untouched by ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import UPPER, WHITE, partitions


def line_keys(text: Column) -> Column:
    """Array of the keys of a text's lines, in order."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.transform(F.split(low, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text`` and ``_th``, a hash that tells rows with one id but other texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_th"))


def _occurrences(rows: DataFrame, min_key_chars: int, salts: int) -> DataFrame:
    """One row per line that may be dropped: hash, salt, document and position."""
    hashed = F.transform(
        line_keys(F.col("_text")),
        lambda x, i: F.struct(
            i.alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), F.char_length(x).alias("n")
        ),
    )
    kept = F.filter(hashed, lambda s: s["n"] >= min_key_chars)
    numbered = rows.select("_id", "_th", F.monotonically_increasing_id().alias("_row"), kept.alias("_kept"))
    return (
        numbered.select("_id", "_th", "_row", F.inline("_kept"))
        .select("h1", "h2", F.pmod(F.xxhash64("_id", "_th"), F.lit(salts)).cast("int").alias("salt"), "_id", "_th", "_row", "pos")
    )


def _runs(positions: Column) -> Column:
    """Alternating lengths of kept and dropped runs, from sorted dropped positions."""
    starts = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    ends = F.filter(positions, lambda p, i: F.coalesce(F.get(positions, i + 1) != p + 1, F.lit(True)))
    return starts, ends


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_key_chars: int = 1,
    keep: str = "none",
    salts: int = 64,
) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: ``_id, _th, n_dropped, runs``.

    A key found in ``min_docs`` documents or more loses all its lines (``keep="none"``) or all but
    its first occurrence in document and position order (``keep="first"``). ``runs`` holds the
    lengths of alternating kept and dropped runs, kept first; lines after the last run stay.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep is 'none' or 'first', not {keep!r}")
    if not 1 <= salts <= 64:
        raise ValueError(f"salts is from 1 to 64, not {salts}")
    rows = _documents(docs, id_col, text_col)
    occ = _occurrences(rows, min_key_chars, salts)
    ranged = occ.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", "salt")
    order = Window.partitionBy("h1", "h2", "salt").orderBy("_id", "_th", "_row", "pos")
    streamed = ranged.withColumn("_new", F.when(F.lag("_row").over(order) == F.col("_row"), 0).otherwise(1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("salt"))
    heads = (
        streamed.groupBy("h1", "h2")
        .agg(F.sum("_new").alias("n_docs"), F.min(F.struct("_id", "_th", "pos")).alias("first"), F.bit_or(bit).alias("_used"))
        .filter(F.col("n_docs") >= min_docs)
    )
    used = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda s: F.call_function("getbit", F.col("_used"), s) == 1)
    dropped = occ.join(heads.select("h1", "h2", "first", F.explode(used).alias("salt")), ["h1", "h2", "salt"])
    if keep == "first":
        dropped = dropped.filter(~F.struct("_id", "_th", "pos").eqNullSafe(F.col("first")))
    gathered = dropped.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("_pos"))
    starts, ends = _runs(F.col("_pos"))
    spans = gathered.select("_id", "_th", F.size("_pos").cast("long").alias("n_dropped"), starts.alias("_from"), ends.alias("_to"))
    lengths = F.flatten(
        F.transform(
            "_from",
            lambda s, i: F.array(
                s - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_to"), i - 1) + 1), F.get(F.col("_to"), i) - s + 1
            ),
        )
    )
    return spans.select("_id", "_th", "n_dropped", lengths.alias("runs"))


def _applied(lines: Column, bits: Column) -> Column:
    kept = F.filter(lines, lambda x, i: F.coalesce(F.get(bits, i), F.lit(True)))
    return F.array_join(kept, "\n")


def _bits(runs: Column) -> Column:
    """The keep bitmap that run lengths stand for, as booleans."""
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text_col``; every row and column stays.

    Documents that lose nothing keep their text as it is, a null text included.
    """
    bitmaps = keep_bitmaps(docs, id_col, text_col, **options).select(
        F.col("_id").alias("__tm_id"), F.col("_th").alias("__tm_th"), _bits(F.col("runs")).alias("__tm_bits")
    )
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    joined = docs.withColumn("__tm_own", th).join(
        bitmaps, F.col(id_col).eqNullSafe(F.col("__tm_id")) & (F.col("__tm_own") == F.col("__tm_th")), "left"
    )
    new = F.when(F.col("__tm_bits").isNull(), F.col(text_col)).otherwise(
        _applied(F.split(F.col(text_col), "\n", -1), F.col("__tm_bits"))
    )
    return joined.withColumn("__tm_new", new).select(
        *[F.col("__tm_new").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: ``doc_id, n_lines, n_dropped, kept_sha256``."""
    rows = _documents(docs, id_col, text_col)
    bitmaps = keep_bitmaps(docs, id_col, text_col, **options).select(
        F.col("_id").alias("_bid"), F.col("_th").alias("_bth"), "n_dropped", _bits(F.col("runs")).alias("_bits")
    )
    joined = rows.join(bitmaps, rows["_id"].eqNullSafe(F.col("_bid")) & (rows["_th"] == F.col("_bth")), "left")
    split = joined.withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.when(F.col("n_dropped").isNull(), F.col("_text")).otherwise(_applied(F.col("_lines"), F.col("_bits")))
    return split.select(
        F.col("_id").alias("doc_id"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )

"""Benchmark decontamination with DataFrame functions only.

Texts and items are split into words of letters and digits, lower-cased. Item-sized windows of a
text are laid where text and item share a shingle (any window with a similarity above zero holds
one), aligned so that the shared shingle falls on its place in the item. Every such window is
verified by its exact weighted similarity: the share of the item's shingle weight (inverse item
frequency) that the window holds, repeats included. Text and item are compared only where the text
holds one of the item's ``anchors``: its heaviest shingles, as many as weigh more than a window may
lack at the threshold, so that no window at the threshold can be without one. SimHash distances of
the windows found are reported and decide nothing but ties.

Broadcasts are made only below ``BROADCAST_ROWS`` counted rows; beyond it the same joins shuffle.

Edge cases: null and empty texts or items have no words and match nothing; a text shorter than an
item is one window; items below ``shingle`` words are compared as whole sequences; equal items
match alike; repeated rows of documents count once in pairs and are dropped alike; other columns
are ignored by ``contamination`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import written

BROADCAST_ROWS = 200_000
BITS = 64


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(hashes: Column, width: int) -> Column:
    """Hashes of runs of ``width`` word hashes; none where there are fewer words."""
    n = F.size(hashes)
    runs = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))
    return F.when(n >= width, runs).otherwise(F.array().cast("array<bigint>"))


def _fingerprint(grams: Column) -> Column:
    """SimHash: a bit is one where over half the grams have it."""
    zero = F.lit(0).cast("long")
    votes = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.when(
            2 * F.aggregate(grams, F.lit(0), lambda a, g: a + F.call_function("getbit", g, b).cast("int")) > F.size(grams),
            F.call_function("shiftleft", F.lit(1).cast("long"), b),
        ).otherwise(zero),
    )
    return F.aggregate(votes, zero, lambda a, v: a.bitwiseOR(v))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def benchmark_items(items: DataFrame, item_col: str, text_col: str, shingle: int) -> DataFrame:
    """Per item with words: ``item_id, size, width, grams, fp, weights`` (gram, weight, count) and their total."""
    hashed = items.select(F.col(item_col).alias("item_id"), _word_hashes(F.col(text_col)).alias("_wh")).filter(F.size("_wh") > 0)
    made = hashed.select(
        "item_id", F.size("_wh").alias("size"), F.least(F.size("_wh"), F.lit(shingle)).alias("width"),
        reduce(lambda rest, k: F.when(F.size("_wh") == k, _grams(F.col("_wh"), k)).otherwise(rest), range(1, shingle), _grams(F.col("_wh"), shingle)).alias("grams"),
    )
    counted = made.select("item_id", F.explode_outer("grams").alias("gram")).groupBy("item_id", "gram").agg(F.count("*").cast("int").alias("n"))
    spread = counted.groupBy("gram").agg(F.count("*").alias("_df"))
    total = items.count()
    weighed = counted.join(spread, "gram").groupBy("item_id").agg(
        F.sort_array(F.collect_list(F.struct("gram", (1 + F.log(F.lit(float(max(1, total))) / F.col("_df"))).alias("weight"), "n"))).alias("weights")
    )
    whole = F.aggregate("weights", F.lit(0.0), lambda a, e: a + e["weight"] * e["n"])
    return made.join(weighed, "item_id").select("item_id", "size", "width", "grams", _fingerprint(F.col("grams")).alias("fp"), "weights", whole.alias("whole"))


def _anchors(bench: DataFrame, threshold: float) -> DataFrame:
    """``item_id, width, gram``: an item's heaviest shingles until they outweigh what a window may lack."""
    heavy = Window.partitionBy("item_id").orderBy(F.desc("weight"), "gram").rowsBetween(Window.unboundedPreceding, -1)
    each = bench.select("item_id", "width", "whole", F.inline("weights"))
    before = F.coalesce(F.sum(F.col("weight") * F.col("n")).over(heavy), F.lit(0.0))
    return each.withColumn("_before", before).filter(F.col("_before") <= (1 - threshold + 1e-9) * F.col("whole")).select("item_id", "width", "gram")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    shingle: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, th, item_id, start_word, n_words, distance, similarity``: the best window per document and item.

    ``th`` is a hash of the text.
    """
    bench = written(benchmark_items(items, item_col, item_text, shingle), "bench")
    n_items = bench.count()
    widths = [r[0] for r in bench.select("width").distinct().collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    anchors = written(_anchors(bench, threshold), "anchors")
    n_anchors = anchors.count()
    met = []
    for k in widths or [shingle]:
        grams = rows.select("doc_id", "th", _word_hashes(F.col("text")).alias("_wh")).select("doc_id", "th", _grams(F.col("_wh"), k).alias("_g"))
        # The outer form, as the inner one infers a filter whose pushdown would compute the grams anew per element.
        placed = grams.select("doc_id", "th", F.explode_outer("_g").alias("gram"))
        hits = placed.join(_sized(anchors.filter(F.col("width") == k).select("gram", "item_id"), n_anchors), "gram")
        met.append(hits.select("doc_id", "th", "item_id"))
    pairs = written(
        reduce(DataFrame.union, met).groupBy("doc_id", "th").agg(F.collect_set("item_id").alias("items")), "pairs"
    ).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "items")
    held = rows.join(_sized(pairs, pairs.count()), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    once = held.dropDuplicates(["_id", "_th"]).select("doc_id", "th", _word_hashes(F.col("text")).alias("_wh"), "items")
    shingled = reduce(
        lambda rest, k: F.when(F.col("width") == k, _grams(F.col("_wh"), k)).otherwise(rest), widths, F.array().cast("array<bigint>")
    )
    met_items = once.select("doc_id", "th", "_wh", F.explode("items").alias("item_id")).join(_sized(bench, n_items), "item_id")
    texts = met_items.select("doc_id", "th", "item_id", "size", "width", "grams", "fp", "weights", "whole", F.size("_wh").alias("n"), shingled.alias("_g"))
    shared = F.filter(F.transform("_g", lambda g, p: F.struct(p.alias("p"), g.alias("g"))), lambda e: F.array_contains("grams", e["g"]))
    places = F.filter(F.transform("grams", lambda g, q: F.struct(q.alias("q"), g.alias("g"))), lambda e: F.array_contains("_g", e["g"]))
    starts = F.flatten(F.transform("_shared", lambda e: F.transform(
        F.filter("_places", lambda o: o["g"] == e["g"]), lambda o: F.greatest(F.lit(0), F.least(e["p"] - o["q"], F.col("n") - F.col("size")))
    )))
    # Written, so that no filter or projection above computes the arrays of a text anew per window.
    laid = written(
        texts.withColumn("_shared", shared).withColumn("_places", places).withColumn("starts", F.array_distinct(starts)).drop("_shared", "_places"), "laid"
    )
    windows = laid.select("*", F.explode("starts").alias("start")).withColumn("_wg", F.slice("_g", F.col("start") + 1, F.size("grams"))).drop("_g", "starts")
    held_weight = F.aggregate(
        "weights", F.lit(0.0),
        lambda a, e: a + e["weight"] * F.when(e["n"] == 1, F.array_contains("_wg", e["gram"]).cast("int")).otherwise(
            F.least(e["n"], F.size(F.filter("_wg", lambda g: g == e["gram"])))
        ),
    )
    verified = (
        windows.withColumn("similarity", held_weight / F.col("whole")).filter(F.col("similarity") >= threshold - 1e-12)
        .withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(_fingerprint(F.col("_wg")))))
    )
    best = F.max(F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start")).alias("s"), F.col("size").alias("n_words")))
    return verified.groupBy("doc_id", "th", "item_id").agg(best.alias("b")).select(
        "doc_id", "th", "item_id", (-F.col("b.s")).cast("long").alias("start_word"), F.col("b.n_words").cast("long").alias("n_words"),
        (-F.col("b.d")).cast("int").alias("distance"), F.col("b.similarity").alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; columns stay as they are."""
    found = contamination(docs, items, id_col, text_col, **options)
    bad = written(found.select(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th")).distinct(), "contaminated")
    own = docs.withColumn("__tm_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    match = F.col(id_col).eqNullSafe(F.col("__tm_id")) & (F.col("__tm_own") == F.col("__tm_th"))
    return own.join(_sized(bad, bad.count()), match, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

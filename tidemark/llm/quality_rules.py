"""Quality rules: text statistics, and a decision list learned by sequential covering.

Statistics are DataFrame expressions over whole texts. A decision list is an ordered list of
conjunctions of thresholds, each with a verdict; it is grown and pruned on a bounded sample of
labelled statistics (numbers, never texts) and emitted as one ordered ``CASE WHEN``.

Edge cases: a null text counts as empty; a text without words has zero everywhere and fails the
base rules; repeated rows are scored alike; without labelled rows (or with one class only) the list
is its default verdict, ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import WHITE, WORD_GAP

SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test: shares and means, so that they mean the same at every length.
FEATURES = (
    "mean_word_chars", "symbol_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "alpha_word_share", "bang_per_word", "words_per_line", "distinct_share",
)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeat_window: int = 5) -> DataFrame:
    """Per document: ``doc_id``, the base counts and the features rules may test."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    split = base.select(
        "doc_id", "_text", F.array_remove(F.split("_text", WORD_GAP), "").alias("_words"), F.split("_text", "\n", -1).alias("_lines")
    )
    n = F.size("_words")
    grams = F.when(
        n >= repeat_window,
        F.transform(F.sequence(F.lit(1), n - (repeat_window - 1)), lambda i: F.xxhash64(F.slice("_words", i, repeat_window))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter("_lines", lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    hashed = split.select(
        "doc_id", "_text", "_words", grams.alias("_grams"), lines.alias("_full"), n.cast("long").alias("n_words")
    )
    # Positions are sorted by gram only for texts that repeat one; neighbours then show the repeats.
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.when(
        repeats, F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    marked = hashed.select(
        "doc_id", "_text", "_words", "n_words",
        F.size("_full").cast("long").alias("_n_full"),
        F.size(F.array_distinct("_full")).cast("long").alias("_n_distinct_lines"),
        pairs.alias("_pairs"),
    )
    twice = F.filter(
        "_pairs",
        lambda p, i: F.coalesce(F.get(F.col("_pairs"), i - 1)["h"] == p["h"], F.lit(False))
        | F.coalesce(F.get(F.col("_pairs"), i + 1)["h"] == p["h"], F.lit(False)),
    )
    starts = marked.withColumn("_starts", F.sort_array(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform(
            "_starts",
            lambda s, i: F.least(F.coalesce(F.get(F.col("_starts"), i + 1) - s, F.lit(repeat_window)), F.lit(repeat_window)),
        ),
        F.lit(0), lambda a, x: a + x,
    )
    t, w = F.col("_text"), F.col("_words")
    chars = lambda drop: F.length(t) - F.length(F.translate(t, drop, ""))
    counted = starts.select(
        "doc_id", "n_words",
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        (F.col("_n_full") - F.col("_n_distinct_lines")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        chars("0123456789").alias("_digit"),
        chars("!").alias("_bang"),
        F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).alias("_alpha"),
        F.size(F.array_distinct(w)).alias("_distinct"),
        F.col("_n_full").alias("_n_full"),
    )
    one = lambda c: F.greatest(c, F.lit(1))
    words, size = one(F.col("n_words")), one(F.col("word_chars"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_per_word"),
        (F.col("n_dup_lines") / one(F.col("_n_full"))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_upper") / size).alias("upper_share"),
        (F.col("_digit") / size).alias("digit_share"),
        (F.col("_alpha") / words).alias("alpha_word_share"),
        (F.col("_bang") / words).alias("bang_per_word"),
        (F.col("n_words") / one(F.col("_n_full"))).alias("words_per_line"),
        (F.col("_distinct") / words).alias("distinct_share"),
    )


def base_failed(min_words: int = 10, repeat_percent: int = 20) -> Column:
    """The fixed rules that come before the learned list."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A conjunction of ``(feature, "<=" or ">", threshold)``; what it covers is dropped or kept."""

    tests: tuple[tuple[str, str, float], ...]
    keep: bool
    covered: int = 0
    precision: float = 0.0

    def condition(self) -> Column:
        parts = [F.col(f) <= t if op == "<=" else F.col(f) > t for f, op, t in self.tests]
        return reduce(lambda a, b: a & b, parts)

    def text(self) -> str:
        tests = " AND ".join(f"{f} {op} {t:.6g}" for f, op, t in self.tests)
        return f"IF {tests} THEN {'keep' if self.keep else 'drop'}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; the first that holds decides, else ``default``."""

    rules: tuple[Rule, ...] = ()
    default: bool = True
    features: tuple[str, ...] = field(default=FEATURES)

    def verdict(self) -> Column:
        """One ordered conditional expression over the statistics."""
        out = None
        for rule in self.rules:
            out = F.when(rule.condition(), rule.keep) if out is None else out.when(rule.condition(), rule.keep)
        return F.lit(self.default) if out is None else out.otherwise(self.default)

    def text(self) -> str:
        return "\n".join([*(r.text() for r in self.rules), f"ELSE {'keep' if self.default else 'drop'}"])


def _covers(row: dict, tests) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in tests)


def _cuts(values: list[float], bins: int) -> list[float]:
    """At most ``bins`` thresholds, midway between neighbouring distinct quantiles."""
    ordered = sorted(values)
    picked = sorted({ordered[min(len(ordered) - 1, k * len(ordered) // bins)] for k in range(bins)} | {ordered[-1]})
    return [(a + b) / 2 for a, b in zip(picked, picked[1:])]


def _grow(rows: list[dict], cuts: dict[str, list[float]], max_tests: int, smooth: float) -> tuple:
    """Add the threshold with the best smoothed precision on the bad class until none improves it."""
    tests: tuple = ()
    prior = sum(r["_bad"] for r in rows) / len(rows)
    best = prior
    held = rows
    while len(tests) < max_tests:
        found = None
        for f, points in cuts.items():
            ordered = sorted(((r[f], r["_bad"]) for r in held))
            total, bad = len(ordered), sum(b for _, b in ordered)
            at = n = b = 0
            for cut in points:
                while at < total and ordered[at][0] <= cut:
                    n, b, at = n + 1, b + ordered[at][1], at + 1
                for op, k, good in (("<=", n, b), (">", total - n, bad - b)):
                    if 0 < k < total and good:
                        value = (good + smooth * prior) / (k + smooth)
                        if value > best + 1e-9 and (found is None or (value, good) > found[:2]):
                            found = (value, good, f, op, cut)
        if found is None:
            break
        best, _, f, op, cut = found
        tests += ((f, op, cut),)
        held = [r for r in held if _covers(r, tests[-1:])]
        if all(r["_bad"] for r in held):
            break
    return tests


def _prune(tests: tuple, rows: list[dict]) -> tuple:
    """Drop final tests while (bad - good covered) / covered on held-out rows does not fall."""

    def worth(t) -> float:
        covered = [r["_bad"] for r in rows if _covers(r, t)]
        return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0

    while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
        tests = tests[:-1]
    return tests


def learn_rules(
    sample: list[dict], features: tuple[str, ...] = FEATURES, max_rules: int = 8, max_tests: int = 3, bins: int = 48,
    min_precision: float = 0.9, min_covered: int = 5, smooth: float = 10.0,
) -> DecisionList:
    """Sequential covering on rows that hold ``features`` and ``quality`` (1 good, 0 bad).

    Each rule is grown on two thirds of the rows left, pruned on the other third, and kept while
    its precision on all rows left reaches ``min_precision``; the rows it covers then go.
    """
    rows = [r | {"_bad": int(r["quality"] == 0)} for r in sample if r.get("quality") is not None]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(r["_bad"] for r in rows) and not all(r["_bad"] for r in rows):
        grow = [r for i, r in enumerate(rows) if i % 3]
        check = [r for i, r in enumerate(rows) if i % 3 == 0]
        if not any(r["_bad"] for r in grow):
            break
        cuts = {f: _cuts([r[f] for r in grow], bins) for f in features}
        tests = _prune(_grow(grow, cuts, max_tests, smooth), check)
        covered = [r["_bad"] for r in rows if _covers(r, tests)] if tests else []
        if len(covered) < min_covered or sum(covered) < min_precision * len(covered):
            break
        rules.append(Rule(tests, False, len(covered), sum(covered) / len(covered)))
        rows = [r for r in rows if not _covers(r, tests)]
    return DecisionList(tuple(rules), True, features)


def fit_quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000, **options
) -> DecisionList:
    """Learn a list from at most ``max_rows`` labelled documents, those with the smallest id hashes.

    Only their statistics (a dozen numbers a row) reach the driver.
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    stats = text_statistics(picked, "doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = [r.asDict() for r in stats.select("doc_id", "quality", *FEATURES).collect()]
    rows.sort(key=lambda r: tuple(str(r[k]) for k in ("doc_id", *FEATURES)))
    return learn_rules(rows, **options)


def apply_rules(
    docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, repeat_percent: int = 20
) -> DataFrame:
    """Statistics of every document with ``base_failed`` and ``kept``.

    Write the result before filtering by these columns: Spark pushes such a filter below the arrays of
    the text and then computes them anew for each of its terms.
    """
    stats = text_statistics(docs, id_col, text_col).withColumn("base_failed", base_failed(min_words, repeat_percent))
    return stats.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(rules.verdict()))

"""Order statistics, frozen percentile grids and detection metrics, without a single ordered partition.

Whole-table orders are cut into value slices: cut points are approximate quantiles (at most
``slices`` numbers), every distinct value belongs to one slice, slices are summed, and running sums
start from the sum of the slices before. Equal values are pre-aggregated to one row first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import ratio
from tidemark.staging import staged


def running(values: DataFrame, key: str, sums: Sequence[str], slices: int = 64) -> DataFrame:
    """``values`` (one row per ``key``, a written table: it is read four times) with, for each column c of ``sums``, ``c_before``: its sum over lesser keys."""
    spread = values.agg(F.percentile_approx(key, [i / slices for i in range(1, slices)], 10_000).alias("q")).first()["q"]
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(spread or []))]) if spread else F.array().cast("array<double>")
    sliced = values.withColumn("_slice", F.size(F.filter(cuts, lambda c: c < F.col(key).cast("double"))))
    whole = sliced.groupBy("_slice").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    # At most ``slices`` rows.
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_slice", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    within = Window.partitionBy("_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.join(F.broadcast(starts), "_slice")
    return joined.withColumns({f"{c}_before": F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}).drop(*[f"_{c}" for c in sums])


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], slices: int = 64) -> DataFrame:
    """``q, value``: linear-interpolated quantiles, exact; nulls are left out, an empty column gives nulls."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    counted, _ = staged(counted, "values")
    ranked = running(counted, "v", ["n"], slices)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    aims = []
    for q in qs:
        at = q * max(total - 1, 0)
        low = int(at)
        aims.append((float(q), low, min(low + 1, max(total - 1, 0)), at - low))
    wanted = df.sparkSession.createDataFrame(aims, "q double, low long, high long, share double")
    holds = lambda c: (F.col("n_before") <= F.col(c)) & (F.col(c) < F.col("n_before") + F.col("n"))
    picked = ranked.join(F.broadcast(wanted), holds("low") | holds("high"), "right")
    return picked.groupBy("q").agg(
        (F.max(F.when(holds("low"), F.col("v"))) + F.max("share") * (F.max(F.when(holds("high"), F.col("v"))) - F.max(F.when(holds("low"), F.col("v"))))).alias("value")
    )


def weighted_points(df: DataFrame, value: str, weight: str, tie: str, slices: int = 64) -> DataFrame:
    """``v, a0, a1``: the midpoint weighted CDF at the first and last row of each distinct value."""
    grouped = df.groupBy(F.col(value).alias("v")).agg(
        F.sum(weight).alias("w"), F.min_by(weight, tie).alias("w_first"), F.max_by(weight, tie).alias("w_last")
    )
    grouped, _ = staged(grouped, "values")
    total = grouped.agg(F.sum("w")).first()[0]
    return running(grouped, "v", ["w"], slices).select(
        "v", "_slice", ((F.col("w_before") + F.col("w_first") / 2) / F.lit(total)).alias("a0"),
        ((F.col("w_before") + F.col("w") - F.col("w_last") / 2) / F.lit(total)).alias("a1"),
    )


def weighted_quantiles(df: DataFrame, value: str, weight: str, tie: str, steps: int = 1000, slices: int = 64) -> DataFrame:
    """``k, pct, score``: weighted quantiles at k / steps for k = 0 .. steps, linear between midpoints of the CDF."""
    points = weighted_points(df, value, weight, tie, slices)
    heads = points.groupBy("_slice").agg(F.min(F.struct("v", "a0")).alias("head"))
    after = heads.select("_slice", F.lead("head").over(Window.orderBy("_slice")).alias("_next"), F.lag("head").over(Window.orderBy("_slice")).isNull().alias("_lowest"))
    order = Window.partitionBy("_slice").orderBy("v")
    near = points.join(F.broadcast(after), "_slice").select(
        "v", "a0", "a1", F.coalesce(F.lead(F.struct("v", "a0")).over(order), F.col("_next")).alias("n"),
        (F.lag("v").over(order).isNull() & F.col("_lowest")).alias("lowest"),
    )
    first = F.when(F.col("lowest"), F.lit(0)).otherwise(F.ceil(F.col("a0") * steps - 1e-9)).cast("long")
    # From this point up to, not including, the next; the last one holds to the end.
    stop = F.when(F.col("n").isNull(), F.lit(steps)).otherwise(F.ceil(F.col("n.a0") * steps - 1e-9) - 1).cast("long")
    ks = F.when(stop >= first, F.sequence(first, stop)).otherwise(F.array().cast("array<bigint>"))
    q = F.col("k") / F.lit(float(steps))
    inside = F.col("v") + (F.col("n.v") - F.col("v")) * (q - F.col("a1")) / (F.col("n.a0") - F.col("a1"))
    return near.select("v", "a1", "n", F.explode(ks).alias("k")).select(
        "k", q.alias("pct"), F.when(F.col("n").isNull() | (q <= F.col("a1")), F.col("v")).otherwise(inside).alias("score")
    )


def percentile_lookup(df: DataFrame, score: str, grid: Sequence[tuple[float, float]], out: str = "percentile") -> DataFrame:
    """``df`` with the percentile of ``score`` on a frozen grid of (pct, score) in order, 0 and 1 beyond its ends.

    Among equal grid scores the last counts. The grid is a literal of stated size (1001 points).
    """
    last: dict[float, float] = {}
    first: dict[float, float] = {}
    for pct, s in grid:
        last[float(s)] = float(pct)
        first.setdefault(float(s), float(pct))
    xs = sorted(last)
    if not xs:
        return df.withColumn(out, F.lit(None).cast("double"))
    # Of each step its lower score and percentile, and the score and percentile that it leads to.
    ends = [*zip(xs[1:], [first[x] for x in xs[1:]]), (xs[-1], last[xs[-1]])]
    x, p, y, r = (F.lit([float(v) for v in values]) for values in (xs, [last[v] for v in xs], [e[0] for e in ends], [e[1] for e in ends]))
    s = F.col(score)
    # Binary search over the literals: the largest step whose x is not above the score.
    found, at = df, F.lit(0)
    width = 1 << (len(xs).bit_length() - 1)
    while width:
        probe = at + width
        found = found.withColumn("_at", F.when((probe < len(xs)) & (F.get(x, probe) <= s), probe).otherwise(at))
        at = F.col("_at")
        width //= 2
    low, gap = F.get(x, at), F.get(y, at) - F.get(x, at)
    inside = F.get(p, at) + (s - low) * (F.get(r, at) - F.get(p, at)) / gap
    value = F.when(s.isNull(), None).when(s < xs[0], 0.0).when(s > xs[-1], 1.0).when((gap == 0) | (s == low), F.get(p, at)).otherwise(inside)
    return found.withColumn(out, value).drop("_at")


def moments(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> dict[str, tuple[float, float]] | None:
    """Mean and population deviation (1 where it is 0) of each column; None where there are no rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.agg(F.sum(w).alias("w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in cols]).first()
    if means["w"] is None:
        return None
    spread = df.agg(*[F.sqrt(F.sum(w * (F.col(c) - means[c]) ** 2) / means["w"]).alias(c) for c in cols]).first()
    return {c: (means[c], spread[c] if spread[c] and spread[c] > 0 else 1.0) for c in cols}


def standardised(df: DataFrame, scaler: dict[str, tuple[float, float]] | None) -> DataFrame:
    """``df`` with each column of ``scaler`` minus its mean, over its deviation."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()}) if scaler else df


def zscore(df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """``df`` with each column minus its mean, over its population deviation (1 where that is 0)."""
    return standardised(df, moments(df, cols, weight))


def score_diagnostics(df: DataFrame, score: str, label: str) -> DataFrame:
    """``p50, p95, top, mean_normal, mean_anomaly, separation``; separation is infinite where normals do not vary."""
    qs = exact_quantiles(df, score, [0.5, 0.95]).groupBy().agg(F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("p50"), F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"))
    normal, odd = F.when(F.col(label) == 0, F.col(score)), F.when(F.col(label) == 1, F.col(score))
    rest = df.agg(F.max(score).alias("top"), F.avg(normal).alias("mean_normal"), F.avg(odd).alias("mean_anomaly"), F.stddev_pop(normal).alias("_s"))
    gap = F.col("mean_anomaly") - F.col("mean_normal")
    return qs.join(F.broadcast(rest)).withColumn("separation", F.when(F.col("_s") > 0, gap / F.col("_s")).otherwise(float("inf"))).drop("_s")


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` per group."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    return df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )


def with_rates(counts: DataFrame, zero: float | None = None) -> DataFrame:
    """Counts with ``recall, precisao, taxa_falso_positivo``; ``zero`` stands where a denominator is 0 (else null)."""
    fill = (lambda c: c) if zero is None else (lambda c: F.coalesce(c, F.lit(zero)))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({"recall": fill(ratio(tp, tp + fn)), "precisao": fill(ratio(tp, tp + fp)), "taxa_falso_positivo": fill(ratio(fp, fp + tn))})


def detection_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts, rates, accuracy and F1 of one table; 0 where a denominator is 0."""
    out = with_rates(confusion(df, label, predicted), 0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": F.coalesce(ratio(tp + tn, tp + fp + fn + tn), F.lit(0.0)), "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))})


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    counted = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return running(staged(counted, "values")[0], "s", ["pos", "neg"])


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """``roc_auc`` by the rank sum, ties counted half; null with one class only."""
    ranked = _by_score(df, score, label)
    hits = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.agg(ratio(hits, F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """``average_precision``: the sum over distinct scores, highest first, of recall gained times precision."""
    ranked = _by_score(df, score, label)
    totals = ranked.agg(F.sum("pos"), F.sum("neg")).first()
    p, n = (totals[0] or 0), (totals[1] or 0)
    above = F.lit(p) - F.col("pos_before")
    seen = F.lit(p + n) - F.col("pos_before") - F.col("neg_before")
    return ranked.agg(ratio(F.sum(F.col("pos") * above / seen), F.lit(float(p))).alias("average_precision"))

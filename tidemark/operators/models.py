"""Detector, surrogate and refiner: isolation forest (Liu, Ting and Zhou, 2008), rule tree, linear SVM, PCA.

Fits take bounded samples (``trees * sample`` rows for the forest) or Spark ML; scoring reads all
rows in Arrow batches or as plain expressions over a few literals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite
from tidemark.operators.explore import nearest, stratified_folds, stratified_split
from tidemark.operators.stats import detection_metrics, exact_quantiles, moments, standardised, weighted_quantiles
from tidemark.staging import staged

NODES = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree in preorder: (feature or -1, split, left, right, size, depth)."""
    nodes: list = []
    todo = [(np.arange(len(x)), 0, None, False)]
    while todo:
        rows, depth, parent, is_right = todo.pop()
        at = len(nodes)
        if parent is not None:
            nodes[parent][3 if is_right else 2] = at
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        live = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(live):
            nodes.append([-1, 0.0, -1, -1, len(rows), depth])
            continue
        f = int(rng.choice(live))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes.append([f, cut, -1, -1, len(rows), depth])
        todo += [(rows[x[rows, f] > cut], depth + 1, at, True), (rows[x[rows, f] <= cut], depth + 1, at, False)]
    return nodes


@dataclass
class Forest:
    cols: list[str]
    sample: int
    nodes: pd.DataFrame = field(repr=False)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path); larger is more anomalous."""
        total = np.zeros(len(x))
        trees = [t for _, t in self.nodes.sort_values(["tree", "node"]).groupby("tree")]
        for t in trees:
            feature, split, left, right = (t[c].to_numpy() for c in ("feature", "split", "left", "right"))
            ends = t["depth"].to_numpy() + np.array([path_constant(n) for n in t["size"]])
            at = np.zeros(len(x), np.int64)
            for _ in range(int(t["depth"].max()) + 1):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                here = at[rows]
                low = x[rows, feature[here]] <= split[here]
                at[rows] = np.where(low, left[here], right[here])
            total += ends[at]
        return 2.0 ** (-(total / max(1, len(trees))) / max(path_constant(self.sample), 1e-12))


def fit_forest(df: DataFrame, cols: Sequence[str], id_col: str, trees: int = 200, sample: int = 256, seed: int = 42, weight: str | None = None) -> Forest:
    """Trees on draws of ``sample`` rows without replacement (by weight where given), grown in parallel tasks.

    The draws come from the ``trees * sample`` rows with the smallest id hashes.
    """
    spark = df.sparkSession
    bound = trees * sample
    # About a fifth more than the bound passes, however many partitions there are.
    near = F.xxhash64(F.lit(seed), F.col(id_col).cast("string")) / F.lit(2.0**64) + 0.5 <= (1.2 * bound + 1000) / max(1, df.count())
    w = F.col(weight) if weight else F.lit(1.0)
    picked = df.filter(near).select(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias("_h"), w.alias("_w"), *[finite(F.col(c).cast("double")).alias(c) for c in cols]).orderBy("_h", *cols).limit(bound).toPandas()
    x, p = picked[list(cols)].to_numpy(float), picked["_w"].to_numpy(float)
    size = min(sample, len(x) if weight is None else int((p > 0).sum()))
    limit = max(1, math.ceil(math.log2(max(2, size))))
    shared = spark.sparkContext.broadcast((x, p / p.sum() if len(p) and p.sum() > 0 else None))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, chance = shared.value
        for batch in batches:
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                drawn = rng.choice(len(rows), size, replace=False, p=chance) if size else np.zeros(0, int)
                made = pd.DataFrame(_grow(rows[drawn], rng, limit), columns=["feature", "split", "left", "right", "size", "depth"])
                made.insert(0, "node", range(len(made)))
                made.insert(0, "tree", int(tree))
                yield made

    nodes = spark.range(0, trees, 1, min(trees, 32)).mapInPandas(grow, NODES).toPandas()
    return Forest(list(cols), max(size, 2), nodes)


def forest_from_rows(cols: Sequence[str], sample: int, rows: Sequence[tuple]) -> Forest:
    """A forest of given nodes ``(tree, node, feature, split, left, right, size, depth)``."""
    return Forest(list(cols), sample, pd.DataFrame(rows, columns=[c.split()[0] for c in NODES.split(", ")]))


def score_forest(df: DataFrame, forest: Forest, out: str = "score") -> DataFrame:
    """``df`` with the anomaly score; null and non-finite features count as 0."""

    @F.pandas_udf("double")
    def score(cols: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.scores(cols.to_numpy(float)))

    return df.withColumn(out, score(F.struct(*[finite(F.col(c).cast("double")).alias(c) for c in forest.cols])))


def flag(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return df.withColumn("anomaly", (F.col(score) >= threshold).cast("int"))


# Rule trees: a node is (feature, threshold, left, right), a leaf its prediction.


def tree_rules(tree, path: tuple = ()) -> list[tuple[tuple, float]]:
    """Leaves as (conditions, prediction) from left to right."""
    if not isinstance(tree, tuple):
        return [(path, float(tree))]
    name, cut, left, right = tree
    return tree_rules(left, (*path, (name, "<=", cut))) + tree_rules(right, (*path, (name, ">", cut)))


def explain(tree, last: int = 3) -> Column:
    """Text of the last conditions that lead to a row's leaf, joined by `` & ``; non-finite features count as 0."""
    out = None
    for path, _ in tree_rules(tree):
        if not path:
            return F.lit("")
        test = F.lit(True)
        for name, op, cut in path:
            test = test & (finite(F.col(name).cast("double")) <= cut if op == "<=" else finite(F.col(name).cast("double")) > cut)
        text = " & ".join(f"{name}{op}{cut:.1f}" for name, op, cut in path[-last:])
        out = F.when(test, text) if out is None else out.when(test, text)
    return out


def _assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    clean = df.withColumns({f"_x_{c}": finite(F.col(c).cast("double")) for c in cols})
    return VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol=out).transform(clean).drop(*[f"_x_{c}" for c in cols])


def _kept(df: DataFrame, cols: Sequence[str], what: str) -> DataFrame:
    """The named columns as a written table."""
    return staged(df.select(*dict.fromkeys(cols)), what)[0]


def fit_surrogate(df: DataFrame, cols: Sequence[str], label: str = "anomaly", depth: int = 4, weight: str | None = None):
    """A rule tree that imitates the detector's labels: ``(tree, importances by feature)``."""
    made = DecisionTreeClassifier(featuresCol="features", labelCol="_y", maxDepth=depth, seed=42, **({"weightCol": weight} if weight else {})).fit(
        _assembled(df, cols).withColumn("_y", F.col(label).cast("double"))
    )

    def read(node):
        if node.numDescendants() == 0:
            return node.prediction()
        s = node.split()
        return (cols[s.featureIndex()], s.threshold(), read(node.leftChild()), read(node.rightChild()))

    return read(made._java_obj.rootNode()), dict(zip(cols, made.featureImportances.toArray().tolist()))


def tree_value(tree) -> Column:
    """The prediction of a rule tree; null and non-finite features count as 0."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, cut, left, right = tree
    return F.when(finite(F.col(name).cast("double")) <= cut, tree_value(left)).otherwise(tree_value(right))


def surrogate_fidelity(df: DataFrame, cols: Sequence[str], id_col: str, label: str = "anomaly", depth: int = 4, cv: int = 5) -> DataFrame | None:
    """How well a rule tree repeats the detector's labels: one row of counts, rates, ``regime``, ``f1_cv_mean`` and ``f1_cv_std``.

    A stratified 30 % is held out where the rarer label has four rows or more, else the tree is judged on its own
    rows; the folds are left out (null) where it has fewer than ``cv``. None where there is one label only.
    """
    # Every fit and every judgement reads the rows, which may come from a long plan; so with their halves and folds.
    df = _kept(df, [*cols, label, id_col], "rows")
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(sizes) < 2:
        return None
    rarer = min(sizes.values())
    split = _kept(stratified_split(df, label, id_col), [*cols, label, "is_test"], "halves") if rarer >= 4 else None
    train, test = (split.filter("not is_test"), split.filter("is_test")) if split is not None else (df, df)
    tree, _ = fit_surrogate(train, cols, label, depth)
    out = detection_metrics(test.withColumn("_p", tree_value(tree)), label, "_p")
    f1 = []
    if rarer >= cv > 1:
        dealt = _kept(stratified_folds(df, label, id_col, cv), [*cols, label, "fold"], "folds")
        for fold in range(cv):
            one, _ = fit_surrogate(dealt.filter(F.col("fold") != fold), cols, label, depth)
            f1.append(detection_metrics(dealt.filter(F.col("fold") == fold).withColumn("_p", tree_value(one)), label, "_p").first()["f1"])
    mean, std = (float(np.mean(f1)), float(np.std(f1))) if f1 else (None, None)
    return out.withColumns(
        {"regime": F.lit("held_out" if split is not None else "in_sample"), "f1_cv_mean": F.lit(mean).cast("double"), "f1_cv_std": F.lit(std).cast("double")}
    )


@dataclass
class Linear:
    """A linear decision over scaled columns: sum(weight * (x - mean) / spread) + bias."""

    cols: list[str]
    weights: list[float]
    means: list[float]
    spreads: list[float]
    bias: float

    def decision(self) -> Column:
        out = F.lit(self.bias)
        for c, w, m, s in zip(self.cols, self.weights, self.means, self.spreads):
            out = out + F.lit(w) * ((finite(F.col(c).cast("double")) - m) / (s if s > 0 else 1.0))
        return out


def decide(df: DataFrame, model: Linear) -> DataFrame:
    """``df`` with ``decision_value``, ``margin`` and ``predicted`` (ataque above 0)."""
    return df.withColumn("decision_value", model.decision()).withColumns(
        {"margin": F.abs("decision_value"), "predicted": F.when(F.col("decision_value") > 0, "ataque").otherwise("benigno")}
    )


def fit_svm(df: DataFrame, cols: Sequence[str], label: str, c: float = 1.0) -> Linear:
    """Linear SVM on scaled columns with balanced class weights."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        raise ValueError("both classes are needed")
    stats = df.agg(*[F.avg(finite(F.col(k).cast("double"))).alias(f"m_{k}") for k in cols], *[F.stddev_pop(finite(F.col(k).cast("double"))).alias(f"s_{k}") for k in cols]).first()
    means, spreads = [stats[f"m_{k}"] for k in cols], [stats[f"s_{k}"] or 1.0 for k in cols]
    scaled = df.select(F.col(label).cast("double").alias("_y"), *[((finite(F.col(k).cast("double")) - m) / s).alias(k) for k, m, s in zip(cols, means, spreads)])
    weighed = _assembled(scaled, cols).withColumn("_w", F.when(F.col("_y") == 1, n / (2.0 * sizes[1])).otherwise(n / (2.0 * sizes[0])))
    made = LinearSVC(featuresCol="features", labelCol="_y", weightCol="_w", regParam=1.0 / (c * n), maxIter=100, standardization=False).fit(weighed)
    return Linear(list(cols), made.coefficients.toArray().tolist(), means, spreads, float(made.intercept))


def project(df: DataFrame, cols: Sequence[str], axes: Sequence[Sequence[float]], means: Sequence[float]) -> DataFrame:
    """``df`` with ``coord_x, coord_y, ...``: centred columns on given axes."""
    names = ["coord_x", "coord_y", *[f"coord_{i}" for i in range(2, len(axes))]]
    made = {}
    for name, axis in zip(names, axes):
        out = F.lit(0.0)
        for c, a, m in zip(cols, axis, means):
            out = out + F.lit(float(a)) * (finite(F.col(c).cast("double")) - float(m))
        made[name] = out
    return df.withColumns(made)


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> tuple[list[list[float]], list[float], list[float]]:
    """Axes, means and explained variance shares."""
    made = PCA(k=k, inputCol="features", outputCol="_p").fit(_assembled(df, cols))
    means = df.agg(*[F.avg(finite(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    return made.pc.toArray().T.tolist(), [means[c] for c in cols], made.explainedVariance.toArray().tolist()


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v := _assembled(df, cols)).transform(v).drop("features")


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    made = PolynomialExpansion(degree=degree, inputCol="features", outputCol="_p").transform(_assembled(df, cols))
    return made.withColumn("expanded", vector_to_array("_p")).drop("features", "_p")


def knn(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, id_col: str, k: int = 5) -> DataFrame:
    """``id, prediction``: the commonest label among the ``k`` nearest training rows by standardised columns, the least one where they tie.

    ``id_col`` is an integer, other in ``train`` and ``test``; the search is exact, over blocks of both sides. Equal rows
    are searched once: a vector of the training rows stands for its ``k`` least ids, and its finds hold for all its copies.
    """
    scaler = moments(train, cols)
    # Without negative zeros, which equal zeros but for their bits.
    vector = F.array(*[finite(F.col(c).cast("double")) + 0.0 for c in cols]).alias("vec")
    left, right = (standardised(d, scaler).select(F.col(id_col).cast("long").alias("own"), vector, F.col(label).alias("_y")) for d in (test, train))
    left, right = staged(left, "knn-test")[0], staged(right, "knn-train")[0]
    place = F.row_number().over(Window.partitionBy("vec").orderBy("own"))
    least = right.withColumn("_place", place).filter(F.col("_place") <= k)
    queries = staged(left.groupBy("vec").agg(F.min("own").alias("vec_id")), "knn-queries")[0]
    base = staged(least.groupBy("vec").agg(F.min("own").alias("vec_id"), F.collect_list(F.struct("own", "_y")).alias("held")), "knn-base")[0]
    near = nearest(queries, base, k)
    found = near.join(base.select(F.col("vec_id").alias("neighbour"), "held"), "neighbour").select("id", "distance", F.inline("held"))
    ranked = found.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("distance", "own"))).filter(F.col("_r") <= k)
    voted = vote(ranked, "_y")
    return left.join(queries, "vec").join(voted.withColumnRenamed("id", "vec_id"), "vec_id").select(F.col("own").alias("id"), "prediction")


def vote(near: DataFrame, label: str) -> DataFrame:
    """``id, prediction``: the commonest ``label`` of each ``id``, the least one where they tie."""
    counted = near.groupBy("id", F.col(label).alias("prediction")).agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.min_by("prediction", F.struct(-F.col("n"), "prediction")).alias("prediction"))


def bake_off(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, id_col: str | None = None) -> DataFrame:
    """``model, tp, fp, fn, tn`` of five Spark ML classifiers on held-out rows, and of k nearest neighbours where ``id_col`` is given."""
    kinds = {
        "random_forest": RandomForestClassifier(labelCol="_y", numTrees=20, seed=42), "decision_tree": DecisionTreeClassifier(labelCol="_y", seed=42),
        "logistic_regression": LogisticRegression(labelCol="_y"), "perceptron": MultilayerPerceptronClassifier(labelCol="_y", layers=[len(cols), 8, 2], maxIter=50, seed=42),
        "linear_svc": LinearSVC(labelCol="_y"),
    }
    # Every fit and every judgement reads the rows, which may come from a long plan.
    train, test = (_kept(d, [*cols, label, *([id_col] if id_col else [])], what) for d, what in ((train, "train"), (test, "test")))
    a, b = (_assembled(d, cols).withColumn("_y", F.col(label).cast("double")) for d in (train, test))
    judged = {name: kind.fit(a).transform(b) for name, kind in kinds.items()}
    if id_col:
        voted = knn(train, test, cols, label, id_col)
        judged["nearest_neighbours"] = b.join(voted.withColumnRenamed("id", "_id"), F.col(id_col) == F.col("_id"))
    out = None
    for name, p in judged.items():
        row = p.agg(*[F.count_if((F.col("_y") == y) & (F.col("prediction") == q)).alias(n) for n, y, q in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]).select(F.lit(name).alias("model"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def feature_sweep(train: DataFrame, test: DataFrame, cols: Sequence[str], label: str, counts: Sequence[int]) -> DataFrame:
    """``n_features, accuracy, f1`` of a decision tree on the most important columns, for each count."""
    train, test = _kept(train, [*cols, label], "train"), _kept(test, [*cols, label], "test")
    _, weights = fit_surrogate(train, cols, label, depth=5)
    ranked = sorted(cols, key=lambda c: (-weights[c], c))
    out = None
    for n in counts:
        tree, _ = fit_surrogate(train, ranked[:n], label, depth=5)
        row = detection_metrics(test.withColumn("_p", tree_value(tree)), label, "_p").select(F.lit(int(n)).alias("n_features"), "accuracy", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def ranked_importances(spark, importances: dict[str, float], top: int = 6) -> DataFrame:
    """``place, column, importance`` of the ``top`` columns that matter at all, ties by name."""
    kept = sorted(((v, c) for c, v in importances.items() if v > 0), key=lambda p: (-p[0], p[1]))[:top]
    return spark.createDataFrame([(i + 1, c, float(v)) for i, (v, c) in enumerate(kept)], "place int, column string, importance double")


def scaled(df: DataFrame, scaler: dict) -> DataFrame:
    """``df`` with finite columns, standardised by a bundle's ``scaler``."""
    return standardised(df.withColumns({c: finite(F.col(c).cast("double")) for c in scaler}), scaler)


def detect(df: DataFrame, cols: Sequence[str], id_col: str, contamination: float = 0.03, trees: int = 200, sample: int = 256, weight: str | None = None) -> tuple[DataFrame, dict]:
    """Scores, flags and a bundle: scaler, forest, threshold, surrogate tree and 1001-point grid, all frozen.

    With a ``weight``, all of them are weighted, and the threshold is the grid's value at ``1 - contamination``.
    """
    w = weight or "_one"
    clean = df.withColumns({c: finite(F.col(c).cast("double")) for c in cols}).withColumn("_one", F.lit(1.0))
    scaler = moments(clean, cols, weight)
    forest = fit_forest(standardised(clean, scaler), cols, id_col, trees, sample, weight=weight)
    # The grid, the threshold and the flags read the scores.
    scored, _ = staged(score_forest(standardised(clean, scaler), forest).select(id_col, "score", w), "scores")
    grid = [(r["pct"], r["score"]) for r in weighted_quantiles(scored, "score", w, id_col).orderBy("k").collect()]
    if weight:
        threshold = float(np.interp(1 - contamination, *zip(*grid))) if grid else None
    else:
        threshold = exact_quantiles(scored, "score", [1 - contamination]).first()["value"]
    raw = clean.join(scored.select(id_col, "score"), id_col)
    flagged = flag(raw, threshold)
    tree, importances = fit_surrogate(flagged, cols, weight=weight)
    bundle = {"forest": forest, "scaler": scaler, "threshold": threshold, "tree": tree, "importances": importances, "grid": grid, "cols": list(cols), "contamination": contamination}
    return flagged.drop("_one"), bundle

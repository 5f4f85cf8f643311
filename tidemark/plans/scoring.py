"""Queries over scores: quantiles, grids, percentiles, metrics, frozen and fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import flows, models, stats
from tidemark.plans.inputs import Registry, duck, flows_duck, r4, rounded, view
from tidemark.staging import staged

R = Registry()
KEY = ("src", "dst", "portA", "portB")


def _scored(spark, sf_dir):
    """Flows with a deterministic score, its weight and a tie breaker."""
    f = flows.flow_features(view(spark, sf_dir, "packets"))
    return f.select(*KEY, r4("n_bytes").alias("score"), F.col("n_packets").cast("double").alias("w"), F.concat_ws("|", *KEY).alias("id"))


SC = flows_duck(then=", sc AS (SELECT src, dst, portA, portB, round(n_bytes + 1e-7, 4) AS score, CAST(n_packets AS DOUBLE) AS w, src || '|' || dst || '|' || portA || '|' || portB AS id FROM flows)")


@R.add(SC + "SELECT q, round(v + 1e-7, 4) AS value FROM (SELECT unnest([0.05, 0.5, 0.95, 0.97]::DOUBLE[]) AS q, unnest(quantile_cont(score, [0.05, 0.5, 0.95, 0.97])) AS v FROM sc) t")
def score_quantiles(spark, sf_dir):
    return stats.exact_quantiles(_scored(spark, sf_dir), "score", [0.05, 0.5, 0.95, 0.97]).select("q", r4("value").alias("value"))


@R.add(SC + """SELECT round(quantile_cont(score, 0.5) + 1e-7, 4) AS p50, round(quantile_cont(score, 0.95) + 1e-7, 4) AS p95, round(max(score) + 1e-7, 4) AS top,
  round(avg(score) FILTER (WHERE w <= 5) + 1e-7, 4) AS mean_normal, round(avg(score) FILTER (WHERE w > 5) + 1e-7, 4) AS mean_anomaly,
  round((avg(score) FILTER (WHERE w > 5) - avg(score) FILTER (WHERE w <= 5)) / stddev_pop(score) FILTER (WHERE w <= 5) + 1e-7, 4) AS separation FROM sc""")
def score_diagnostics(spark, sf_dir):
    return rounded(stats.score_diagnostics(_scored(spark, sf_dir).withColumn("label", (F.col("w") > 5).cast("int")), "score", "label"))


GRID = SC + """, cdf AS (SELECT score AS v, (sum(w) OVER (ORDER BY score, id ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER () AS a, row_number() OVER (ORDER BY score, id) AS i FROM sc),
  seg AS (SELECT i, v, a, lead(v) OVER (ORDER BY i) AS v2, lead(a) OVER (ORDER BY i) AS a2, count(*) OVER () AS n FROM cdf),
  ks AS (SELECT range AS k, range / 1000.0::DOUBLE AS q FROM range(0, 1001)),
  grid AS (SELECT k, q AS pct, CASE WHEN q <= (SELECT a FROM cdf WHERE i = 1) THEN (SELECT v FROM cdf WHERE i = 1) WHEN q >= (SELECT max(a) FROM cdf) THEN (SELECT max(v) FROM cdf)
    ELSE (SELECT max(v + (v2 - v) * (q - a) / (a2 - a)) FROM seg WHERE seg.a <= q AND seg.a2 > q) END AS score FROM ks) """


@R.add(GRID + "SELECT k, pct, round(score + 1e-7, 4) AS score FROM grid")
def score_grid(spark, sf_dir):
    return stats.weighted_quantiles(_scored(spark, sf_dir), "score", "w", "id").select("k", "pct", r4("score").alias("score"))


@R.add(GRID + "SELECT pct AS q, round(score + 1e-7, 4) AS value FROM grid WHERE k IN (10, 500, 970, 990)")
def weighted_quantile(spark, sf_dir):
    return stats.weighted_quantiles(_scored(spark, sf_dir), "score", "w", "id").filter(F.col("k").isin(10, 500, 970, 990)).select(F.col("pct").alias("q"), r4("score").alias("value"))


#: A frozen grid with equal neighbours, as a model bundle would carry it.
FROZEN = [(i / 20, float(v)) for i, v in enumerate([0, 10, 20, 20, 20, 40, 60, 80, 100, 120, 150, 180, 210, 250, 300, 350, 400, 500, 600, 800, 1000])]
FROZEN_SQL = "(VALUES " + ", ".join(f"({i}, {p}::DOUBLE, {s}::DOUBLE)" for i, (p, s) in enumerate(FROZEN)) + ") AS g(i, p, x)"


@R.add(SC + f""", g AS (SELECT i, p, x, lead(p) OVER (ORDER BY i) AS p2, lead(x) OVER (ORDER BY i) AS x2 FROM {FROZEN_SQL})
  SELECT src, dst, portA, portB, round(CASE WHEN score < 0 THEN 0 WHEN score > 1000 THEN 1 ELSE (SELECT arg_max(CASE WHEN x2 IS NULL OR sc.score = x THEN p ELSE p + (sc.score - x) * (p2 - p) / (x2 - x) END, i) FROM g WHERE g.x <= sc.score) END + 1e-7, 4) AS percentile FROM sc""")
def percentile_lookup(spark, sf_dir):
    return rounded(stats.percentile_lookup(_scored(spark, sf_dir), "score", FROZEN).select(*KEY, "percentile"))


_CONF = "count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn"


@R.add(duck("judged", then=f""", c AS (SELECT {_CONF} FROM judged) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fn, 0), 0) + 1e-7, 4) AS recall, round(coalesce(tp / nullif(tp + fp, 0), 0) + 1e-7, 4) AS precisao,
  round(coalesce(fp / nullif(fp + tn, 0), 0) + 1e-7, 4) AS taxa_falso_positivo, round((tp + tn) / (tp + fp + fn + tn) + 1e-7, 4) AS accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + 1e-7, 4) AS f1 FROM c"""))
def detection_metrics(spark, sf_dir):
    return rounded(stats.detection_metrics(view(spark, sf_dir, "judged"), "label", "predicted"))


@R.add(duck("judged", then="""SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) + 1e-7, 4) AS roc_auc
  FROM judged a, judged b WHERE a.label = 1 AND b.label = 0"""))
def roc_auc(spark, sf_dir):
    return rounded(stats.roc_auc(view(spark, sf_dir, "judged"), "score", "label"))


@R.add(duck("judged", then=""", d AS (SELECT score, sum(label) AS pos, count(*) AS n FROM judged GROUP BY score), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM d WINDOW w AS (ORDER BY score DESC))
  SELECT round(sum(pos * tp / seen) / sum(pos) + 1e-7, 4) AS average_precision FROM c"""))
def average_precision(spark, sf_dir):
    return rounded(stats.average_precision(view(spark, sf_dir, "judged"), "score", "label"))


def _cut_flows(spark, sf_dir, tests):
    """Flows for comparisons ``(column, cut)``: their SQL adds doubles, which a single thread does in the order of time."""
    cuts: dict[str, set[float]] = {}
    for name, cut in tests:
        cuts.setdefault(name, set()).add(cut)
    packets = view(spark, sf_dir, "packets")
    return flows.summed_in_time(flows.flow_features(packets), packets, cuts, ("ts", "event_id"))


F_COLS = ["n_bytes", "n_packets", "mean_len"]
#: Two small frozen trees: (tree, node, feature, split, left, right, size, depth).
TREES = [
    (0, 0, 0, 300.0, 1, 2, 8, 0), (0, 1, -1, 0.0, -1, -1, 5, 1), (0, 2, 1, 6.0, 3, 4, 3, 1), (0, 3, -1, 0.0, -1, -1, 2, 2), (0, 4, -1, 0.0, -1, -1, 1, 2),
    (1, 0, 2, 40.0, 1, 2, 8, 0), (1, 1, -1, 0.0, -1, -1, 3, 1), (1, 2, -1, 0.0, -1, -1, 5, 1),
]
_C = models.path_constant


@R.add(flows_duck(then=f"""SELECT src, dst, portA, portB, round(pow(2, -((CASE WHEN n_bytes <= 300 THEN 1 + {_C(5)!r} WHEN n_packets <= 6 THEN 2 + {_C(2)!r} ELSE 2 END)
  + (CASE WHEN mean_len <= 40 THEN 1 + {_C(3)!r} ELSE 1 + {_C(5)!r} END)) / 2 / {_C(8)!r}) + 1e-7, 4) AS score FROM flows"""))
def iforest_score_frozen(spark, sf_dir):
    f = _cut_flows(spark, sf_dir, [(F_COLS[t[2]], t[3]) for t in TREES if t[2] >= 0])
    return rounded(models.score_forest(f, models.forest_from_rows(F_COLS, 8, TREES)).select(*KEY, "score"))


LINEAR = models.Linear(["n_bytes", "mean_iat", "syn_ratio"], [0.8, -0.3, 1.5], [300.0, 90000.0, 0.2], [250.0, 60000.0, 0.3], -0.1)


@R.add(flows_duck(then=""", d AS (SELECT src, dst, portA, portB, -0.1 + 0.8 * (n_bytes - 300) / 250 - 0.3 * (mean_iat - 90000) / 60000 + 1.5 * (syn_ratio - 0.2) / 0.3 AS v FROM flows)
  SELECT src, dst, portA, portB, round(v + 1e-7, 4) AS decision_value, round(abs(v) + 1e-7, 4) AS margin, CASE WHEN v > 0 THEN 'ataque' ELSE 'benigno' END AS predicted FROM d"""))
def svm_decision_frozen(spark, sf_dir):
    return rounded(models.decide(flows.flow_features(view(spark, sf_dir, "packets")), LINEAR).select(*KEY, "decision_value", "margin", "predicted"))


@R.add(flows_duck(then="SELECT src, dst, portA, portB, round(0.6 * (n_bytes - 300) + 0.8 * (mean_len - 50) + 1e-7, 4) AS coord_x, round(0.8 * (n_bytes - 300) - 0.6 * (mean_len - 50) + 1e-7, 4) AS coord_y FROM flows"))
def pca_project_frozen(spark, sf_dir):
    f = flows.flow_features(view(spark, sf_dir, "packets"))
    return rounded(models.project(f, ["n_bytes", "mean_len"], [[0.6, 0.8], [0.8, -0.6]], [300.0, 50.0]).select(*KEY, "coord_x", "coord_y"))


RULES = ("n_bytes", 300.0, ("syn_ratio", 0.25, 0, ("n_packets", 3.5, 0, ("mean_len", 40.0, 0, 1))), ("rst_ratio", 0.1, 1, 0))


@R.add(flows_duck(then="""SELECT src, dst, portA, portB, CASE WHEN n_bytes <= 300 THEN CASE WHEN syn_ratio <= 0.25 THEN 'n_bytes<=300.0 & syn_ratio<=0.2' WHEN n_packets <= 3.5 THEN 'n_bytes<=300.0 & syn_ratio>0.2 & n_packets<=3.5'
  WHEN mean_len <= 40 THEN 'syn_ratio>0.2 & n_packets>3.5 & mean_len<=40.0' ELSE 'syn_ratio>0.2 & n_packets>3.5 & mean_len>40.0' END
  WHEN rst_ratio <= 0.1 THEN 'n_bytes>300.0 & rst_ratio<=0.1' ELSE 'n_bytes>300.0 & rst_ratio>0.1' END AS rule FROM flows"""))
def explain_rule(spark, sf_dir):
    f = _cut_flows(spark, sf_dir, [(name, cut) for path, _ in models.tree_rules(RULES) for name, _, cut in path])
    return f.select(*KEY, models.explain(RULES).alias("rule"))


D_COLS = ["n_packets", "n_bytes", "duration", "mean_len", "std_len", "mean_iat", "syn_ratio", "ack_ratio", "rst_ratio"]


def _flows_with_id(spark, sf_dir):
    return flows.flow_features(view(spark, sf_dir, "packets")).withColumn("id", F.concat_ws("|", *KEY))


@R.add()
def iforest_fit_score(spark, sf_dir):
    """Forest, threshold and flags fitted on the flows."""
    f = _flows_with_id(spark, sf_dir)
    scaled = stats.zscore(f, D_COLS)
    scored = models.score_forest(scaled, models.fit_forest(scaled, D_COLS, "id"))
    threshold = stats.exact_quantiles(scored, "score", [0.97]).first()["value"]
    return models.flag(scored.select(*KEY, "score"), threshold)


@R.add()
def surrogate_fit(spark, sf_dir):
    """Leaves of a rule tree that imitates a flag."""
    f = _flows_with_id(spark, sf_dir).withColumn("anomaly", (F.col("n_bytes") > 600).cast("int"))
    tree, _ = models.fit_surrogate(f, D_COLS)
    rows = [(" & ".join(f"{n}{op}{c:.1f}" for n, op, c in path[-3:]), p) for path, p in models.tree_rules(tree)]
    return spark.createDataFrame(rows, "rule string, prediction double")


@R.add()
def svm_fit(spark, sf_dir):
    f = _flows_with_id(spark, sf_dir).withColumn("label", (F.col("n_bytes") > 400).cast("int"))
    return models.decide(f, models.fit_svm(f, D_COLS, "label")).select(*KEY, "decision_value", "margin", "predicted")


@R.add()
def pca_fit(spark, sf_dir):
    f = _flows_with_id(spark, sf_dir)
    axes, means, _ = models.fit_pca(f, D_COLS)
    return models.project(f, D_COLS, axes, means).select(*KEY, "coord_x", "coord_y")


@R.add()
def kmeans_fit(spark, sf_dir):
    return models.kmeans(_flows_with_id(spark, sf_dir), D_COLS).select(*KEY, "cluster")


@R.add()
def classifier_bake_off(spark, sf_dir):
    f = _flows_with_id(spark, sf_dir).withColumns({"label": (F.col("n_bytes") > 400).cast("int"), "fold": F.pmod(F.xxhash64("id"), F.lit(10)), "number": F.xxhash64("id")})
    # Both halves read the flows, which are made, and their packets dealt, once.
    f, _ = staged(f.select(*D_COLS, "label", "fold", "number"), "flows")
    return models.bake_off(f.filter("fold < 7"), f.filter("fold >= 7"), D_COLS, "label", "number")

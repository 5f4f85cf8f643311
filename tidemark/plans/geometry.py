"""Queries over distances and axes: density clusters, principal axes, kernel models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import density, subspace
from tidemark.plans.inputs import Registry, r4, rounded, view

R = Registry()
EPS, LEAST = 0.25, 8


@R.add(f"""WITH RECURSIVE pts AS MATERIALIZED (SELECT event_id AS id, value / 50e0 AS x, epoch_us(ts) / 8.64e10 - 19000e0 AS y FROM events),
  near AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM pts a JOIN pts b ON b.x BETWEEN a.x - {EPS} AND a.x + {EPS} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {EPS * EPS}),
  core AS MATERIALIZED (SELECT i AS id FROM near GROUP BY i HAVING count(*) >= {LEAST}),
  edges AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core) AND i <> j),
  reached(id, root) USING KEY (id) AS (
    SELECT id, id FROM core
    UNION
    (SELECT e.j, min(c.root) FROM reached c JOIN edges e ON e.i = c.id JOIN recurring.reached k ON k.id = e.j WHERE c.root < k.root GROUP BY e.j))
  SELECT p.id AS event_id, c.id IS NOT NULL AS core, coalesce(c.root, (SELECT min(o.root) FROM near n JOIN reached o ON o.id = n.j WHERE n.i = p.id)) AS cluster
  FROM pts p LEFT JOIN reached c ON c.id = p.id""")
def dbscan_events(spark, sf_dir):
    """Density clusters of all events by value and time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    points = view(spark, sf_dir, "events").select("event_id", (F.col("value") / 50.0).alias("x"), (micros / 8.64e10 - 19000.0).alias("y"))
    return density.dbscan(points, ["x", "y"], "event_id", EPS, LEAST)


_M = """m AS (SELECT var_pop(l_quantity) AS a, var_pop(l_extendedprice / 1e3) AS c, covar_pop(l_quantity, l_extendedprice / 1e3) AS b FROM lineitem),
  e AS (SELECT a, b, c, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS big, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS small FROM m)"""


def _axes(spark, sf_dir):
    two = view(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / 1e3).alias("price"))
    return subspace.fit_axes(two, ["quantity", "price"], 0.95, scale=False)


@R.add(f"""WITH {_M} SELECT 1 AS component, round(big / (a + c) + 1e-7, 4) AS share, round(big / (a + c) + 1e-7, 4) AS cumulative, true AS kept FROM e
  UNION ALL SELECT 2, round(small / (a + c) + 1e-7, 4), 1.0, big / (a + c) <= 0.95 FROM e""")
def pca_shares(spark, sf_dir):
    return rounded(subspace.axis_shares(spark, _axes(spark, sf_dir)))


@R.add(f"""WITH {_M}, v AS (SELECT 1 AS component, b AS q, big - a AS p FROM e UNION ALL SELECT 2, b, small - a FROM e),
  u AS (SELECT component, q / sqrt(q * q + p * p) AS q, p / sqrt(q * q + p * p) AS p FROM v),
  s AS (SELECT component, CASE WHEN abs(q) >= abs(p) THEN sign(q) ELSE sign(p) END AS side, q, p FROM u)
  SELECT component, 'quantity' AS "column", round(q * side + 1e-7, 4) AS loading, CASE WHEN abs(q) >= abs(p) THEN 1 ELSE 2 END AS place FROM s
  UNION ALL SELECT component, 'price', round(p * side + 1e-7, 4), CASE WHEN abs(q) >= abs(p) THEN 2 ELSE 1 END FROM s""")
def pca_loadings(spark, sf_dir):
    return rounded(subspace.axis_loadings(spark, _axes(spark, sf_dir)))


_L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@R.add()
def pca_coordinates(spark, sf_dir):
    """Rows on as many axes of four standardised columns as hold 95 % of the variance."""
    rows = view(spark, sf_dir, "lineitem")
    placed = subspace.on_axes(rows, subspace.fit_axes(rows, _L))
    return placed.select("l_orderkey", "l_linenumber", *[c for c in placed.columns if c.startswith("coord_")])


FROZEN = subspace.KernelModel(
    subspace.Features(("l_quantity", "l_discount"), (25.0, 0.05), (14.0, 0.03), waves=(((0.5, -1.0), 0.25), ((1.5, 0.75), 2.0), ((-0.25, 0.5), 4.0))), (0.5, -0.25, 1.0), 0.125
)


@R.add("""SELECT l_orderkey, l_linenumber, round(0.125 + sqrt(2e0 / 3) * (0.5 * cos(0.5 * x - y + 0.25) - 0.25 * cos(1.5 * x + 0.75 * y + 2) + cos(-0.25 * x + 0.5 * y + 4)) + 1e-7, 4) AS value
  FROM (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 14e0 AS x, (l_discount - 0.05) / 0.03e0 AS y FROM lineitem)""")
def kernel_value_frozen(spark, sf_dir):
    return view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r4(FROZEN.value()).alias("value"))


@R.add()
def kernel_ridge_fit(spark, sf_dir):
    """Extended prices from quantity, discount and tax by ridge on Gaussian features."""
    rows = view(spark, sf_dir, "lineitem")
    model = subspace.kernel_ridge(rows, subspace.gaussian_features(rows, ["l_quantity", "l_discount", "l_tax"], count=64), "l_extendedprice", alpha=1.0)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", model.value().alias("predicted"))


@R.add()
def kernel_svm_fit(spark, sf_dir):
    """Toxic documents by their length and quality label, with a polynomial kernel of degree three."""
    rows = view(spark, sf_dir, "documents").select("doc_id", "n_chars").join(view(spark, sf_dir, "labels"), "doc_id")
    model = subspace.kernel_svm(rows, subspace.polynomial_kernel_features(rows, ["n_chars", "quality"]), "toxic")
    return rows.select("doc_id", "toxic", (model.value() > 0).cast("int").alias("predicted"))

"""Exploratory queries: correlation, summaries, encodings, importance, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import explore, models
from tidemark.plans.inputs import Registry, r4, rounded, view

R = Registry()
_N = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@R.add(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) + 1e-7, 4) AS r FROM lineitem" for i, a in enumerate(_N) for b in _N[i + 1 :]))
def pearson_corr(spark, sf_dir):
    return rounded(explore.pearson(view(spark, sf_dir, "lineitem"), _N))


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}) + 1e-7, 4) AS mean, round(stddev_samp({c}) + 1e-7, 4) AS std, round(min({c}) + 1e-7, 4) AS lowest, round(max({c}) + 1e-7, 4) AS highest FROM lineitem" for c in _N))
def describe(spark, sf_dir):
    return rounded(explore.describe(view(spark, sf_dir, "lineitem"), _N))


@R.add("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return explore.value_counts(view(spark, sf_dir, "events"), "event_type")


_VAR = "SELECT p_brand AS brand, p_type AS kind, round(avg(p_retailprice) + 1e-7, 4) AS score, min(p_partkey) AS tie FROM part GROUP BY 1, 2"


def _variants(spark, sf_dir):
    return view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind")).agg(r4(F.avg("p_retailprice")).alias("score"), F.min("p_partkey").alias("tie"))


@R.add(f"SELECT brand, kind, score, tie FROM ({_VAR}) v QUALIFY row_number() OVER (PARTITION BY brand ORDER BY score DESC, tie) = 1")
def best_variant(spark, sf_dir):
    return explore.best_variant(_variants(spark, sf_dir), "brand", "score", "tie")


@R.add(f"SELECT brand, kind, metric, value FROM (SELECT brand, kind, score, CAST(tie AS DOUBLE) AS tie FROM ({_VAR}) a) v UNPIVOT (value FOR metric IN (score, tie))")
def melt_metrics(spark, sf_dir):
    return explore.melt(_variants(spark, sf_dir).withColumn("tie", F.col("tie").cast("double")), ["brand", "kind"], ["score", "tie"])


@R.add("""WITH f AS (SELECT p_brand AS name, count(*) AS w FROM part GROUP BY 1), c AS (SELECT sum(w) OVER (ORDER BY w DESC, name ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS c FROM f)
  SELECT t AS threshold, (SELECT count(*) FROM c WHERE c <= t + 1e-12) + 1 AS n_features FROM (SELECT unnest([0.5, 0.8, 0.95]::DOUBLE[]) AS t) s""")
def cumulative_importance(spark, sf_dir):
    f = view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("w"))
    return explore.cumulative_importance(f, "w", "name", [0.5, 0.8, 0.95])


@R.add("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events")
def label_encode(spark, sf_dir):
    return explore.label_encode(view(spark, sf_dir, "events"), "event_type").select("event_id", "code")


@R.add("WITH f AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS code FROM events GROUP BY 1) SELECT e.event_id, CAST(f.code AS INT) AS code FROM events e JOIN f USING (event_type)")
def factorize(spark, sf_dir):
    return explore.factorize(view(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "code")


_NAMES = ["normal", "neptune", "ipsweep", "ftp_write", "rootkit", "smurf", "nmap", "spy", "perl"]


@R.add("""SELECT label, CASE WHEN label = 'normal' THEN 'normal' WHEN label IN ('neptune', 'smurf') THEN 'dos' WHEN label IN ('ipsweep', 'nmap') THEN 'probe' WHEN label IN ('ftp_write', 'spy') THEN 'r2l' ELSE 'u2r' END AS family,
  CAST(label <> 'normal' AS INT) AS target, count(*) AS n FROM (SELECT ['normal', 'neptune', 'ipsweep', 'ftp_write', 'rootkit', 'smurf', 'nmap', 'spy', 'perl'][1 + CAST(event_id % 9 AS INT)] AS label FROM events) t GROUP BY ALL""")
def attack_family(spark, sf_dir):
    label = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % 9).cast("int"))
    rows = view(spark, sf_dir, "events").select(label.alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", scalars.attack_family(F.col("label")).alias("family"), (F.col("label") != "normal").cast("int").alias("target"), "n")


@R.add("SELECT value, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(value), ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))), lambda a, d: (a * 16 + d) % 100000000) AS code FROM (SELECT DISTINCT props AS value FROM events) t")
def hash_encode(spark, sf_dir):
    return view(spark, sf_dir, "events").select(F.col("props").alias("value")).distinct().select("value", scalars.hash_code(F.col("value")).alias("code"))


@R.add("SELECT p_partkey, trim(replace(' ' || p_name || '. ', '.', '')) AS clean FROM part")
def string_clean(spark, sf_dir):
    return view(spark, sf_dir, "part").select("p_partkey", scalars.clean_label(F.concat(F.lit(" "), "p_name", F.lit(". "))).alias("clean"))


@R.add("""WITH r AS (SELECT toxic, row_number() OVER (PARTITION BY toxic ORDER BY doc_id % 2147483648 * 2654435761 % 4294967296, doc_id) AS place, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
  SELECT toxic, place <= (n * 30 + 50) // 100 AS is_test, count(*) AS n FROM r GROUP BY 1, 2""")
def stratified_split(spark, sf_dir):
    return explore.stratified_split(view(spark, sf_dir, "labels"), "toxic", "doc_id").groupBy("toxic", "is_test").agg(F.count("*").alias("n"))


@R.add("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
  SELECT q.vec_id AS id, b.vec_id AS neighbour, round(list_distance(q.v, b.v) + 1e-7, 4) AS distance FROM q JOIN b ON q.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) <= 5""")
def nearest_neighbours(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    return rounded(explore.nearest(e.filter("vec_id % 100 = 0"), e, 5, "embedding", "vec_id").select("id", "neighbour", "distance"))


@R.add("SELECT p_partkey, round(p_size + 1e-7, 4) AS size, round(p_size * p_size + 1e-7, 4) AS size_size, round(p_retailprice + 1e-7, 4) AS price, round(p_size * p_retailprice + 1e-7, 4) AS size_price, round(p_retailprice * p_retailprice + 1e-7, 4) AS price_price FROM part")
def polynomial_features(spark, sf_dir):
    """All five terms of degree two and less."""
    made = models.polynomial(view(spark, sf_dir, "part"), ["p_size", "p_retailprice"])
    return rounded(made.select("p_partkey", *[F.get("expanded", F.lit(i)).alias(n) for i, n in enumerate(("size", "size_size", "price", "size_price", "price_price"))]))


@R.add(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", q, round(v + 1e-7, 4) AS value FROM (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q, unnest(quantile_cont({c}, [0.25, 0.5, 0.75])) AS v FROM lineitem) t" for c in _N))
def describe_quartiles(spark, sf_dir):
    return rounded(explore.quartiles(view(spark, sf_dir, "lineitem"), _N))


@R.add("SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_part(spark, sf_dir):
    return explore.numeric_columns(view(spark, sf_dir, "part"))


@R.add("SELECT doc_id, CAST(quality * 0.4 + toxic * 0.3 > 0.5 AS INT) AS predicted FROM labels")
def binarised(spark, sf_dir):
    made = view(spark, sf_dir, "labels").withColumn("p", F.col("quality") * 0.4 + F.col("toxic") * 0.3)
    return explore.binarise(made, "p", "predicted").select("doc_id", "predicted")

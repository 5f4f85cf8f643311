"""Queries of the lifecycle commands: candidates, golden captures, verdicts, requests, adoption, stage-2 predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.functions import scalars
from tidemark.operators import commands as C
from tidemark.operators import cycle, explore, labels, models
from tidemark.operators import lifecycle as L
from tidemark.plans.inputs import NOW, Registry, duck, rounded, view
from tidemark.plans.lifecycle import CUR, POOL
from tidemark.plans.scoring import D_COLS
from tidemark.plans.traffic import SCHEDULE, SCHEDULE_SQL
from tidemark.sources.packets import read_headed_csv
from tidemark.staging import forget, fresh_path

R = Registry()


@R.add(duck("windows", then="""SELECT visao, sum((pool_state = 'active')::BIGINT)::BIGINT AS n_active, sum((pool_state = 'evicted')::BIGINT)::BIGINT AS n_evicted,
  coalesce(sum(n_rows) FILTER (WHERE pool_state = 'active'), 0)::BIGINT AS rows_active FROM windows GROUP BY 1"""))
def pool_totals(spark, sf_dir):
    return C.pool_totals(view(spark, sf_dir, "windows"))


def _chosen(spark, sf_dir):
    return C.candidate_windows(view(spark, sf_dir, "windows"), "flow", NOW, 0.3)


@R.add(duck("windows", then=POOL + """, kept AS (SELECT window_id, t_end, feature_set, peso_recencia / (SELECT max(peso_recencia) FROM pool WHERE visao = 'flow') AS weight FROM pool WHERE visao = 'flow')
  SELECT window_id, 11 AS model_id, round(weight + 1e-7, 4) AS weight FROM kept WHERE weight >= 0.3
    AND feature_set = (SELECT feature_set FROM kept WHERE weight >= 0.3 ORDER BY t_end DESC, window_id DESC LIMIT 1)"""))
def candidate_provenance(spark, sf_dir):
    empty = view(spark, sf_dir, "judged").limit(0)
    return rounded(C.candidate_rows(11, 1, "flow", NOW, _chosen(spark, sf_dir), empty)[1])


@R.add()
def candidate_detector(spark, sf_dir):
    """Threshold, leaves of the rule tree and grid ends of a detector trained on weighted windows of flows."""
    p = view(spark, sf_dir, "packets")
    rows = p.select(
        F.concat_ws("-", F.floor(F.col("ts") / 780).cast("string"), "sensor").alias("window_id"), "event_id", F.col("length").cast("double").alias("length"),
        scalars.flag_count(F.col("flags"), "S").cast("double").alias("syn"), F.pmod("ts", F.lit(3600)).alias("second"),
    )
    b = C.train_candidate(rows, _chosen(spark, sf_dir), ["length", "syn", "second"], "event_id", 20_000)
    return spark.createDataFrame([(b["threshold"], len(models.tree_rules(b["tree"])), b["grid"][0][1], b["grid"][-1][1])], "threshold double, leaves int, lowest double, highest double")


@R.add(duck("packets", then=SCHEDULE_SQL + """, hit AS (SELECT p.event_id, min(s.pos) AS pos FROM packets p JOIN sched s ON p.ts >= s.start AND p.ts <= s.stop
    AND (list_has_all(s.att, [p.src]) AND (s.vic = [] OR list_has_all(s.vic, [p.dst])) OR list_has_all(s.att, [p.dst]) AND (s.vic = [] OR list_has_all(s.vic, [p.src]))) GROUP BY 1)
  SELECT coalesce(s.name, 'limpo') AS scenario, 'day-' || coalesce(s.name, 'limpo') AS capture, CAST(s.name IS NOT NULL AS INT) AS label, count(*) AS n_rows
  FROM packets p LEFT JOIN hit USING (event_id) LEFT JOIN sched s ON s.pos = hit.pos GROUP BY ALL"""))
def golden_build(spark, sf_dir):
    made = C.golden_captures(view(spark, sf_dir, "packets"), labels.compile_schedule(spark, SCHEDULE), "day", "ts")
    return made.groupBy("scenario", "capture", "label").agg(F.count("*").alias("n_rows"))


@R.add(duck("alerts", "verdicts", then=CUR + """SELECT 1000000 + a.alert_id AS verdict_id, a.alert_id, 'benigno' AS veredito, round(a.score + 1e-7, 4) AS score, round(a.percentile + 1e-7, 4) AS percentile, c.verdict_id AS supersedes
  FROM alerts a LEFT JOIN cur c ON c.alert_id = a.alert_id WHERE a.alert_id % 4 = 1"""))
def verdict_append(spark, sf_dir):
    a, v = view(spark, sf_dir, "alerts"), view(spark, sf_dir, "verdicts")
    unknown = spark.sql("SELECT -1L AS alert_id")
    given = a.filter("alert_id % 4 = 1").select("alert_id").unionByName(unknown).select(
        (F.lit(1000000) + F.col("alert_id")).alias("verdict_id"), "alert_id", F.lit("benigno").alias("veredito"), F.lit("x").alias("classe"), F.lit("a1").alias("analista")
    )
    return rounded(C.add_verdicts(v, a, given).select("verdict_id", "alert_id", "veredito", "score", "percentile", "supersedes"))


@R.add(duck("requests", then="""SELECT request_id, CASE WHEN request_id = (SELECT arg_min(request_id, (requested_at, request_id)) FROM requests WHERE state = 'pending') THEN 'failed' ELSE state END AS state,
  CASE WHEN request_id = (SELECT arg_min(request_id, (requested_at, request_id)) FROM requests WHERE state = 'pending') THEN 'empty pool' END AS erro FROM requests"""))
def request_states(spark, sf_dir):
    """A request is picked, runs and fails."""
    running = C.start_request(view(spark, sf_dir, "requests"), NOW)
    return C.finish_request(running, NOW + 60, "empty pool").select("request_id", "state", "erro")


@R.add(duck("models", then="SELECT model_id, CASE model_id WHEN 3 THEN 'retired' ELSE status END AS status FROM models UNION ALL SELECT 900, 'promoted'"))
def adopt_model(spark, sf_dir):
    made = spark.sql("SELECT 900 AS model_id, 2 AS stage, 'linear_svm' AS kind, CAST(NULL AS STRING) AS visao, 'candidate' AS status, 400 AS trained_at")
    return C.adopt(view(spark, sf_dir, "models"), made, "ana")[0].select("model_id", "status")


@R.add(duck("models", then="SELECT 900 AS candidate_model_id, (SELECT max(model_id) FROM models WHERE stage = 2 AND status = 'promoted' AND kind <> 'decision_tree_surrogate') AS incumbent_model_id, 'adotado' AS decisao, 'ana' AS decided_by"))
def adopt_decision(spark, sf_dir):
    made = spark.sql("SELECT 900 AS model_id, 2 AS stage, 'linear_svm' AS kind, CAST(NULL AS STRING) AS visao, 'candidate' AS status, 400 AS trained_at")
    return C.adopt(view(spark, sf_dir, "models"), made, "ana")[1]


@R.add(duck("windows", "provenance", then="SELECT window_id, model_id, weight FROM provenance WHERE window_id IN (SELECT window_id FROM windows WHERE bucket % 11 <> 0)"))
def reconcile_provenance(spark, sf_dir):
    w = view(spark, sf_dir, "windows")
    return C.reconcile(w, view(spark, sf_dir, "provenance"), w.filter("bucket % 11 <> 0").select("path"))[1].select("window_id", "model_id", "weight")


_STAGE2 = models.Linear(["score", "proto", "gone"], [1.2, 0.5, 2.0], [0.4, 5.0, 0.1], [0.25, 2.0, 1.0], -0.2)


@R.add(duck("alerts", "assignments", then=""", x AS (SELECT alert_id, -0.2 + 1.2 * (score - 0.4) / 0.25 + 0.5 * (proto - 5) / 2 + 2.0 * (0 - 0.1) AS d, 0.6 * (score - 0.4) + 0.8 * (proto - 5) AS cx, score - 0.4 AS cy
    FROM alerts ANTI JOIN (SELECT DISTINCT alert_id FROM assignments WHERE model_id = 2) done USING (alert_id))
  SELECT 5000000 + alert_id AS assignment_id, alert_id, round(d + 1e-7, 4) AS decision_value, round(abs(d) + 1e-7, 4) AS margin, CASE WHEN d > 0 THEN 'ataque' ELSE 'benigno' END AS predicted,
    'pending' AS state, round(cx + 1e-7, 4) AS coord_x, round(cy + 1e-7, 4) AS coord_y FROM x"""))
def stage2_predict(spark, sf_dir):
    a = L.with_feature_json(view(spark, sf_dir, "alerts"), ["score", "proto"])
    made = C.predict_stage2(a, view(spark, sf_dir, "assignments"), 2, _STAGE2, [[0.6, 0.8, 0.0], [1.0, 0.0, 0.0]], 5_000_000, NOW)
    return rounded(made.select("assignment_id", "alert_id", "decision_value", "margin", "predicted", "state", "coord_x", "coord_y"))


@R.add(duck("alerts", "assignments", then="SELECT alert_id FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM assignments WHERE model_id = 1) ORDER BY ts DESC, alert_id LIMIT 25"))
def unscored_newest(spark, sf_dir):
    return L.unscored_alerts(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "assignments"), 1, 25).select("alert_id")


@R.add("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  near AS (SELECT q.vec_id AS id, b.label FROM q JOIN b ON q.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, b.v), b.vec_id) <= 7),
  votes AS (SELECT id, label, count(*) AS n FROM near GROUP BY 1, 2) SELECT id, label AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1""")
def knn_vote(spark, sf_dir):
    e = view(spark, sf_dir, "embeddings")
    near = explore.nearest(e.filter("vec_id % 100 = 0"), e, 7, "embedding", "vec_id")
    return models.vote(near.join(e.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour"), "label")


@R.add("""WITH h AS (SELECT value, md5(value) AS m FROM (SELECT DISTINCT props AS value FROM events) t)
  SELECT value, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(m[1:6], ''), lambda d: CAST(instr('0123456789abcdef', d) - 1 AS BIGINT))), lambda a, d: a * 16 + d) AS head FROM h""")
def hash_encode_md5(spark, sf_dir):
    """The leading 24 bits of the MD5 number, which is a rounded double."""
    number = scalars.md5_number(F.col("value")) / F.lit(2.0**104)
    return view(spark, sf_dir, "events").select(F.col("props").alias("value")).distinct().select("value", F.floor(number).cast("long").alias("head"))


@R.add()
def surrogate_fidelity(spark, sf_dir):
    f = view(spark, sf_dir, "packets").withColumn("anomaly", ((F.col("length") > 60) & (F.col("flags") == "S")).cast("int"))
    f = f.withColumn("syn", scalars.flag_count(F.col("flags"), "S"))
    return models.surrogate_fidelity(f, ["length", "syn", "user_id"], "event_id")


def _split(spark, sf_dir):
    from tidemark.operators.flows import flow_features

    f = flow_features(view(spark, sf_dir, "packets")).withColumn("label", (F.col("n_bytes") > 400).cast("int"))
    return explore.stratified_split(f.withColumn("id", F.xxhash64("src", "dst", "portA", "portB")), "label", "id")


@R.add()
def feature_sweep(spark, sf_dir):
    f = _split(spark, sf_dir)
    return models.feature_sweep(f.filter("not is_test"), f.filter("is_test"), D_COLS, "label", [1, 3, 5, 9])


CYCLE_COLS = ["length", "syn", "second"]


def _live_store(spark, stage, kind):
    """A store with one model in production."""
    store = cycle.Store(spark, fresh_path(spark, "store"))
    store.commit({"models": spark.createDataFrame([(1, stage, kind, "flow", "promoted", 1.0, 2.0, None, "gone")], cycle.SCHEMAS["models"])})
    return store


def _packets_with_features(spark, sf_dir):
    p = view(spark, sf_dir, "packets")
    return p.select(
        F.concat_ws("-", F.floor(F.col("ts") / 780).cast("string"), "sensor").alias("window_id"), "event_id", "ts", "src", "dst", "sensor", F.col("length").cast("double").alias("length"),
        scalars.flag_count(F.col("flags"), "S").cast("double").alias("syn"), F.pmod("ts", F.lit(3600)).alias("second"),
    )


def _golden(spark, sf_dir):
    return C.golden_captures(_packets_with_features(spark, sf_dir), labels.compile_schedule(spark, SCHEDULE), "day", "ts")


_GOLDEN = SCHEDULE_SQL + """, golden AS (SELECT p.event_id, coalesce((SELECT min_by(s.name, s.pos) FROM sched s WHERE p.ts BETWEEN s.start AND s.stop
    AND ((list_contains(s.att, p.src) AND (len(s.vic) = 0 OR list_contains(s.vic, p.dst))) OR (list_contains(s.att, p.dst) AND (len(s.vic) = 0 OR list_contains(s.vic, p.src))))), 'limpo') AS scenario FROM packets p)"""


@R.add(duck("windows", "packets", then=POOL + ", chosen AS (SELECT window_id, peso_recencia / (SELECT max(peso_recencia) FROM pool WHERE visao = 'flow') AS weight, t_end, feature_set FROM pool WHERE visao = 'flow')" + _GOLDEN + """,
  used AS (SELECT count(*) AS n FROM chosen WHERE weight >= 0.3 AND feature_set = (SELECT feature_set FROM chosen WHERE weight >= 0.3 ORDER BY t_end DESC, window_id DESC LIMIT 1))
  SELECT 1::BIGINT AS candidate_model_id, NULL::BIGINT AS incumbent_model_id, 'candidate' AS status, scenario, scenario = 'limpo' AS obrigatorio, CASE WHEN scenario <> 'limpo' THEN 0.0::DOUBLE END AS recall_minimo,
    count(*) AS n, count(*) FILTER (WHERE scenario <> 'limpo') AS n_ataque_real, (SELECT n FROM used) AS n_windows, (SELECT count(DISTINCT scenario) FROM golden) AS cenarios_avaliados FROM golden GROUP BY scenario"""))
def candidate_to_gate(spark, sf_dir):
    """A candidate from the pool up to its gate rows, out of a store: what the tables say about it."""
    store = cycle.Store(spark, fresh_path(spark, "store"))
    golden = _golden(spark, sf_dir)
    floors = golden.select("scenario").distinct().select(F.lit(1).alias("stage"), "scenario", F.when(F.col("scenario") != "limpo", 0.0).alias("recall_minimo"), (F.col("scenario") == "limpo").alias("obrigatorio"))
    model_id, check, verdict = cycle.make_candidate(store, _packets_with_features(spark, sf_dir), view(spark, sf_dir, "windows"), golden, floors, CYCLE_COLS, "event_id", "flow", NOW, 0.3, 20_000, trees=25)
    evaluated = store.read("evaluations").filter("scope = 'scenario'").select(F.col("model_id").alias("candidate_model_id"), "scenario", "n", "n_ataque_real")
    status = store.read("models").select(F.col("model_id").alias("candidate_model_id"), "status")
    used = store.read("provenance").groupBy(F.col("model_id").alias("candidate_model_id")).agg(F.count("*").alias("n_windows"))
    rows = check.join(evaluated, ["candidate_model_id", "scenario"]).join(status, "candidate_model_id").join(used, "candidate_model_id").join(verdict.select("candidate_model_id", "cenarios_avaliados"), "candidate_model_id")
    return rows.select("candidate_model_id", "incumbent_model_id", "status", "scenario", "obrigatorio", "recall_minimo", "n", "n_ataque_real", "n_windows", "cenarios_avaliados")


@R.add(duck("packets", then=_GOLDEN + """, w AS (SELECT count(*) AS n FROM (SELECT DISTINCT floor(ts / 86400), sensor FROM packets))
  SELECT * FROM (SELECT 'grid points' AS what, 1001::BIGINT AS n UNION ALL SELECT 'models promoted', 1 UNION ALL SELECT 'models retired', 1 UNION ALL SELECT 'decisions adotado', 1 UNION ALL SELECT 'windows', n FROM w
  UNION ALL SELECT 'window rows', (SELECT count(*) FROM packets) UNION ALL SELECT 'provenance', n FROM w UNION ALL SELECT 'evaluations', (1 + 2 * (SELECT count(DISTINCT scenario) FROM golden))
  UNION ALL SELECT 'golden rows', (SELECT count(*) FROM golden) UNION ALL SELECT 'golden attacks', (SELECT count(*) FROM golden WHERE scenario <> 'limpo')) t"""))
def adopted_model(spark, sf_dir):
    """A detector adopted in place of a live one: grid, seeded pool, evaluations, decision and retirement, as counts."""
    store = _live_store(spark, 1, "isolation_forest")
    rows = _packets_with_features(spark, sf_dir).withColumn("t0", F.col("ts"))
    golden = _golden(spark, sf_dir)
    bundle = models.detect(rows, CYCLE_COLS, "event_id", 0.03, 10)[1]
    model_id = cycle.adopt_bundle(store, bundle, rows, golden, CYCLE_COLS, "event_id", "flow", "ana", NOW, seconds=86400)
    place = store.read("models").filter(F.col("model_id") == model_id).first()["artifact_path"]
    grid = len(sinks.read_bundle(spark, place)["grid"])
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    total = lambda c, what: store.read("evaluations").filter((F.col("scope") == "aggregate") & (F.col("model_id") == model_id)).select(F.lit(what).alias("what"), F.col(c).alias("n"))
    out = spark.createDataFrame([("grid points", grid)], "what string, n long")
    for part in (
        count(store.read("models").filter("status = 'promoted'"), "models promoted"), count(store.read("models").filter("status = 'retired' and retired_at is not null"), "models retired"),
        count(store.read("promotions").filter("decisao = 'adotado'"), "decisions adotado"), count(store.read("windows"), "windows"), store.read("windows").agg(F.sum("n_rows").alias("n")).select(F.lit("window rows"), "n"),
        count(store.read("provenance").filter("weight = 1"), "provenance"), count(store.read("evaluations"), "evaluations"), total("n", "golden rows"), total("n_ataque_real", "golden attacks"),
    ):
        out = out.union(part)
    return out


@R.add(duck("packets", "alerts", "verdicts", then=CUR + _GOLDEN + """,
  labelled AS (SELECT event_id AS id, CAST(scenario <> 'limpo' AS INT) AS label, scenario FROM golden WHERE event_id % 4 = 0
    UNION ALL SELECT a.alert_id, CAST(c.veredito = 'ataque' AS INT), 'verdict' FROM alerts a JOIN cur c ON c.alert_id = a.alert_id WHERE c.veredito IN ('ataque', 'benigno')),
  placed AS (SELECT label, scenario, row_number() OVER (PARTITION BY label ORDER BY id % 2147483648 * 2654435761 % 4294967296, id) AS place, count(*) OVER (PARTITION BY label) AS n FROM labelled),
  held AS (SELECT label, scenario FROM placed WHERE place <= (n * 30 + 50) // 100)
  SELECT 'evaluation' AS what, 'aggregate' AS name, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_ataque_real FROM held
  UNION ALL SELECT 'evaluation', scenario, count(*), CAST(sum(label) AS BIGINT) FROM held WHERE scenario <> 'verdict' GROUP BY scenario
  UNION ALL SELECT 'models', 'promoted', 1, NULL UNION ALL SELECT 'models', 'retired', 1, NULL UNION ALL SELECT 'assignments', 'pending', count(*), NULL FROM alerts
  UNION ALL SELECT 'queue', 'first', least(50, count(*)), NULL FROM alerts"""))
def stage2_cycle(spark, sf_dir):
    """Stage 2 from labels to the review queue: trained, evaluated, promoted in place of a live model, predicting."""
    store = _live_store(spark, 2, "linear_svm")
    p = _packets_with_features(spark, sf_dir)
    golden = _golden(spark, sf_dir).filter("event_id % 4 = 0").withColumn("id", F.col("event_id"))
    held = p.select(F.col("event_id").alias("alert_id"), *CYCLE_COLS)
    alerts = L.with_feature_json(view(spark, sf_dir, "alerts").join(held, "alert_id"), CYCLE_COLS)
    labelled = cycle.stage2_labels(golden, alerts, view(spark, sf_dir, "verdicts"), CYCLE_COLS)
    scenarios = golden.select("scenario").distinct()
    model_id, _, _ = cycle.train_stage2(store, labelled, CYCLE_COLS, "flow", NOW, scenarios)
    cycle.promote_stage2(store, model_id, "ana", NOW + 1)
    cycle.predict_pending(store, alerts, "flow", NOW + 2)
    none = F.lit(None).cast("long")
    e = store.read("evaluations").filter(F.col("model_id") == model_id).select(F.lit("evaluation").alias("what"), F.coalesce("scenario", "scope").alias("name"), "n", "n_ataque_real")
    m = store.read("models").groupBy("status").agg(F.count("*").alias("n")).select(F.lit("models"), "status", "n", none)
    a = store.read("assignments").groupBy("state").agg(F.count("*").alias("n")).select(F.lit("assignments"), "state", "n", none)
    q = L.review_queue(store.read("assignments"), alerts, 50).agg(F.count("*").alias("n")).select(F.lit("queue"), F.lit("first"), "n", none)
    return e.union(m).union(a).union(q)


@R.add("""SELECT event_id, user_id, value FROM (SELECT event_id, user_id, value, row_number() OVER (ORDER BY (event_id % 2147483648 + 42) * 2654435761 % 4294967296, event_id) AS place FROM events) t WHERE place <= 777""")
def sample_of_events(spark, sf_dir):
    """Exactly 777 rows by a seed."""
    return explore.sample_exactly(view(spark, sf_dir, "events"), 777, "event_id", 42).select("event_id", "user_id", "value")


@R.add(duck("packets", then="""SELECT sensor, count(*) AS n_rows, round(sum(length) + 1e-7, 4) AS length, (SELECT count(*) FROM (SELECT DISTINCT sensor, floor(ts / 86400) AS b FROM packets) w WHERE b % 7 = 0) AS vanished
  FROM packets WHERE floor(ts / 86400) % 7 <> 0 GROUP BY sensor"""))
def vanished_windows(spark, sf_dir):
    """A pool of daily windows read after some of its folders have gone."""
    root = fresh_path(spark, "pool")
    p = view(spark, sf_dir, "packets").select("sensor", F.lit("flow").alias("visao"), F.floor(F.col("ts") / 86400).alias("bucket"), "length")
    sinks.write_pool(p.withColumn("window_id", F.concat_ws("-", "bucket", "sensor")), root, 86400)
    index = spark.read.parquet(f"{root}/index")
    for r in index.filter("bucket % 7 = 0").select("path").collect():
        forget(spark, r["path"])
    rows, gone = sinks.read_windows(spark, index, f"{root}/windows")
    return rounded(rows.groupBy("sensor").agg(F.count("*").alias("n_rows"), F.sum("length").alias("length")).withColumn("vanished", F.lit(gone).cast("long")))


@R.add(duck("windows", then="SELECT window_id, n_rows FROM windows WHERE sensor = 's1' AND pool_state IN ('active', 'evicted') AND t_start >= 1705000000 AND t_end < 1706000000"))
def windows_filtered(spark, sf_dir):
    asked = L.matching(view(spark, sf_dir, "windows"), equal={"sensor": "s1", "visao": None}, since=("t_start", 1705000000), until=("t_end", 1706000000), among={"pool_state": ["active", "evicted"], "feature_set": None})
    return asked.select("window_id", "n_rows")


@R.add("""SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_linenumber <= 3""")
def csv_with_header(spark, sf_dir):
    """Line items through CSV with white space around names and a column that is not asked for."""
    path = fresh_path(spark, "csv")
    rows = view(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_comment" if "l_comment" in view(spark, sf_dir, "lineitem").columns else "l_tax")
    rows.toDF(" l_orderkey", " l_linenumber", "l_quantity ", " l_returnflag", " unused").write.csv(path, header=True)
    return read_headed_csv(spark, path, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string")

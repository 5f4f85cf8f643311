"""Queries over the control tables: pool, verdicts, gate, queue, final result, dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalars import json_number
from tidemark.operators import lifecycle as L
from tidemark.operators import rules
from tidemark.plans.inputs import NOW, Registry, duck, rounded, view

R = Registry()

CUR = ", cur AS (SELECT v.* FROM verdicts v ANTI JOIN (SELECT DISTINCT supersedes AS verdict_id FROM verdicts) old USING (verdict_id)) "


@R.add(duck("alerts", then="SELECT alert_id, round(percentile, 6) AS percentile FROM alerts WHERE percentile >= 0.95"))
def alerts_floor(spark, sf_dir):
    return view(spark, sf_dir, "alerts").filter(F.col("percentile") >= 0.95).select("alert_id", F.round("percentile", 6).alias("percentile"))


@R.add(duck("alerts", "verdicts", then=CUR + "SELECT a.alert_id, a.sensor, v.veredito, v.analista FROM alerts a LEFT JOIN cur v USING (alert_id) WHERE a.percentile >= 0.99"))
def alerts_cut(spark, sf_dir):
    return L.current_alerts(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "verdicts")).select("alert_id", "sensor", "veredito", "analista")


@R.add(duck("alerts", "verdicts", then=CUR + "SELECT a.alert_id, v.analista, v.classe, round(0.99 - a.percentile + 1e-7, 4) AS distancia_do_corte FROM alerts a JOIN cur v USING (alert_id) WHERE a.percentile < 0.99 AND v.veredito = 'ataque'"))
def near_misses(spark, sf_dir):
    return rounded(L.near_misses(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "verdicts")).select("alert_id", "analista", "classe", "distancia_do_corte"))


@R.add(duck("verdicts", then=CUR + "SELECT verdict_id, alert_id, veredito, classe, analista, supersedes FROM cur"))
def current_verdicts(spark, sf_dir):
    return L.current_verdicts(view(spark, sf_dir, "verdicts"))


POOL = f", pool AS (SELECT *, t_end + 7 * 86400 AS liberado_em, pow(0.5, ({NOW} - t_end) / (14 * 86400)) AS peso_recencia FROM windows WHERE pool_state = 'active' AND t_end + 7 * 86400 <= {NOW}) "


def _pool(spark, sf_dir):
    return L.training_pool(view(spark, sf_dir, "windows"), NOW)


@R.add(duck("windows", then=POOL + "SELECT window_id, visao, CAST(liberado_em AS DOUBLE) AS liberado_em, round(peso_recencia + 1e-9, 6) AS peso_recencia FROM pool"))
def training_pool(spark, sf_dir):
    return _pool(spark, sf_dir).select("window_id", "visao", F.col("liberado_em").cast("double").alias("liberado_em"), F.round(F.col("peso_recencia") + 1e-9, 6).alias("peso_recencia"))


@R.add(duck("windows", then=POOL + ", p AS (SELECT window_id, peso_recencia / max(peso_recencia) OVER (PARTITION BY visao) AS peso FROM pool) SELECT window_id, round(peso + 1e-9, 6) AS peso FROM p WHERE peso >= 0.3"))
def pool_weights(spark, sf_dir):
    return L.pool_weights(_pool(spark, sf_dir), 0.3).select("window_id", F.round(F.col("peso") + 1e-9, 6).alias("peso"))


@R.add(duck("windows", then=POOL + ", f AS (SELECT visao, arg_max(feature_set, (t_end, window_id)) AS fs FROM pool GROUP BY visao) SELECT p.window_id, p.feature_set FROM pool p JOIN f ON p.visao = f.visao AND p.feature_set = f.fs"))
def dominant_features(spark, sf_dir):
    return L.dominant_features(_pool(spark, sf_dir)).select("window_id", "feature_set")


@R.add(duck("windows", then=POOL + "SELECT window_id, n_rows, CAST(greatest(1, round_even(n_rows * least(1.0::DOUBLE, 200 / (SELECT sum(n_rows) FROM pool)::DOUBLE), 0)) AS BIGINT) AS n_take FROM pool"))
def sample_allocation(spark, sf_dir):
    return L.sample_allocation(_pool(spark, sf_dir), 200)


@R.add(duck("models", "provenance", "windows", then="""SELECT m.model_id, m.stage, m.kind, m.visao, m.status, count(*) AS n_janelas_despejadas, min(w.evicted_at) AS primeiro_despejo
  FROM models m JOIN provenance p USING (model_id) JOIN windows w USING (window_id) WHERE w.pool_state = 'evicted' AND m.status IN ('candidate', 'shadow', 'promoted') GROUP BY ALL"""))
def contaminated_models(spark, sf_dir):
    return L.contaminated_models(*(view(spark, sf_dir, n) for n in ("models", "provenance", "windows")))


_SUMS = "count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp, count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn, count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn"
EVALS = f""", c AS (SELECT CASE WHEN grouping(capture) = 0 THEN 'capture' WHEN grouping(scenario) = 0 THEN 'scenario' ELSE 'aggregate' END AS scope, scenario, capture, {_SUMS}
  FROM judged GROUP BY GROUPING SETS ((scenario, capture), (scenario), ())) """


@R.add(duck("judged", then=EVALS + "SELECT scope, scenario, capture, tp, fp, fn, tn FROM c"))
def golden_eval(spark, sf_dir):
    return L.golden_evaluation(view(spark, sf_dir, "judged")).select("scope", "scenario", "capture", "tp", "fp", "fn", "tn")


@R.add(duck("judged", then=EVALS + "SELECT scope, scenario, capture, round(tp / nullif(tp + fn, 0) + 1e-7, 4) AS recall, round(tp / nullif(tp + fp, 0) + 1e-7, 4) AS precisao, round(fp / nullif(fp + tn, 0) + 1e-7, 4) AS taxa_falso_positivo FROM c"))
def eval_rates(spark, sf_dir):
    return rounded(L.golden_evaluation(view(spark, sf_dir, "judged")).select("scope", "scenario", "capture", "recall", "precisao", "taxa_falso_positivo"))


#: Three tests a scenario, one row each; a failed one decides, else an unknown one.
GATE = """, live AS (SELECT stage, coalesce(visao, '-') AS vk, max(model_id) AS model_id FROM models WHERE status = 'promoted' AND kind <> 'decision_tree_surrogate' GROUP BY ALL),
  seen AS (SELECT model_id, scenario, recall, taxa_falso_positivo AS noise FROM evaluations WHERE scope = 'scenario'),
  met AS (SELECT m.model_id, l.model_id AS live_id, m.stage, m.visao, n.scenario, f.obrigatorio, n.recall AS now, o.recall AS was, f.recall_minimo AS floor, n.noise
    FROM seen n SEMI JOIN models USING (model_id) JOIN models m USING (model_id) JOIN floors f USING (stage, scenario)
    LEFT JOIN live l ON l.stage = m.stage AND l.vk = coalesce(m.visao, '-') LEFT JOIN seen o ON o.model_id = l.model_id AND o.scenario = n.scenario
    WHERE m.status NOT IN ('promoted', 'retired')),
  tests AS (SELECT model_id, scenario, unnest([CASE WHEN was IS NULL THEN false ELSE now - was < -0.10 END, CASE WHEN floor IS NULL THEN false ELSE now < floor END, coalesce(noise > 0.02, false)]) AS failed FROM met),
  ruled AS (SELECT model_id, scenario, CASE WHEN count(*) FILTER (WHERE failed) > 0 THEN true WHEN count(failed) < 3 THEN NULL ELSE false END AS reprova FROM tests GROUP BY ALL),
  chk AS (SELECT t.model_id AS candidate_model_id, t.live_id AS incumbent_model_id, t.stage, t.visao, t.scenario, t.obrigatorio, t.now - t.was AS delta, j.reprova FROM met t JOIN ruled j USING (model_id, scenario)) """
VERDICT = GATE + """, asked AS (SELECT stage, count(*) AS n FROM floors WHERE obrigatorio GROUP BY stage),
  tally AS (SELECT candidate_model_id, incumbent_model_id, stage, visao, count(*) AS n, sum(CASE WHEN reprova THEN 1 ELSE 0 END) AS failed, count(reprova) AS told, count(*) FILTER (WHERE obrigatorio) AS must, min(delta) AS worst FROM chk GROUP BY ALL),
  ver AS (SELECT t.candidate_model_id, t.incumbent_model_id, t.stage, t.visao, t.n AS cenarios_avaliados, CAST(t.failed AS BIGINT) AS cenarios_reprovados, t.worst AS pior_delta,
    CASE WHEN t.must < coalesce(a.n, 0) THEN false WHEN t.told = 0 THEN NULL ELSE t.failed = 0 END AS aprovado FROM tally t LEFT JOIN asked a USING (stage)) """


def _gate(spark, sf_dir):
    return L.gate_check(*(view(spark, sf_dir, n) for n in ("models", "evaluations", "floors")))


@R.add(duck("models", "evaluations", "floors", then=GATE + "SELECT candidate_model_id, incumbent_model_id, stage, visao, scenario, obrigatorio, round(delta + 1e-7, 4) AS delta, reprova FROM chk"))
def gate_check(spark, sf_dir):
    return rounded(_gate(spark, sf_dir).select("candidate_model_id", "incumbent_model_id", "stage", "visao", "scenario", "obrigatorio", "delta", "reprova"))


@R.add(duck("models", "evaluations", "floors", then=VERDICT + "SELECT candidate_model_id, incumbent_model_id, stage, visao, cenarios_avaliados, cenarios_reprovados, round(pior_delta + 1e-7, 4) AS pior_delta, aprovado FROM ver"))
def gate_verdict(spark, sf_dir):
    return rounded(L.gate_verdict(_gate(spark, sf_dir), view(spark, sf_dir, "floors")))


@R.add(duck("scenarios", "captures", then="SELECT s.scenario, count(c.capture) AS n_capturas, CAST(coalesce(sum(c.n_rows), 0) AS BIGINT) AS n_linhas FROM scenarios s LEFT JOIN captures c USING (scenario) GROUP BY 1"))
def golden_coverage(spark, sf_dir):
    return L.golden_coverage(view(spark, sf_dir, "scenarios"), view(spark, sf_dir, "captures"))


@R.add(duck("models", "evaluations", "floors", then=VERDICT + """SELECT m.model_id, m.stage, m.kind, m.visao, m.status, m.trained_at, round(e.recall + 1e-7, 4) AS recall, round(e.taxa_falso_positivo + 1e-7, 4) AS taxa_falso_positivo, v.aprovado
  FROM models m LEFT JOIN (SELECT model_id, recall, taxa_falso_positivo FROM evaluations WHERE scope = 'aggregate' QUALIFY evaluated_at = max(evaluated_at) OVER (PARTITION BY model_id)) e USING (model_id)
  LEFT JOIN ver v ON v.candidate_model_id = m.model_id ORDER BY m.trained_at DESC, m.model_id LIMIT 20"""))
def models_list(spark, sf_dir):
    v = L.gate_verdict(_gate(spark, sf_dir), view(spark, sf_dir, "floors"))
    return rounded(L.models_list(view(spark, sf_dir, "models"), view(spark, sf_dir, "evaluations"), v))


@R.add(duck("alerts", "assignments", then="SELECT s.assignment_id, s.alert_id, round(s.margin + 1e-7, 4) AS margin, a.src_ip, a.dst_ip FROM assignments s JOIN alerts a USING (alert_id, ts) WHERE s.state = 'pending' ORDER BY s.margin, s.assignment_id LIMIT 50"))
def review_queue(spark, sf_dir):
    return rounded(L.review_queue(view(spark, sf_dir, "assignments"), view(spark, sf_dir, "alerts")).select("assignment_id", "alert_id", "margin", "src_ip", "dst_ip"))


@R.add(duck("alerts", "assignments", then="SELECT s.assignment_id, round(coord_x + 1e-7, 4) AS coord_x, round(coord_y + 1e-7, 4) AS coord_y, predicted, state, a.src_ip AS origem, a.dst_ip AS destino, a.dst_port FROM assignments s JOIN alerts a USING (alert_id, ts) WHERE coord_x IS NOT NULL"))
def stage2_scatter(spark, sf_dir):
    return rounded(L.stage2_scatter(view(spark, sf_dir, "assignments"), view(spark, sf_dir, "alerts")).select("assignment_id", "coord_x", "coord_y", "predicted", "state", "origem", "destino", "dst_port"))


@R.add(duck("alerts", "assignments", then="SELECT alert_id, sensor FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM assignments s WHERE s.alert_id = a.alert_id AND s.model_id = 1)"))
def unscored_alerts(spark, sf_dir):
    return L.unscored_alerts(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "assignments"), 1).select("alert_id", "sensor")


#: Every answer an alert has got, with its rank; the first one counts.
FINAL = CUR + """, newest AS (SELECT alert_id, max((created_at, assignment_id)) AS k FROM assignments GROUP BY 1),
  s2 AS (SELECT a.* FROM assignments a JOIN newest n ON n.alert_id = a.alert_id AND n.k = (a.created_at, a.assignment_id)),
  said AS (SELECT alert_id, 1 AS rank, veredito AS answer, 'veredito' AS who FROM cur UNION ALL SELECT alert_id, 2, predicted, 'estagio2' FROM s2 UNION ALL SELECT alert_id, 3, 'pendente', 'estagio1' FROM alerts),
  first AS (SELECT alert_id, arg_min(answer, rank) AS classificacao, arg_min(who, rank) AS decidido_por FROM said WHERE answer IS NOT NULL GROUP BY 1),
  fin AS (SELECT a.*, s2.predicted AS e2_predito, s2.decision_value AS e2_decisao, s2.margin AS e2_margem, s2.state AS e2_estado, cur.veredito, cur.classe AS veredito_classe, cur.analista, first.classificacao, first.decidido_por
    FROM alerts a JOIN first USING (alert_id) LEFT JOIN s2 USING (alert_id) LEFT JOIN cur USING (alert_id)) """
_FIN = ("alerts", "assignments", "verdicts")


def _final(spark, sf_dir):
    return L.final_result(*(view(spark, sf_dir, n) for n in _FIN))


_FC = ("alert_id", "sensor", "src_ip", "dst_ip", "dst_port", "e2_predito", "e2_decisao", "e2_margem", "e2_estado", "veredito", "veredito_classe", "analista", "classificacao", "decidido_por")


@R.add(duck(*_FIN, then=FINAL + "SELECT alert_id, sensor, src_ip, dst_ip, dst_port, e2_predito, round(e2_decisao + 1e-7, 4) AS e2_decisao, round(e2_margem + 1e-7, 4) AS e2_margem, e2_estado, veredito, veredito_classe, analista, classificacao, decidido_por FROM fin"))
def final_result(spark, sf_dir):
    return rounded(_final(spark, sf_dir).select(*_FC))


@R.add(duck(*_FIN, then=FINAL + "SELECT classificacao, decidido_por, count(*) AS n FROM fin GROUP BY 1, 2"))
def final_distribution(spark, sf_dir):
    return _final(spark, sf_dir).groupBy("classificacao", "decidido_por").agg(F.count("*").alias("n"))


@R.add(duck(*_FIN, then=FINAL + "SELECT decidido_por, round(avg(CAST((classificacao = 'ataque')::INT = alert_id % 2 AS INT)) + 1e-7, 4) AS acerto FROM fin GROUP BY 1"))
def final_accuracy(spark, sf_dir):
    hit = ((F.col("classificacao") == "ataque").cast("int") == F.col("alert_id") % 2).cast("int")
    return rounded(_final(spark, sf_dir).groupBy("decidido_por").agg(F.avg(hit).alias("acerto")))


@R.add(duck(*_FIN, then=FINAL + """, t AS (SELECT CAST(range AS BIGINT) * 43200 AS t FROM range(39444, 39504))
  SELECT t.t, count(f.alert_id) AS total, count(*) FILTER (WHERE f.classificacao = 'ataque') AS ataques FROM t LEFT JOIN fin f ON CAST(floor(f.ts / 43200) AS BIGINT) * 43200 = t.t GROUP BY 1"""))
def final_over_time(spark, sf_dir):
    return L.over_time(_final(spark, sf_dir), 43200, 39444 * 43200, 39503 * 43200)


@R.add(duck("alerts", then="SELECT src_ip, count(*) AS alertas, round(max(percentile), 6) AS max_percentil FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_sources(spark, sf_dir):
    return L.top_sources(view(spark, sf_dir, "alerts")).withColumn("max_percentil", F.round("max_percentil", 6))


@R.add(duck("windows", then="SELECT visao, strftime(make_timestamp(t_start * 1000000), '%Y-%m-%d') AS dia, count(*) AS n_janelas, CAST(sum(n_rows) AS BIGINT) AS fluxos_extraidos, CAST(sum(parquet_bytes) AS BIGINT) AS parquet_bytes, CAST(round(sum(n_rows) * (1 - 0.95::DOUBLE) + 1e-9) AS BIGINT) AS linhas_previstas FROM windows GROUP BY 1, 2"))
def ingest_volume(spark, sf_dir):
    return L.ingest_volume(view(spark, sf_dir, "windows"))


@R.add(duck("alerts", then="SELECT sensor, strftime(make_timestamp(CAST(floor(ts) AS BIGINT) * 1000000), '%Y-%m-%d') AS dia, count(*) AS n, count(*) FILTER (WHERE percentile >= 0.99) AS acima FROM alerts GROUP BY 1, 2"))
def alerts_over_time(spark, sf_dir):
    day = F.date_format(F.timestamp_seconds(F.floor("ts")), "yyyy-MM-dd").alias("dia")
    return view(spark, sf_dir, "alerts").groupBy("sensor", day).agg(F.count("*").alias("n"), F.count_if(F.col("percentile") >= 0.99).alias("acima"))


@R.add(duck("history", then="SELECT key, arg_max(value, changed_at) AS value, max(changed_at) AS changed_at FROM history GROUP BY key"))
def param_values(spark, sf_dir):
    return L.parameter_values(view(spark, sf_dir, "history"))


@R.add(duck("history", then=", h AS (SELECT key, changed_at, lag(value) OVER (PARTITION BY key ORDER BY changed_at) AS old_value, value AS new_value FROM history) SELECT * FROM h WHERE old_value IS DISTINCT FROM new_value"))
def param_history(spark, sf_dir):
    return L.parameter_history(view(spark, sf_dir, "history"))


@R.add(duck("requests", then="SELECT request_id, requested_at FROM requests WHERE state = 'pending' ORDER BY requested_at, request_id LIMIT 1"))
def retrain_next(spark, sf_dir):
    return L.next_request(view(spark, sf_dir, "requests")).select("request_id", "requested_at")


@R.add(duck("windows", then="SELECT window_id, path FROM windows WHERE bucket % 11 = 0"))
def reconcile_orphans(spark, sf_dir):
    w = view(spark, sf_dir, "windows")
    return L.orphans(w, w.filter("bucket % 11 <> 0").select("path")).select("window_id", "path")


@R.add(duck("windows", then="SELECT window_id, CASE WHEN window_id IN (SELECT window_id FROM windows WHERE bucket % 13 = 0) AND pool_state = 'active' THEN 'evicted' ELSE pool_state END AS pool_state FROM windows"))
def evict_windows(spark, sf_dir):
    w = view(spark, sf_dir, "windows")
    return L.evict(w, w.filter("bucket % 13 = 0").select("window_id"), "poisoned", NOW).select("window_id", "pool_state")


_BROKEN = """, bw AS (SELECT CASE WHEN bucket % 17 = 0 THEN t_end ELSE t_start END AS t_start, t_end, pool_state, CASE WHEN bucket % 14 <> 0 THEN evicted_at END AS evicted_at, bucket FROM windows),
  bm AS (SELECT stage, visao, kind, CASE WHEN model_id IN (2, 4) THEN 'promoted' ELSE status END AS status FROM models), ba AS (SELECT percentile * 1.01 AS percentile FROM alerts),
  bv AS (SELECT coalesce(supersedes, -(alert_id % 50)) AS supersedes FROM verdicts) """


@R.add(duck("windows", "models", "alerts", "verdicts", then=_BROKEN + """SELECT 'window_order' AS rule, count(*) AS n FROM bw WHERE NOT t_start < t_end
  UNION ALL SELECT 'eviction_time', sum(CASE WHEN pool_state = 'evicted' AND evicted_at IS NULL THEN 1 WHEN pool_state <> 'evicted' AND evicted_at IS NOT NULL THEN 1 ELSE 0 END)::BIGINT FROM bw
  UNION ALL SELECT 'one_promoted', count(*) FROM (SELECT stage, visao FROM bm WHERE status = 'promoted' AND kind <> 'decision_tree_surrogate' GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'percentile_range', count(*) FROM ba WHERE NOT percentile BETWEEN 0 AND 1
  UNION ALL SELECT 'linear_chain', count(*) FROM (SELECT supersedes FROM bv WHERE supersedes IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"""))
def constraint_violations(spark, sf_dir):
    """Tables made to break every rule."""
    w, m, a, v = (view(spark, sf_dir, n) for n in ("windows", "models", "alerts", "verdicts"))
    w = w.withColumns({"t_start": F.when(F.col("bucket") % 17 == 0, F.col("t_end")).otherwise(F.col("t_start")), "evicted_at": F.when(F.col("bucket") % 14 != 0, F.col("evicted_at"))})
    m = m.withColumn("status", F.when(F.col("model_id").isin(2, 4), "promoted").otherwise(F.col("status")))
    v = v.withColumn("supersedes", F.coalesce("supersedes", -(F.col("alert_id") % 50)))
    return L.violations(w, m, a.withColumn("percentile", F.col("percentile") * 1.01), v)


@R.add(duck("models", then="SELECT model_id, CASE WHEN model_id = 2 THEN 'promoted' WHEN model_id = 1 THEN 'retired' ELSE status END AS status FROM models"))
def promote_forced(spark, sf_dir):
    v = L.gate_verdict(_gate(spark, sf_dir), view(spark, sf_dir, "floors"))
    return L.promote(view(spark, sf_dir, "models"), v, 2, "reviewed")[0].select("model_id", "status")


@R.add(duck("windows", then="SELECT window_id, t_start, n_rows FROM windows ORDER BY t_start DESC, window_id LIMIT 20"))
def pool_newest(spark, sf_dir):
    return view(spark, sf_dir, "windows").orderBy(F.desc("t_start"), "window_id").limit(20).select("window_id", "t_start", "n_rows")


@R.add(duck("alerts", then="SELECT alert_id, round(percentile, 6) AS percentile, src_ip || ' → ' || dst_ip || ':' || CAST(dst_port AS VARCHAR) AS ends FROM alerts ORDER BY alerts.percentile DESC, alert_id LIMIT 8"))
def alerts_top(spark, sf_dir):
    return L.top_alerts(view(spark, sf_dir, "alerts")).select("alert_id", F.round("percentile", 6).alias("percentile"), "ends")


@R.add(duck("alerts", then=f"SELECT sensor, count(*) AS n, count(*) FILTER (WHERE ts > {NOW} - 14 * 86400) AS n_recent FROM alerts WHERE ts > {NOW} - 21 * 86400 GROUP BY 1"))
def alerts_recent(spark, sf_dir):
    late = L.newer_than(view(spark, sf_dir, "alerts"), "ts", NOW, 21)
    return late.groupBy("sensor").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > NOW - 14 * 86400).alias("n_recent"))


@R.add(duck("alerts", then="SELECT sensor, visao, count(*) AS n, round(min(percentile), 6) AS lowest, round(max(percentile), 6) AS highest, min(ts) AS first_ts, max(ts) AS last_ts FROM alerts GROUP BY 1, 2"))
def alerts_summary(spark, sf_dir):
    return L.alerts_summary(view(spark, sf_dir, "alerts"), ["sensor", "visao"]).withColumns({c: F.round(c, 6) for c in ("lowest", "highest")})


@R.add(duck("models", "evaluations", then="SELECT model_id, scope, scenario, recall FROM evaluations WHERE model_id = (SELECT arg_max(model_id, trained_at) FROM models WHERE stage = 2)"))
def latest_model_evaluations(spark, sf_dir):
    return L.of_latest_model(view(spark, sf_dir, "evaluations"), view(spark, sf_dir, "models").filter("stage = 2")).select("model_id", "scope", "scenario", "recall")


@R.add(duck("models", then=f"SELECT model_id, round(({NOW} - trained_at) / 3600.0::DOUBLE + 1e-7, 4) AS hours FROM models WHERE status = 'promoted'"))
def promoted_hours(spark, sf_dir):
    return rounded(L.elapsed_hours(view(spark, sf_dir, "models").filter("status = 'promoted'"), "trained_at", NOW).select("model_id", "hours"))


@R.add(duck("alerts", "verdicts", "scenarios", then=CUR + "SELECT a.alert_id, CAST(v.veredito = 'ataque' AS INT) AS label, 's' || CAST(a.alert_id % 7 AS VARCHAR) AS scenario FROM alerts a JOIN cur v USING (alert_id) WHERE v.veredito <> 'inconclusivo' AND 's' || CAST(a.alert_id % 7 AS VARCHAR) IN (SELECT scenario FROM scenarios)"))
def stage2_training(spark, sf_dir):
    a = view(spark, sf_dir, "alerts").withColumn("scenario", F.concat(F.lit("s"), (F.col("alert_id") % 7).cast("string")))
    return L.stage2_training(a, view(spark, sf_dir, "verdicts"), view(spark, sf_dir, "scenarios")).select("alert_id", "label", "scenario")


@R.add(duck("judged", then="""SELECT scenario, CAST(sum(label * predicted) AS BIGINT) AS tp, CAST(sum((1 - label) * predicted) AS BIGINT) AS fp, CAST(sum(label * (1 - predicted)) AS BIGINT) AS fn,
  CAST(sum((1 - label) * (1 - predicted)) AS BIGINT) AS tn FROM judged WHERE doc_id % 5 = 0 GROUP BY 1"""))
def stage2_held_out(spark, sf_dir):
    return L.held_out_confusion(view(spark, sf_dir, "judged"), F.col("doc_id") % 5 == 0)


@R.add(duck("captures", then="SELECT capture, scenario, CAST(CASE WHEN capture IN ('c1', 'c2') THEN n_rows * 2 ELSE n_rows END AS BIGINT) AS n_rows FROM captures UNION ALL SELECT 'c9', 's1', 7"))
def golden_upsert(spark, sf_dir):
    old = view(spark, sf_dir, "captures")
    more = spark.sql("SELECT 'c9' AS capture, 's1' AS scenario, 7L AS n_rows")
    return L.keyed_replace(old, old.filter("capture in ('c1', 'c2')").withColumn("n_rows", F.col("n_rows") * 2).unionByName(more), ["capture"])


@R.add(duck("windows", "models", then="""SELECT w.window_id, m.model_id FROM windows w, models m WHERE m.visao = w.visao AND m.status = 'candidate' AND w.feature_set = CASE WHEN m.model_id = 8 THEN 'flow-v2' ELSE 'flow-v1' END"""))
def feature_set_match(spark, sf_dir):
    m = view(spark, sf_dir, "models").filter("status = 'candidate'").withColumn("feature_set", F.when(F.col("model_id") == 8, "flow-v2").otherwise("flow-v1"))
    return L.matching_sets(view(spark, sf_dir, "windows"), m).select("window_id", "model_id")


@R.add(duck("alerts", then=f"SELECT alert_id FROM alerts WHERE ts >= {NOW} - 20 * 86400"))
def retained_alerts(spark, sf_dir):
    return L.retained(view(spark, sf_dir, "alerts"), "ts", NOW, 20).select("alert_id")


@R.add(duck("alerts", then="SELECT alert_id, round(score + 1e-7, 4) AS score, 0.0::DOUBLE AS missing FROM alerts"))
def features_from_json(spark, sf_dir):
    a = L.with_feature_json(view(spark, sf_dir, "alerts"), ["score", "proto"])
    return rounded(a.select("alert_id", json_number("features", "score").alias("score"), json_number("features", "not_there").alias("missing")))


_NOT_IN = lambda column, *words: f"count(*) FILTER (WHERE NOT list_contains([{', '.join(repr(w) for w in words)}], {column}))"
_TWICE = lambda table, cols, where="true": f"(SELECT count(*) FROM (SELECT {cols} FROM {table} WHERE {where} GROUP BY ALL HAVING count(*) > 1) d WHERE (d IS NOT NULL))"
_LOST = lambda table, column, other, target: f"(SELECT count(*) FROM {table} x WHERE x.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {other} y WHERE y.{target} = x.{column}))"
#: Rule, table and count, each in the oracle's own words.
_COUNTS = [
    ("window_view", "odd_windows", "count(*) FILTER (WHERE visao = 'net')"), ("window_rows", "odd_windows", "count(*) FILTER (WHERE n_rows < 0)"), ("window_extractor", "odd_windows", "count(*) FILTER (WHERE extractor = 'perl')"),
    ("window_state", "odd_windows", "count(*) FILTER (WHERE pool_state = 'gone')"), ("window_order", "odd_windows", "count(*) FILTER (WHERE t_start >= t_end)"),
    ("eviction_time", "odd_windows", "count(*) FILTER (WHERE pool_state = 'evicted' AND evicted_at IS NULL OR pool_state <> 'evicted' AND evicted_at IS NOT NULL)"),
    ("eviction_reason", "odd_windows", "count(*) FILTER (WHERE pool_state = 'evicted' AND evicted_reason IS NULL)"), ("window_key", None, _TWICE("odd_windows", "window_id")), ("window_path", None, _TWICE("odd_windows", "path")),
    ("model_stage", "odd_models", "count(*) FILTER (WHERE stage NOT BETWEEN 1 AND 2)"), ("model_kind", "odd_models", "count(*) FILTER (WHERE kind = 'oracle')"), ("model_view", "odd_models", "count(*) FILTER (WHERE visao = 'net')"),
    ("model_status", "odd_models", "count(*) FILTER (WHERE status = 'lost')"), ("surrogate_explains", "odd_models", "count(*) FILTER (WHERE CASE WHEN kind = 'decision_tree_surrogate' THEN explains_model_id IS NULL ELSE explains_model_id IS NOT NULL END)"),
    ("promotion_time", "odd_models", "count(*) FILTER (WHERE status = 'promoted' AND promoted_at IS NULL)"), ("retirement_time", "odd_models", "count(*) FILTER (WHERE status = 'retired' AND retired_at IS NULL)"),
    ("model_key", None, _TWICE("odd_models", "model_id")), ("model_path", None, _TWICE("odd_models", "artifact_path")),
    ("one_promoted", None, _TWICE("odd_models", "stage, coalesce(visao, '') AS v", "status = 'promoted' AND kind <> 'decision_tree_surrogate'")),
    ("provenance_weight", "odd_provenance", "count(*) FILTER (WHERE weight <= 0)"), ("provenance_key", None, _TWICE("odd_provenance", "model_id, window_id")),
    ("provenance_model", None, _LOST("odd_provenance", "model_id", "odd_models", "model_id")), ("provenance_window", None, _LOST("odd_provenance", "window_id", "odd_windows", "window_id")),
    ("floor_stage", "floors", "count(*) FILTER (WHERE stage NOT BETWEEN 1 AND 2)"), ("floor_range", "floors", "count(*) FILTER (WHERE recall_minimo < 0 OR recall_minimo > 1)"), ("floor_key", None, _TWICE("floors", "stage, scenario")),
    ("floor_scenario", None, _LOST("floors", "scenario", "scenarios", "scenario")),
    ("capture_label", "odd_captures", "count(*) FILTER (WHERE label NOT BETWEEN 0 AND 1)"), ("capture_view", "odd_captures", "count(*) FILTER (WHERE visao = 'net')"), ("capture_rows", "odd_captures", "count(*) FILTER (WHERE n_rows < 0)"),
    ("capture_key", None, _TWICE("odd_captures", "capture")), ("capture_path", None, _TWICE("odd_captures", "parquet_path")), ("capture_scenario", None, _LOST("odd_captures", "scenario", "scenarios", "scenario")),
    ("evaluation_scope", "odd_evaluations", "count(*) FILTER (WHERE scope = 'all')"), ("evaluation_size", "odd_evaluations", "count(*) FILTER (WHERE n < 0)"), ("scenario_named", "odd_evaluations", "count(*) FILTER (WHERE scope = 'scenario' AND scenario IS NULL)"),
    ("capture_named", "odd_evaluations", "count(*) FILTER (WHERE scope = 'capture' AND capture IS NULL)"), ("aggregate_unnamed", "odd_evaluations", "count(*) FILTER (WHERE scope = 'aggregate' AND coalesce(scenario, capture) IS NOT NULL)"),
    ("one_evaluation", None, _TWICE("odd_evaluations", "model_id, scope, coalesce(scenario, '') AS s, coalesce(capture, '') AS c")), ("evaluation_model", None, _LOST("odd_evaluations", "model_id", "odd_models", "model_id")),
    ("alert_view", "odd_alerts", "count(*) FILTER (WHERE visao = 'net')"), ("source_port", "odd_alerts", "count(*) FILTER (WHERE src_port < 0 OR src_port > 65535)"), ("target_port", "odd_alerts", "count(*) FILTER (WHERE dst_port < 0 OR dst_port > 65535)"),
    ("percentile_range", "odd_alerts", "count(*) FILTER (WHERE percentile > 1 OR percentile < 0)"), ("replay_label", "odd_alerts", "count(*) FILTER (WHERE label_cic > 1)"), ("alert_key", None, _TWICE("odd_alerts", "ts, alert_id")),
    ("verdict_word", "odd_verdicts", _NOT_IN("veredito", "ataque", "benigno", "indeterminado")), ("confidence_range", "odd_verdicts", "count(*) FILTER (WHERE confianca < 1 OR confianca > 5)"),
    ("no_self_chain", "odd_verdicts", "count(*) FILTER (WHERE verdict_id = supersedes)"), ("verdict_key", None, _TWICE("odd_verdicts", "verdict_id")), ("linear_chain", None, _TWICE("odd_verdicts", "supersedes")),
    ("chain_target", None, _LOST("odd_verdicts", "supersedes", "odd_verdicts", "verdict_id")),
    ("predicted_word", "odd_assignments", "count(*) FILTER (WHERE predicted = 'talvez')"), ("assignment_state", "odd_assignments", _NOT_IN("state", "pending", "in_review", "done", "skipped")),
    ("closing_time", "odd_assignments", "count(*) FILTER (WHERE CASE WHEN state IN ('done', 'skipped') THEN closed_at IS NULL ELSE closed_at IS NOT NULL END)"),
    ("assignment_key", None, _TWICE("odd_assignments", "assignment_id")), ("one_assignment", None, _TWICE("odd_assignments", "alert_id, model_id")),
    ("request_stage", "odd_requests", "count(*) FILTER (WHERE stage NOT BETWEEN 1 AND 2)"), ("request_view", "odd_requests", "count(*) FILTER (WHERE visao = 'net')"), ("request_origin", "odd_requests", "count(*) FILTER (WHERE origem = 'outro')"),
    ("request_state", "odd_requests", "count(*) FILTER (WHERE state = 'lost')"), ("failure_reason", "odd_requests", "count(*) FILTER (WHERE state = 'failed' AND erro IS NULL)"),
    ("finish_time", "odd_requests", "count(*) FILTER (WHERE CASE WHEN state IN ('done', 'failed', 'cancelled') THEN finished_at IS NULL ELSE finished_at IS NOT NULL END)"),
    ("request_key", None, _TWICE("odd_requests", "request_id")), ("one_pending", None, _TWICE("odd_requests", "stage, coalesce(visao, '') AS v", "state IN ('pending', 'running')")),
]
_ODD = ("windows", "models", "provenance", "evaluations", "alerts", "verdicts", "assignments", "requests", "captures")


@R.add(duck(*[f"odd_{t}" for t in _ODD], "floors", "scenarios", then=" UNION ALL ".join(f"SELECT '{n}' AS rule, CAST({c} AS BIGINT) AS n" + (f" FROM {t}" if t else "") for n, t, c in _COUNTS)))
def control_invariants(spark, sf_dir):
    """Every invariant of the control tables, over tables that break them."""
    tables = {t: view(spark, sf_dir, f"odd_{t}") for t in _ODD} | {t: view(spark, sf_dir, t) for t in ("floors", "scenarios")}
    return rules.violations(tables)


@R.add(duck("odd_windows", then="""SELECT path, list_sort(list_filter([CASE WHEN visao = 'net' THEN 'window_view' END, CASE WHEN n_rows < 0 THEN 'window_rows' END, CASE WHEN extractor = 'perl' THEN 'window_extractor' END,
  CASE WHEN pool_state = 'gone' THEN 'window_state' END, CASE WHEN t_start >= t_end THEN 'window_order' END, CASE WHEN (pool_state = 'evicted') <> (evicted_at IS NOT NULL) THEN 'eviction_time' END,
  CASE WHEN pool_state = 'evicted' AND evicted_reason IS NULL THEN 'eviction_reason' END], lambda x: x IS NOT NULL))::VARCHAR AS broken FROM odd_windows WHERE len(list_filter([visao = 'net', n_rows < 0, extractor = 'perl', pool_state = 'gone',
  t_start >= t_end, (pool_state = 'evicted') <> (evicted_at IS NOT NULL), pool_state = 'evicted' AND evicted_reason IS NULL], lambda x: x)) > 0"""))
def broken_windows(spark, sf_dir):
    """The windows that break row rules, with their names."""
    found = rules.broken_rows(view(spark, sf_dir, "odd_windows"), "windows")
    return found.select("path", F.concat(F.lit("["), F.array_join(F.sort_array("broken"), ", "), F.lit("]")).alias("broken"))

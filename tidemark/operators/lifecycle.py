"""The model lifecycle as relational operators: tables in, tables out; "now" and parameters are arguments.

Column names are those of the observable views. Timestamps are compared as epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import recency_weight
from tidemark.operators.stats import confusion, with_rates

DAY = 86400


def parameter(history: DataFrame, key: str) -> float | None:
    """The newest value of a numeric parameter."""
    row = history.filter(F.col("key") == key).agg(F.max_by("value", "changed_at")).first()
    return row[0]


def parameter_values(history: DataFrame) -> DataFrame:
    """``key, value, changed_at``: the newest value of each key."""
    return history.groupBy("key").agg(F.max_by("value", "changed_at").alias("value"), F.max("changed_at").alias("changed_at"))


def parameter_history(history: DataFrame) -> DataFrame:
    """Changes only: ``key, changed_at, old_value, new_value`` where the value differs from the one before."""
    order = Window.partitionBy("key").orderBy("changed_at")
    old = F.lag("value").over(order)
    return history.select("key", "changed_at", old.alias("old_value"), F.col("value").alias("new_value")).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))


def training_pool(windows: DataFrame, now: float, quarantine_days: float = 7.0, halflife_days: float = 14.0) -> DataFrame:
    """Active windows out of quarantine, with ``liberado_em`` and ``peso_recencia``."""
    freed = F.col("t_end") + quarantine_days * DAY
    return windows.filter((F.col("pool_state") == "active") & (freed <= now)).withColumns(
        {"liberado_em": freed, "peso_recencia": recency_weight(F.lit(float(now)) - F.col("t_end"), halflife_days)}
    )


def pool_weights(pool: DataFrame, least: float = 0.05) -> DataFrame:
    """``pool`` with ``peso``: the recency weight over the largest of its view, 1 where none is positive; light windows go."""
    top = pool.groupBy(F.col("visao").alias("_v")).agg(F.max("peso_recencia").alias("_top"))
    weighed = pool.join(F.broadcast(top), F.col("visao") == F.col("_v")).withColumn("peso", F.when(F.col("_top") > 0, F.col("peso_recencia") / F.col("_top")).otherwise(1.0))
    return weighed.filter(F.col("peso") >= least).drop("_v", "_top")


def dominant_features(pool: DataFrame) -> DataFrame:
    """Windows whose feature set is that of the newest window of their view."""
    newest = pool.groupBy(F.col("visao").alias("_v")).agg(F.max_by("feature_set", F.struct("t_end", "window_id")).alias("_f"))
    return pool.join(F.broadcast(newest), (F.col("visao") == F.col("_v")) & (F.col("feature_set") == F.col("_f"))).drop("_v", "_f")


def sample_allocation(pool: DataFrame, max_rows: int) -> DataFrame:
    """``window_id, n_rows, n_take``: rows to take of each window in proportion, at least one."""
    total = pool.agg(F.sum("n_rows")).first()[0] or 0
    share = min(1.0, max_rows / total) if total else 1.0
    return pool.select("window_id", "n_rows", F.greatest(F.lit(1), F.bround(F.col("n_rows") * F.lit(share)).cast("long")).alias("n_take"))


def sample_rows(rows: DataFrame, allocation: DataFrame, id_col: str) -> DataFrame:
    """Rows of each window with the smallest id hashes, as many as allocated.

    The threshold of each window comes from an approximate quantile of hashes with slack, so only
    about ``n_take`` rows per window are ranked.
    """
    h = F.abs(F.xxhash64(F.lit(42), F.col(id_col)) / F.lit(2.0**63))
    share = allocation.select(F.col("window_id").alias("_w"), "n_take", ((F.col("n_take") + 4 * F.sqrt(F.col("n_take")) + 16) / F.greatest(F.col("n_rows"), F.lit(1))).alias("_share"))
    near = rows.join(F.broadcast(share), F.col("window_id") == F.col("_w")).withColumn("_h", h).filter(F.col("_h") <= F.col("_share"))
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("_h", id_col))
    return near.withColumn("_r", rank).filter(F.col("_r") <= F.col("n_take")).drop("_w", "n_take", "_share", "_h", "_r")


def contaminated_models(models: DataFrame, provenance: DataFrame, windows: DataFrame) -> DataFrame:
    """Live models trained on windows that were evicted since, with their number and the first eviction."""
    evicted = windows.filter(F.col("pool_state") == "evicted").select("window_id", "evicted_at")
    hit = provenance.join(evicted, "window_id").groupBy("model_id").agg(F.count("*").alias("n_janelas_despejadas"), F.min("evicted_at").alias("primeiro_despejo"))
    return models.filter(F.col("status").isin("candidate", "shadow", "promoted")).join(hit, "model_id").select(
        "model_id", "stage", "kind", "visao", "status", "n_janelas_despejadas", "primeiro_despejo"
    )


def current_verdicts(verdicts: DataFrame) -> DataFrame:
    """Heads of the verdict chains: verdicts that none supersedes."""
    old = verdicts.filter(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("_old"))
    return verdicts.join(old, F.col("verdict_id") == F.col("_old"), "left_anti")


def current_alerts(alerts: DataFrame, verdicts: DataFrame, cut: float = 0.99) -> DataFrame:
    """Alerts at or above the analyst cut with the current verdict, if any."""
    v = current_verdicts(verdicts).select("alert_id", "veredito", "analista")
    return alerts.filter(F.col("percentile") >= cut).join(v, "alert_id", "left")


def near_misses(alerts: DataFrame, verdicts: DataFrame, cut: float = 0.99) -> DataFrame:
    """Alerts below the cut that an analyst called an attack, with ``distancia_do_corte``."""
    v = current_verdicts(verdicts).filter(F.col("veredito") == "ataque").select("alert_id", "analista", "classe")
    return alerts.filter(F.col("percentile") < cut).join(v, "alert_id").withColumn("distancia_do_corte", F.lit(cut) - F.col("percentile"))


def latest_assignments(assignments: DataFrame) -> DataFrame:
    """The newest stage-2 row of each alert, by partial aggregation instead of a sort."""
    cols = [c for c in assignments.columns if c != "alert_id"]
    newest = F.max_by(F.struct(*cols), F.struct("created_at", "assignment_id")).alias("_s")
    return assignments.groupBy("alert_id").agg(newest).select("alert_id", *[F.col(f"_s.{c}").alias(c) for c in cols])


def final_result(alerts: DataFrame, assignments: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row per alert: verdict before stage 2 before pending, and who decided."""
    s2 = latest_assignments(assignments).select("alert_id", F.col("predicted").alias("e2_predito"), F.col("decision_value").alias("e2_decisao"), F.col("margin").alias("e2_margem"), F.col("state").alias("e2_estado"))
    v = current_verdicts(verdicts).select("alert_id", "veredito", F.col("classe").alias("veredito_classe"), "analista")
    by = F.when(F.col("veredito").isNotNull(), "veredito").when(F.col("e2_predito").isNotNull(), "estagio2").otherwise("estagio1")
    return alerts.join(s2, "alert_id", "left").join(v, "alert_id", "left").withColumns(
        {"classificacao": F.coalesce("veredito", "e2_predito", F.lit("pendente")), "decidido_por": by}
    )


def review_queue(assignments: DataFrame, alerts: DataFrame, size: int = 50) -> DataFrame:
    """Pending assignments, least margin first."""
    return (
        assignments.filter(F.col("state") == "pending")
        .join(alerts.select("alert_id", "ts", "src_ip", "dst_ip", "dst_port", "percentile"), ["alert_id", "ts"])
        .orderBy("margin", "assignment_id").limit(size)
    )


def stage2_scatter(assignments: DataFrame, alerts: DataFrame) -> DataFrame:
    """Projected assignments with the addresses of their alerts."""
    ends = alerts.select("alert_id", "ts", F.col("src_ip").alias("origem"), F.col("dst_ip").alias("destino"), "dst_port")
    return assignments.filter(F.col("coord_x").isNotNull()).join(ends, ["alert_id", "ts"]).select(
        "assignment_id", "coord_x", "coord_y", "predicted", "decision_value", "margin", "state", "origem", "destino", "dst_port", "ts"
    )


def unscored_alerts(alerts: DataFrame, assignments: DataFrame, model_id: int, limit: int | None = None) -> DataFrame:
    """Alerts without an assignment of this model, newest first where ``limit`` is set."""
    done = assignments.filter(F.col("model_id") == model_id).select("alert_id")
    out = alerts.join(done, "alert_id", "left_anti")
    return out if limit is None else out.orderBy(F.desc("ts"), "alert_id").limit(limit)


def golden_evaluation(scored: DataFrame) -> DataFrame:
    """Confusion counts and rates per capture, per scenario and in all, from pooled counts.

    One grouping at the finest grain; the coarser scopes sum its few rows.
    """
    fine = confusion(scored, "label", "predicted", ["scenario", "capture"])
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
    scopes = (
        fine.select(F.lit("capture").alias("scope"), "scenario", "capture", "tp", "fp", "fn", "tn")
        .unionByName(fine.groupBy("scenario").agg(*sums).select(F.lit("scenario").alias("scope"), "scenario", F.lit(None).cast("string").alias("capture"), "tp", "fp", "fn", "tn"))
        .unionByName(fine.agg(*sums).select(F.lit("aggregate").alias("scope"), F.lit(None).cast("string").alias("scenario"), F.lit(None).cast("string").alias("capture"), "tp", "fp", "fn", "tn"))
    )
    return with_rates(scopes)


def gate_check(models: DataFrame, evaluations: DataFrame, floors: DataFrame, max_drop: float = 0.10, max_fpr: float = 0.02) -> DataFrame:
    """Candidate by scenario against the promoted model and the floors, with three-valued ``reprova``."""
    ev = evaluations.filter(F.col("scope") == "scenario")
    cand = models.filter(F.col("status").isin("candidate", "shadow")).select(F.col("model_id").alias("candidate_model_id"), "stage", "visao")
    prod = models.filter((F.col("status") == "promoted") & (F.col("kind") != "decision_tree_surrogate")).select(
        F.col("model_id").alias("incumbent_model_id"), F.col("stage").alias("_ps"), F.col("visao").alias("_pv")
    )
    ec = ev.select(F.col("model_id").alias("candidate_model_id"), "scenario", F.col("recall").alias("recall_candidato"), "taxa_falso_positivo")
    ep = ev.select(F.col("model_id").alias("incumbent_model_id"), "scenario", F.col("recall").alias("recall_producao"))
    joined = (
        cand.join(ec, "candidate_model_id").join(F.broadcast(floors), ["stage", "scenario"])
        .join(F.broadcast(prod), (F.col("stage") == F.col("_ps")) & F.col("visao").eqNullSafe(F.col("_pv")), "left").drop("_ps", "_pv")
        .join(ep, ["incumbent_model_id", "scenario"], "left")
    )
    fell = F.col("recall_producao").isNotNull() & (F.col("recall_candidato") - F.col("recall_producao") < -max_drop)
    low = F.col("recall_minimo").isNotNull() & (F.col("recall_candidato") < F.col("recall_minimo"))
    loud = F.col("taxa_falso_positivo").isNotNull() & (F.col("taxa_falso_positivo") > max_fpr)
    return joined.select(
        "candidate_model_id", "incumbent_model_id", "stage", "visao", "scenario", "obrigatorio", "recall_candidato", "recall_producao",
        (F.col("recall_candidato") - F.col("recall_producao")).alias("delta"), "recall_minimo", "taxa_falso_positivo", (fell | low | loud).alias("reprova"),
    )


def gate_verdict(check: DataFrame, floors: DataFrame) -> DataFrame:
    """Per candidate: scenarios seen and failed, the worst change, and ``aprovado`` (null where every term is)."""
    grouped = check.groupBy("candidate_model_id", "incumbent_model_id", "stage", "visao").agg(
        F.count("*").alias("cenarios_avaliados"), F.count_if("reprova").alias("cenarios_reprovados"), F.min("delta").alias("pior_delta"), F.bool_or("reprova").alias("_any")
    )
    needed = grouped.select("candidate_model_id", "stage").distinct().join(F.broadcast(floors.filter("obrigatorio").select("stage", "scenario")), "stage")
    missing = needed.join(check.select("candidate_model_id", "scenario"), ["candidate_model_id", "scenario"], "left_anti").select(F.col("candidate_model_id").alias("_m")).distinct()
    return grouped.join(missing, F.col("candidate_model_id") == F.col("_m"), "left").withColumn("aprovado", ~F.col("_any") & F.col("_m").isNull()).drop("_any", "_m")


def promote(models: DataFrame, verdict: DataFrame, model_id: int, force_reason: str | None = None) -> tuple[DataFrame, str]:
    """Models after the promotion, and the decision: aprovado, sobreposto (forced with a reason) or reprovado (no change)."""
    row = verdict.filter(F.col("candidate_model_id") == model_id).select("aprovado").first()
    passed = bool(row and row[0])
    if not passed and not force_reason:
        return models, "reprovado"
    own = models.filter(F.col("model_id") == model_id).select(F.col("stage").alias("_s"), F.col("visao").alias("_v")).limit(1)
    joined = models.join(F.broadcast(own), (F.col("stage") == F.col("_s")) & F.col("visao").eqNullSafe(F.col("_v")), "left")
    status = (
        F.when(F.col("model_id") == model_id, "promoted")
        .when(F.col("_s").isNotNull() & (F.col("status") == "promoted") & (F.col("kind") != "decision_tree_surrogate"), "retired").otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("_s", "_v"), "aprovado" if passed else "sobreposto"


def evict(windows: DataFrame, chosen: DataFrame, reason: str, now: float) -> DataFrame:
    """Windows with the active ones of ``chosen`` (a table with ``window_id``) evicted."""
    marked = windows.join(chosen.select("window_id").distinct().withColumn("_hit", F.lit(True)), "window_id", "left")
    hit = (F.col("pool_state") == "active") & F.col("_hit").isNotNull()
    return marked.withColumns({
        "evicted_at": F.when(hit, F.lit(float(now))).otherwise(F.col("evicted_at")), "evicted_reason": F.when(hit, reason).otherwise(F.col("evicted_reason")),
        "pool_state": F.when(hit, "evicted").otherwise(F.col("pool_state")),
    }).drop("_hit")


def orphans(index: DataFrame, listing: DataFrame) -> DataFrame:
    """Index rows whose file is not in the listing."""
    return index.join(listing.select("path").distinct(), "path", "left_anti")


def keyed_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def next_request(requests: DataFrame) -> DataFrame:
    """The oldest pending request."""
    return requests.filter(F.col("state") == "pending").orderBy("requested_at", "request_id").limit(1)


def golden_coverage(scenarios: DataFrame, captures: DataFrame) -> DataFrame:
    """Captures and rows of each scenario, zero included."""
    n = captures.groupBy("scenario").agg(F.count("*").alias("n_capturas"), F.sum("n_rows").alias("n_linhas"))
    return scenarios.join(n, "scenario", "left").fillna(0, ["n_capturas", "n_linhas"])


def models_list(models: DataFrame, evaluations: DataFrame, verdict: DataFrame, limit: int = 20) -> DataFrame:
    """The newest models with their latest aggregate evaluation and gate verdict."""
    newest = evaluations.filter(F.col("scope") == "aggregate").groupBy("model_id").agg(F.max_by(F.struct("recall", "taxa_falso_positivo"), "evaluated_at").alias("e"))
    v = verdict.select(F.col("candidate_model_id").alias("model_id"), "aprovado")
    out = models.join(newest, "model_id", "left").join(v, "model_id", "left")
    return out.select("model_id", "stage", "kind", "visao", "status", "trained_at", "e.recall", "e.taxa_falso_positivo", "aprovado").orderBy(F.desc("trained_at"), "model_id").limit(limit)


def violations(windows: DataFrame, models: DataFrame, alerts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rule, n``: rows that break an invariant of the control tables."""
    count = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    doubles = models.filter((F.col("status") == "promoted") & (F.col("kind") != "decision_tree_surrogate")).groupBy("stage", "visao").count().filter("count > 1")
    forks = verdicts.filter("supersedes is not null").groupBy("supersedes").count().filter("count > 1")
    return (
        count(windows.filter("t_start >= t_end"), "window_order")
        .unionByName(count(windows.filter("(pool_state = 'evicted') <> (evicted_at is not null)"), "eviction_time"))
        .unionByName(count(doubles, "one_promoted")).unionByName(count(alerts.filter("percentile < 0 or percentile > 1"), "percentile_range"))
        .unionByName(count(forks, "linear_chain"))
    )


def ingest_volume(windows: DataFrame, floor: float = 0.95) -> DataFrame:
    """Per view and day: windows, rows, rows expected above the floor, bytes."""
    day = F.date_format(F.timestamp_seconds("t_start"), "yyyy-MM-dd")
    return windows.groupBy("visao", day.alias("dia")).agg(F.count("*").alias("n_janelas"), F.sum("n_rows").alias("fluxos_extraidos"), F.sum("parquet_bytes").alias("parquet_bytes")).withColumn(
        "linhas_previstas", F.round(F.col("fluxos_extraidos") * F.lit(1 - floor) + 1e-9).cast("long")
    )


def top_sources(alerts: DataFrame, k: int = 10) -> DataFrame:
    return alerts.groupBy("src_ip").agg(F.count("*").alias("alertas"), F.max("percentile").alias("max_percentil")).orderBy(F.desc("alertas"), "src_ip").limit(k)


def over_time(alerts: DataFrame, seconds: int, start: float, stop: float) -> DataFrame:
    """``t, total, ataques``: alerts by time step, steps without any included."""
    steps = alerts.sparkSession.range(int(start // seconds), int(stop // seconds) + 1).select((F.col("id") * seconds).alias("t"))
    counted = alerts.groupBy((F.floor(F.col("ts") / seconds) * seconds).alias("t")).agg(F.count("*").alias("total"), F.count_if(F.col("classificacao") == "ataque").alias("ataques"))
    return steps.join(counted, "t", "left").fillna(0, ["total", "ataques"])


def top_alerts(alerts: DataFrame, k: int = 8) -> DataFrame:
    """The alerts of the highest percentiles, with ``ends`` (null where a part of it is)."""
    ends = F.concat("src_ip", F.lit(" → "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string"))
    return alerts.withColumn("ends", ends).orderBy(F.desc("percentile"), "alert_id").limit(k)


def newer_than(df: DataFrame, ts: str, now: float, days: float) -> DataFrame:
    return df.filter(F.col(ts) > now - days * DAY)


def retained(df: DataFrame, ts: str, now: float, days: float = 180) -> DataFrame:
    """Rows that a retention of ``days`` leaves; written by day, older days are whole folders to delete."""
    return df.filter(F.col(ts) >= now - days * DAY)


def alerts_summary(alerts: DataFrame, by: list[str]) -> DataFrame:
    """``n, lowest, highest`` percentile and first and last time per group."""
    return alerts.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("percentile").alias("lowest"), F.max("percentile").alias("highest"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def of_latest_model(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of the model that was trained last."""
    newest = models.agg(F.max_by("model_id", "trained_at").alias("model_id"))
    return rows.join(F.broadcast(newest), "model_id", "left_semi")


def elapsed_hours(df: DataFrame, since: str, now: float) -> DataFrame:
    return df.withColumn("hours", (F.lit(float(now)) - F.col(since)) / 3600)


def stage2_training(alerts: DataFrame, verdicts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Alerts with a current verdict of attack or benign, as ``label`` 1 or 0, and a known scenario."""
    told = current_verdicts(verdicts).filter(F.col("veredito").isin("ataque", "benigno")).select("alert_id", (F.col("veredito") == "ataque").cast("int").alias("label"))
    return alerts.join(told, "alert_id").join(F.broadcast(scenarios), "scenario", "left_semi")


def held_out_confusion(judged: DataFrame, held_out) -> DataFrame:
    """``scenario, tp, fp, fn, tn`` over the rows that a stage-2 model was not fitted on."""
    return confusion(judged.filter(held_out), "label", "predicted", ["scenario"])


def matching_sets(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Rows with each model of their view and feature set; others are skipped."""
    return rows.join(F.broadcast(models.select("model_id", "visao", "feature_set")), ["visao", "feature_set"])


def with_feature_json(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, F.to_json(F.struct(*cols)))


def matching(df: DataFrame, equal: dict | None = None, since: tuple[str, float] | None = None, until: tuple[str, float] | None = None, among: dict | None = None) -> DataFrame:
    """Rows under optional filters: columns ``equal`` to values or ``among`` lists, a column from ``since`` on and before ``until``; None asks nothing."""
    for column, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    for column, values in (among or {}).items():
        if values is not None:
            df = df.filter(F.col(column).isin(list(values)))
    if since and since[1] is not None:
        df = df.filter(F.col(since[0]) >= F.lit(since[1]))
    if until and until[1] is not None:
        df = df.filter(F.col(until[0]) < F.lit(until[1]))
    return df

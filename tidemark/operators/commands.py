"""Commands of the lifecycle: each takes the control tables and returns the rows it would write.

Nothing is written here; ids, times and names are arguments, so a command that is repeated gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import json_number
from tidemark.operators import lifecycle as L
from tidemark.operators import models as M
from tidemark.operators.labels import label_flows

SURROGATE = "decision_tree_surrogate"


def pool_totals(windows: DataFrame) -> DataFrame:
    """``visao, n_active, n_evicted, rows_active`` of each view."""
    active = F.col("pool_state") == "active"
    return windows.groupBy("visao").agg(
        F.count_if(active).alias("n_active"), F.count_if(F.col("pool_state") == "evicted").alias("n_evicted"), F.coalesce(F.sum(F.when(active, F.col("n_rows"))), F.lit(0)).alias("rows_active")
    )


def candidate_windows(windows: DataFrame, visao: str, now: float, least: float = 0.05) -> DataFrame:
    """The windows a candidate of ``visao`` trains on, with ``peso``: out of quarantine, heavy enough, of the newest window's feature set."""
    return L.dominant_features(L.pool_weights(L.training_pool(windows, now), least).filter(F.col("visao") == visao))


def train_candidate(rows: DataFrame, windows: DataFrame, cols: Sequence[str], id_col: str, max_rows: int = 2_000_000, contamination: float = 0.03, trees: int = 200) -> dict:
    """A detector fitted on a sample of the chosen ``windows``, each row with the weight of its window.

    ``rows`` carry ``window_id``. Raises where no window is left.
    """
    if windows.isEmpty():
        raise ValueError("no window has left quarantine")
    sampled = L.sample_rows(rows, L.sample_allocation(windows, max_rows), id_col)
    weighed = sampled.join(F.broadcast(windows.select("window_id", "peso")), "window_id").select(id_col, "peso", *cols).persist()
    try:
        return M.detect(weighed, cols, id_col, contamination, trees, weight="peso")[1]
    finally:
        weighed.unpersist()


def judge_captures(rows: DataFrame, bundle: dict) -> DataFrame:
    """Golden ``rows`` (``scenario, capture, label``) with ``predicted`` by a bundle."""
    scored = M.score_forest(M.scaled(rows, bundle["scaler"]), bundle["forest"])
    return scored.withColumn("predicted", (F.col("score") >= bundle["threshold"]).cast("int"))


def candidate_rows(model_id: int, stage: int, visao: str, now: int, windows: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of a new candidate for the tables of models, provenance and evaluations."""
    spark = windows.sparkSession
    model = spark.createDataFrame([(model_id, stage, "isolation_forest", visao, "candidate", now)], "model_id int, stage int, kind string, visao string, status string, trained_at int")
    provenance = windows.select("window_id", F.lit(model_id).alias("model_id"), F.col("peso").alias("weight"))
    evaluations = L.golden_evaluation(judged).withColumns({"model_id": F.lit(model_id), "evaluated_at": F.lit(now)})
    return model, provenance, evaluations


def golden_captures(flows: DataFrame, schedule: DataFrame, capture: str, ts: str = "t0") -> DataFrame:
    """``flows`` cut by a schedule into ``capture, scenario, label``: those of each attack, and the benign rest as ``limpo``."""
    name = F.col("attack")
    return label_flows(flows, schedule, ts).withColumns(
        {"scenario": F.coalesce(name, F.lit("limpo")), "label": name.isNotNull().cast("int"), "capture": F.concat_ws("-", F.lit(capture), F.coalesce(name, F.lit("limpo")))}
    ).drop("attack")


def add_verdicts(verdicts: DataFrame, alerts: DataFrame, given: DataFrame) -> DataFrame:
    """Rows for ``given`` verdicts (``verdict_id, alert_id, veredito, classe, analista``; one of an alert at a time).

    Each carries a copy of its alert's ``ts, score, percentile`` and, in ``supersedes``, the verdict that was
    current. Verdicts on unknown alerts give no row.
    """
    snapshot = alerts.select("alert_id", F.col("ts").alias("alert_ts"), "score", "percentile")
    current = L.current_verdicts(verdicts).select("alert_id", F.col("verdict_id").alias("supersedes"))
    return given.join(snapshot, "alert_id").join(current, "alert_id", "left")


def start_request(requests: DataFrame, now: float) -> DataFrame:
    """``requests`` with the oldest pending one running since ``now``; all as they were where none is pending."""
    picked = L.next_request(requests).select(F.col("request_id").alias("_r"))
    hit = F.col("_r").isNotNull()
    return requests.join(F.broadcast(picked), F.col("request_id") == F.col("_r"), "left").withColumns(
        {"state": F.when(hit, "running").otherwise(F.col("state")), "started_at": F.when(hit, F.lit(float(now)))}
    ).drop("_r")


def finish_request(requests: DataFrame, now: float, error: str | None = None) -> DataFrame:
    """``requests`` with the running ones done, or failed where there is an ``error``."""
    hit = F.col("state") == "running"
    return requests.withColumns({
        "finished_at": F.when(hit, F.lit(float(now))), "erro": F.when(hit, F.lit(error).cast("string")),
        "state": F.when(hit, "done" if error is None else "failed").otherwise(F.col("state")),
    })


def adopt(models: DataFrame, made: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """Models with the one row of ``made`` promoted in place of the live one of its stage and view, and the decision row."""
    own = made.select(F.col("model_id").alias("_m"), F.col("stage").alias("_s"), F.col("visao").alias("_v"))
    same = (F.col("stage") == F.col("_s")) & F.col("visao").eqNullSafe(F.col("_v"))
    joined = models.join(F.broadcast(own), same & (F.col("status") == "promoted") & (F.col("kind") != SURROGATE), "left")
    after = joined.withColumn("status", F.when(F.col("_m").isNotNull(), "retired").otherwise(F.col("status"))).drop("_m", "_s", "_v")
    live = joined.filter(F.col("_m").isNotNull()).groupBy("_m").agg(F.max("model_id").alias("incumbent_model_id"))
    decision = own.join(live, "_m", "left").select(F.col("_m").alias("candidate_model_id"), "incumbent_model_id", F.lit("adotado").alias("decisao"), F.lit(by).alias("decided_by"))
    return after.unionByName(made.withColumn("status", F.lit("promoted"))), decision


def reconcile(index: DataFrame, provenance: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and provenance without the windows whose file is gone."""
    gone = L.orphans(index, listing).select("window_id")
    return index.join(gone, "window_id", "left_anti"), provenance.join(gone, "window_id", "left_anti")


def predict_stage2(alerts: DataFrame, assignments: DataFrame, model_id: int, model: M.Linear, axes: Sequence[Sequence[float]], first_id: int, now: float, limit: int | None = None) -> DataFrame:
    """Assignment rows of a stage-2 model for alerts that it has not judged; features are read from the alert's JSON, 0 where missing."""
    todo = L.unscored_alerts(alerts, assignments, model_id, limit)
    read = todo.select("alert_id", "ts", *[json_number("features", c).alias(c) for c in model.cols])
    placed = M.project(M.decide(read, model), model.cols, axes, model.means)
    return placed.select(
        (F.lit(first_id) + F.col("alert_id")).alias("assignment_id"), "alert_id", "ts", F.lit(model_id).cast("long").alias("model_id"), F.lit(float(now)).alias("created_at"),
        "decision_value", "margin", "predicted", F.lit("pending").alias("state"), "coord_x", "coord_y",
    )

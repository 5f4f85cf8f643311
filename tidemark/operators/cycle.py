"""The lifecycle's chains over a store of control tables: pool to candidate to gate, adoption, and stage 2.

A chain writes its tables and model files below new folders first and then one pointer that names them all, so a
reader sees a state before or after a chain, never between, and a chain that was broken off can be run again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.functions.scalars import json_number
from tidemark.operators import commands as C
from tidemark.operators import explore, stats, subspace
from tidemark.operators import lifecycle as L
from tidemark.operators import models as M
from tidemark.operators.windows import pool_windows
from tidemark.staging import forget, staged

# The columns of the control tables that chains write.
SCHEMAS = {
    "models": "model_id long, stage int, kind string, visao string, status string, trained_at double, promoted_at double, retired_at double, artifact_path string",
    "provenance": "model_id long, window_id string, weight double",
    "evaluations": "model_id long, scope string, scenario string, capture string, n long, n_ataque_real long, tp long, fp long, fn long, tn long, recall double, precisao double, taxa_falso_positivo double, evaluated_at double",
    "promotions": "candidate_model_id long, incumbent_model_id long, decisao string, gate_report string, motivo string, decided_by string, decided_at double",
    "assignments": "assignment_id long, alert_id long, ts double, model_id long, created_at double, decision_value double, margin double, predicted string, state string, coord_x double, coord_y double",
    "windows": sinks.INDEX,
}


class Store:
    """Control tables below ``path``: each commit is a folder with the tables it changes and a pointer to those of all tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointers(self) -> DataFrame:
        return sinks.read_or_empty(self.spark, f"{self.path}/pointers/*", "version long, tables string")

    def version(self) -> int:
        """The number of commits so far."""
        return self._pointers().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def places(self) -> dict[str, str]:
        row = self._pointers().agg(F.max_by("tables", "version")).first()
        return json.loads(row[0]) if row[0] else {}

    def read(self, table: str) -> DataFrame:
        """The table as of the newest commit; empty where none wrote it."""
        place = self.places().get(table)
        empty = self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(empty.schema).parquet(place) if place else empty

    def folder(self, version: int) -> str:
        return f"{self.path}/commits/v={version}"

    def commit(self, changes: dict[str, DataFrame], version: int | None = None) -> int:
        """Write ``changes`` and then the pointer to them; fails where another writer has got ahead of ``version``."""
        version = self.version() + 1 if version is None else version
        places = self.places()
        for table, rows in changes.items():
            names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
            missing = {n: F.lit(None) for n in names if n not in rows.columns}
            shaped = rows.withColumns(missing).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in SCHEMAS[table].split(", ")])
            places[table] = f"{self.folder(version)}/{table}"
            shaped.write.mode("overwrite").parquet(places[table])
        pointer = self.spark.createDataFrame([(version, json.dumps(places))], "version long, tables string")
        pointer.coalesce(1).write.mode("error").parquet(f"{self.path}/pointers/v={version}")
        return version


def _evaluation_rows(judged: DataFrame, model_id: int, now: float) -> DataFrame:
    return L.golden_evaluation(judged).withColumns({
        "model_id": F.lit(model_id), "evaluated_at": F.lit(float(now)), "n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), "n_ataque_real": F.col("tp") + F.col("fn")
    })


def _next_id(models: DataFrame) -> int:
    return models.agg(F.coalesce(F.max("model_id"), F.lit(0))).first()[0] + 1


def _model_row(spark: SparkSession, model_id: int, stage: int, kind: str, visao: str | None, status: str, now: float, place: str) -> DataFrame:
    promoted = float(now) if status == "promoted" else None
    return spark.createDataFrame([(model_id, stage, kind, visao, status, float(now), promoted, None, place)], SCHEMAS["models"])


def _retired(models: DataFrame, stage: int, visao: str | None, now: float) -> tuple[DataFrame, int | None]:
    """Models with the promoted one of a stage and view retired, and its id."""
    live = (F.col("stage") == stage) & F.col("visao").eqNullSafe(F.lit(visao)) & (F.col("status") == "promoted") & (F.col("kind") != C.SURROGATE)
    old = models.filter(live).agg(F.max("model_id")).first()[0]
    return models.withColumns({"retired_at": F.when(live, F.lit(float(now))).otherwise(F.col("retired_at")), "status": F.when(live, "retired").otherwise(F.col("status"))}), old


def make_candidate(
    store: Store, rows: DataFrame, windows: DataFrame, golden: DataFrame, floors: DataFrame, cols: Sequence[str], id_col: str, visao: str, now: float,
    least: float = 0.05, max_rows: int = 2_000_000, contamination: float = 0.03, trees: int = 200,
) -> tuple[int, DataFrame, DataFrame]:
    """From the pool to the gate: a detector trained on weighted windows, judged on golden rows and registered; its id, gate rows and verdict.

    ``rows`` carry ``window_id`` and ``cols``, ``golden`` has ``scenario, capture, label`` and ``cols``.
    """
    spark = rows.sparkSession
    version = store.version() + 1
    chosen = C.candidate_windows(windows, visao, now, least)
    bundle = C.train_candidate(rows, chosen, cols, id_col, max_rows, contamination, trees)
    models = store.read("models")
    model_id = _next_id(models)
    place = f"{store.folder(version)}/model-{model_id}"
    sinks.write_bundle(spark, bundle, place)
    store.commit({
        "models": models.unionByName(_model_row(spark, model_id, 1, "isolation_forest", visao, "candidate", now, place)),
        "provenance": store.read("provenance").unionByName(chosen.select(F.lit(model_id).cast("long").alias("model_id"), "window_id", F.col("peso").alias("weight"))),
        "evaluations": store.read("evaluations").unionByName(_evaluation_rows(C.judge_captures(golden, bundle), model_id, now), allowMissingColumns=True),
    }, version)
    check = L.gate_check(store.read("models"), store.read("evaluations"), floors)
    return model_id, check.filter(F.col("candidate_model_id") == model_id), L.gate_verdict(check, floors).filter(F.col("candidate_model_id") == model_id)


def promote_candidate(store: Store, floors: DataFrame, model_id: int, by: str, now: float, force_reason: str | None = None) -> str:
    """Promote a candidate that passes the gate, or one that doesn't with a reason; the decision, with the gate's rows as its report."""
    models = store.read("models")
    check = L.gate_check(models, store.read("evaluations"), floors).filter(F.col("candidate_model_id") == model_id)
    verdict = L.gate_verdict(check, floors).select("aprovado").first()
    own = models.filter(F.col("model_id") == model_id).select("stage", "visao").first()
    passed = bool(verdict and verdict["aprovado"])
    decision = "aprovado" if passed else "sobreposto" if force_reason else "reprovado"
    report = json.dumps([r.asDict() for r in check.orderBy("scenario").collect()])
    after, old = _retired(models, own["stage"], own["visao"], now) if decision != "reprovado" else (models, None)
    if decision != "reprovado":
        hit = F.col("model_id") == model_id
        after = after.withColumns({"status": F.when(hit, "promoted").otherwise(F.col("status")), "promoted_at": F.when(hit, F.lit(float(now))).otherwise(F.col("promoted_at"))})
    store.commit({"models": after, "promotions": store.read("promotions").unionByName(_decision(store.spark, model_id, old, decision, report, force_reason, by, now))})
    return decision


def _decision(spark: SparkSession, model_id: int, old: int | None, decision: str, report: str, why: str | None, by: str, now: float) -> DataFrame:
    return spark.createDataFrame([(model_id, old, decision, report, why, by, float(now))], SCHEMAS["promotions"])


def adopt_bundle(
    store: Store, bundle: dict, rows: DataFrame, golden: DataFrame, contract: Sequence[str], id_col: str, visao: str, by: str, now: float,
    why: str = "seed model", seconds: int = 780, seed_pool: bool = True,
) -> int:
    """Promote a detector that was trained elsewhere, as a start: its id.

    The bundle's columns must be the ``contract``. A reference grid is made from ``rows`` (``t0, sensor`` and the
    columns), which also seed the pool, each window with weight 1; the golden rows give evaluations, without which later
    candidates have nothing to be compared with; the live model of the view retires.
    """
    lacking = [k for k in ("forest", "scaler", "threshold", "cols", "tree") if k not in bundle]
    if lacking:
        raise ValueError(f"the bundle lacks {lacking}")
    if list(bundle["cols"]) != list(contract):
        raise ValueError("the bundle was trained on other columns; train it anew")
    spark = rows.sparkSession
    version = store.version() + 1
    scored = M.score_forest(M.scaled(rows, bundle["scaler"]), bundle["forest"]).withColumn("_one", F.lit(1.0))
    grid = [(r["pct"], r["score"]) for r in stats.weighted_quantiles(scored.select(id_col, "score", "_one"), "score", "_one", id_col).orderBy("k").collect()]
    models = store.read("models")
    model_id = _next_id(models)
    place = f"{store.folder(version)}/model-{model_id}"
    sinks.write_bundle(spark, bundle | {"grid": grid}, place)
    after, old = _retired(models, 1, visao, now)
    changes = {
        "models": after.unionByName(_model_row(spark, model_id, 1, "isolation_forest", visao, "promoted", now, place)),
        "evaluations": store.read("evaluations").unionByName(_evaluation_rows(C.judge_captures(golden, bundle), model_id, now), allowMissingColumns=True),
        "promotions": store.read("promotions").unionByName(_decision(spark, model_id, old, "adotado", "{}", why, by, now)),
    }
    if seed_pool:
        held = pool_windows(rows, visao, seconds).withColumn("visao", F.lit(visao)).select("window_id", "sensor", "visao", "bucket", "t0", *contract)
        sinks.write_pool(held, f"{store.path}/pool", seconds)
        known = sinks.read_or_empty(spark, f"{store.path}/pool/index", sinks.INDEX)
        own = held.select("window_id").distinct()
        changes["windows"] = known
        changes["provenance"] = store.read("provenance").unionByName(own.select(F.lit(model_id).cast("long").alias("model_id"), "window_id", F.lit(1.0).alias("weight")))
    store.commit(changes, version)
    return model_id


def stage2_labels(golden: DataFrame, alerts: DataFrame, verdicts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``id, label, scenario, origem`` and ``cols``: golden rows, and alerts with a current verdict of attack or benign.

    ``golden`` has ``id, label, scenario``; an alert's columns are read from its JSON, 0 where missing.
    """
    told = L.current_verdicts(verdicts).filter(F.col("veredito").isin("ataque", "benigno")).select("alert_id", (F.col("veredito") == "ataque").cast("int").alias("label"))
    judged = alerts.join(told, "alert_id").select(F.col("alert_id").alias("id"), "label", F.lit("verdict").alias("scenario"), F.lit("verdict").alias("origem"), *[json_number("features", c).alias(c) for c in cols])
    return golden.select("id", "label", "scenario", F.lit("golden").alias("origem"), *[F.col(c).cast("double").alias(c) for c in cols]).unionByName(judged)


def train_stage2(store: Store, labelled: DataFrame, cols: Sequence[str], visao: str, now: float, scenarios: DataFrame, test_percent: int = 30) -> tuple[int, M.Linear, subspace.Axes]:
    """A linear SVM candidate: evaluated on a held-out part of every class, then fitted on all labels; its id, the model and two axes.

    The split is one for both origins. Evaluations are of all held-out rows and per scenario that is known.
    """
    spark = labelled.sparkSession
    classes = {r["label"] for r in labelled.select("label").distinct().collect()}
    if classes != {0, 1}:
        raise ValueError("labels of both classes are needed")
    # Fits and evaluations read the split some ten times.
    split, kept_at = staged(explore.stratified_split(labelled, "label", "id", test_percent), "labels")
    trial = M.fit_svm(split.filter("not is_test"), cols, "label")
    held = M.decide(split.filter("is_test"), trial).withColumn("predicted", (F.col("predicted") == "ataque").cast("int"))
    final = M.fit_svm(split, cols, "label")
    axes = subspace.fit_axes(split, cols)
    models = store.read("models")
    model_id = _next_id(models)
    version = store.version() + 1
    place = f"{store.folder(version)}/model-{model_id}"
    body = json.dumps({"cols": final.cols, "weights": final.weights, "means": final.means, "spreads": final.spreads, "bias": final.bias, "axes": [list(a) for a in axes.loadings[:2]], "axis_means": axes.means, "axis_spreads": axes.spreads})
    spark.createDataFrame([(body,)], "body string").coalesce(1).write.mode("overwrite").parquet(place)
    every = _evaluation_rows(held.withColumn("capture", F.lit(None).cast("string")), model_id, now)
    known = every.join(F.broadcast(scenarios.select("scenario").withColumn("_known", F.lit(True))), "scenario", "left")
    kept = known.filter((F.col("scope") == "aggregate") | ((F.col("scope") == "scenario") & F.col("_known"))).drop("_known")
    store.commit({
        "models": models.unionByName(_model_row(spark, model_id, 2, "linear_svm", visao, "candidate", now, place)),
        "evaluations": store.read("evaluations").unionByName(kept, allowMissingColumns=True),
    }, version)
    forget(spark, kept_at)
    return model_id, final, axes


def promote_stage2(store: Store, model_id: int, by: str, now: float, why: str = "stage 2, first labels") -> None:
    """Put a stage-2 model into production in place of the live one of its view; marked as adopted, as no gate judged it."""
    models = store.read("models")
    own = models.filter((F.col("model_id") == model_id) & (F.col("stage") == 2)).select("visao", "status").first()
    if own is None or own["status"] == "promoted":
        raise ValueError("no stage-2 model of this id waits for promotion")
    after, old = _retired(models, 2, own["visao"], now)
    hit = F.col("model_id") == model_id
    after = after.withColumns({"status": F.when(hit, "promoted").otherwise(F.col("status")), "promoted_at": F.when(hit, F.lit(float(now))).otherwise(F.col("promoted_at"))})
    store.commit({"models": after, "promotions": store.read("promotions").unionByName(_decision(store.spark, model_id, old, "adotado", "{}", why, by, now))})


def load_stage2(store: Store, visao: str) -> tuple[int, M.Linear, list[list[float]], list[float]]:
    """The promoted stage-2 model of a view: id, model, axes on raw columns and their means."""
    row = store.read("models").filter((F.col("stage") == 2) & (F.col("status") == "promoted") & F.col("visao").eqNullSafe(F.lit(visao))).select("model_id", "artifact_path").first()
    if row is None:
        raise ValueError(f"no stage-2 model of {visao} is promoted")
    body = json.loads(store.spark.read.parquet(row["artifact_path"]).first()["body"])
    axes = [[v / s for v, s in zip(axis, body["axis_spreads"])] for axis in body["axes"]]
    return row["model_id"], M.Linear(body["cols"], body["weights"], body["means"], body["spreads"], body["bias"]), axes, body["axis_means"]


def predict_pending(store: Store, alerts: DataFrame, visao: str, now: float, limit: int | None = None) -> int:
    """Assignments of the promoted stage-2 model for alerts that it has not judged (newest first up to ``limit``); how many."""
    model_id, model, axes, means = load_stage2(store, visao)
    old = store.read("assignments")
    todo = L.unscored_alerts(alerts.filter(F.col("visao") == visao), old, model_id, limit)
    read = todo.select("alert_id", "ts", *[json_number("features", c).alias(c) for c in model.cols])
    placed = M.project(M.decide(read, model), model.cols, axes, means)
    first = old.agg(F.coalesce(F.max("assignment_id"), F.lit(0))).first()[0] + 1
    made = placed.select(
        (F.lit(first) + F.col("alert_id")).alias("assignment_id"), "alert_id", "ts", F.lit(model_id).alias("model_id"), F.lit(float(now)).alias("created_at"), "decision_value", "margin", "predicted",
        F.lit("pending").alias("state"), "coord_x", "coord_y",
    )
    store.commit({"assignments": old.unionByName(made)})
    return store.read("assignments").filter(F.col("model_id") == model_id).count()

"""Invariants of the control tables as declared rules: one pass per table for row rules, one grouping per key.

As in SQL, a row rule is broken where it is false, not where it is null, and a key with a null part is never a
double. Rules that name a column which a table lacks have a null count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Row:
    """``holds`` is a SQL condition on one row."""

    name: str
    holds: str


@dataclass(frozen=True)
class Key:
    """No two of the rows ``where`` agree in the expressions ``parts``."""

    name: str
    parts: tuple[str, ...]
    where: str = "true"


@dataclass(frozen=True)
class Link:
    """Every non-null ``column`` is a ``target`` of another table."""

    name: str
    column: str
    table: str
    target: str


_VIEW, _LABEL = "visao IN ('flow', 'host')", "label IN (0, 1)"
# The invariants of the control tables.
RULES: dict[str, tuple] = {
    "parameters": (Row("value_type", "value_type IN ('number', 'integer', 'boolean', 'string')"), Key("parameter_key", ("key",))),
    "windows": (
        Row("window_view", _VIEW), Row("window_rows", "n_rows >= 0"), Row("window_extractor", "extractor IN ('nfstream', 'scapy', 'streaming')"),
        Row("window_state", "pool_state IN ('active', 'evicted')"), Row("window_order", "t_end > t_start"), Row("eviction_time", "(pool_state = 'evicted') = (evicted_at IS NOT NULL)"),
        Row("eviction_reason", "pool_state <> 'evicted' OR evicted_reason IS NOT NULL"), Key("window_key", ("window_id",)), Key("window_path", ("path",)),
    ),
    "models": (
        Row("model_stage", "stage IN (1, 2)"),
        Row("model_kind", "kind IN ('isolation_forest', 'decision_tree_surrogate', 'kmeans', 'dbscan', 'hdbscan', 'linear_svm', 'svm_rbf', 'one_class_svm', 'logistic_regression')"),
        Row("model_view", _VIEW), Row("model_status", "status IN ('candidate', 'shadow', 'promoted', 'retired', 'rejected')"),
        Row("surrogate_explains", "(kind = 'decision_tree_surrogate') = (explains_model_id IS NOT NULL)"), Row("promotion_time", "status <> 'promoted' OR promoted_at IS NOT NULL"),
        Row("retirement_time", "status <> 'retired' OR retired_at IS NOT NULL"), Key("model_key", ("model_id",)), Key("model_path", ("artifact_path",)),
        Key("one_promoted", ("stage", "coalesce(visao, '')"), "status = 'promoted' AND kind <> 'decision_tree_surrogate'"),
    ),
    "provenance": (Row("provenance_weight", "weight > 0"), Key("provenance_key", ("model_id", "window_id")), Link("provenance_model", "model_id", "models", "model_id"), Link("provenance_window", "window_id", "windows", "window_id")),
    "floors": (Row("floor_stage", "stage IN (1, 2)"), Row("floor_range", "recall_minimo BETWEEN 0 AND 1"), Key("floor_key", ("stage", "scenario")), Link("floor_scenario", "scenario", "scenarios", "scenario")),
    "captures": (Row("capture_label", _LABEL), Row("capture_view", _VIEW), Row("capture_rows", "n_rows >= 0"), Key("capture_key", ("capture",)), Key("capture_path", ("parquet_path",)), Link("capture_scenario", "scenario", "scenarios", "scenario")),
    "evaluations": (
        Row("evaluation_scope", "scope IN ('aggregate', 'scenario', 'capture')"), Row("evaluation_size", "n >= 0"), Row("scenario_named", "scope <> 'scenario' OR scenario IS NOT NULL"),
        Row("capture_named", "scope <> 'capture' OR capture IS NOT NULL"), Row("aggregate_unnamed", "scope <> 'aggregate' OR (scenario IS NULL AND capture IS NULL)"),
        Key("one_evaluation", ("model_id", "scope", "coalesce(scenario, '')", "coalesce(capture, '')")), Link("evaluation_model", "model_id", "models", "model_id"),
    ),
    "promotions": (Row("decision_word", "decisao IN ('aprovado', 'reprovado', 'sobreposto', 'adotado')"), Row("override_reason", "decisao <> 'sobreposto' OR motivo IS NOT NULL")),
    "alerts": (
        Row("alert_view", _VIEW), Row("source_port", "src_port BETWEEN 0 AND 65535"), Row("target_port", "dst_port BETWEEN 0 AND 65535"), Row("percentile_range", "percentile BETWEEN 0 AND 1"),
        Row("replay_label", "label_cic IN (0, 1)"), Key("alert_key", ("ts", "alert_id")),
    ),
    "verdicts": (
        Row("verdict_word", "veredito IN ('ataque', 'benigno', 'indeterminado')"), Row("confidence_range", "confianca BETWEEN 1 AND 5"), Row("no_self_chain", "verdict_id <> supersedes"),
        Key("verdict_key", ("verdict_id",)), Key("linear_chain", ("supersedes",)), Link("chain_target", "supersedes", "verdicts", "verdict_id"),
    ),
    "assignments": (
        Row("predicted_word", "predicted IN ('ataque', 'benigno')"), Row("assignment_state", "state IN ('pending', 'in_review', 'done', 'skipped')"),
        Row("closing_time", "(state IN ('done', 'skipped')) = (closed_at IS NOT NULL)"), Key("assignment_key", ("assignment_id",)), Key("one_assignment", ("alert_id", "model_id")),
    ),
    "requests": (
        Row("request_stage", "stage IN (1, 2)"), Row("request_view", _VIEW), Row("request_origin", "origem IN ('analista', 'agendado', 'despejo')"),
        Row("request_state", "state IN ('pending', 'running', 'done', 'failed', 'cancelled')"), Row("failure_reason", "state <> 'failed' OR erro IS NOT NULL"),
        Row("finish_time", "(state IN ('done', 'failed', 'cancelled')) = (finished_at IS NOT NULL)"), Key("request_key", ("request_id",)),
        Key("one_pending", ("stage", "coalesce(visao, '')"), "state IN ('pending', 'running')"),
    ),
}


def _known(df: DataFrame, *expressions: str) -> bool:
    """Whether every expression reads columns of ``df`` only."""
    try:
        df.select(*[F.expr(e) for e in expressions]).schema  # noqa: B018
    except Exception as error:
        if "UNRESOLVED_COLUMN" not in str(error):
            raise
        return False
    return True


def broken_rows(df: DataFrame, table: str) -> DataFrame:
    """``df`` with ``broken``, the names of the row rules of ``table`` that each row breaks; rows that break none are left out."""
    marks = [F.when(~F.expr(r.holds), F.lit(r.name)) for r in RULES[table] if isinstance(r, Row) and _known(df, r.holds)]
    return df.withColumn("broken", F.array_compact(F.array(*marks).cast("array<string>"))).filter(F.size("broken") > 0)


def doubles(df: DataFrame, key: Key) -> DataFrame:
    """``part_0, ..., n`` of the keys that more than one row has."""
    parts = [F.expr(p).alias(f"part_{i}") for i, p in enumerate(key.parts)]
    held = df.filter(key.where).select(*parts).dropna()
    return held.groupBy(*held.columns).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(df: DataFrame, link: Link, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows whose ``column`` is no ``target``."""
    known = tables[link.table].select(F.col(link.target).alias("_target")).distinct()
    return df.filter(F.col(link.column).isNotNull()).join(known, F.col(link.column) == F.col("_target"), "left_anti")


def violations(tables: dict[str, DataFrame]) -> DataFrame:
    """``rule, n`` over the given tables: rows that break a row rule, keys held by several rows, links without a target."""
    out = None
    for table, df in tables.items():
        own = RULES.get(table, ())
        rows = [r for r in own if isinstance(r, Row)]
        fine = [r for r in rows if _known(df, r.holds)]
        made = []
        if fine:
            one = df.agg(*[F.count_if(~F.expr(r.holds)).alias(r.name) for r in fine])
            made.append(one.select(F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("n")) for r in fine])).alias("x")).select("x.rule", "x.n"))
        count = lambda found, name: found.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        for rule in own:
            if isinstance(rule, Key) and _known(df, *rule.parts, rule.where):
                made.append(count(doubles(df, rule), rule.name))
            elif isinstance(rule, Link) and rule.table in tables and _known(df, rule.column) and _known(tables[rule.table], rule.target):
                made.append(count(dangling(df, rule, tables), rule.name))
            elif rule not in fine:
                made.append(df.sparkSession.createDataFrame([(rule.name, None)], "rule string, n long"))
        for part in made:
            out = part if out is None else out.unionByName(part)
    return out

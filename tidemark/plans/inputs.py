"""Input tables of the registered queries, derived from ``events`` and ``labels`` in SQL that both engines read.

``@MICROS`` (epoch microseconds of ``ts``) and ``@K`` (the JSON number of ``props``) are the two
places where the dialects differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600  # 2024-02-01
SECONDS = 780

_VIEWS = {
    "packets": (("events",), """
        SELECT event_id, user_id, event_type, value, @MICROS / 1e6 AS ts,
               CASE WHEN event_id % 2 = 0 THEN '10.0.0.' || CAST(user_id AS STRING) ELSE '10.1.0.' || CAST(@K % 10 AS STRING) END AS src,
               CASE WHEN event_id % 2 = 0 THEN '10.1.0.' || CAST(@K % 10 AS STRING) ELSE '10.0.0.' || CAST(user_id AS STRING) END AS dst,
               CAST(6 AS INT) AS proto, value AS length,
               CAST(CASE WHEN event_id % 2 = 0 THEN 40000 + user_id ELSE 443 END AS INT) AS sport,
               CAST(CASE WHEN event_id % 2 = 0 THEN 443 ELSE 40000 + user_id END AS INT) AS dport,
               CASE event_type WHEN 'signup' THEN 'S' WHEN 'view' THEN 'A' WHEN 'click' THEN 'PA' WHEN 'purchase' THEN 'FA' ELSE 'R' END AS flags,
               's' || CAST(user_id % 3 AS STRING) AS sensor
        FROM events"""),
    "alerts": (("packets",), """
        SELECT event_id AS alert_id, ts, sensor, 'flow' AS visao, src AS src_ip, dst AS dst_ip, dport AS dst_port, proto,
               value / (value + 1e2) AS score, CAST((event_id * 7919) % 10007 AS DOUBLE) / 10006e0 AS percentile
        FROM packets WHERE (event_id * 7919) % 10007 >= 9006"""),
    "verdicts": (("alerts",), """
        SELECT alert_id * 2 AS verdict_id, alert_id, CASE WHEN alert_id % 5 < 2 THEN 'ataque' WHEN alert_id % 5 < 4 THEN 'benigno' ELSE 'inconclusivo' END AS veredito,
               'c' || CAST(alert_id % 4 AS STRING) AS classe, 'a' || CAST(alert_id % 2 AS STRING) AS analista, CAST(NULL AS BIGINT) AS supersedes
        FROM alerts WHERE alert_id % 3 <> 0
        UNION ALL
        SELECT alert_id * 2 + 1, alert_id, CASE WHEN alert_id % 5 < 2 THEN 'benigno' ELSE 'ataque' END, 'd', 'a9', alert_id * 2
        FROM alerts WHERE alert_id % 6 = 1"""),
    "assignments": (("alerts",), """
        SELECT alert_id * 2 + n AS assignment_id, alert_id, ts, n AS model_id, ts + n AS created_at, d AS decision_value, abs(d) AS margin,
               CASE WHEN d > 0e0 THEN 'ataque' ELSE 'benigno' END AS predicted, CASE WHEN alert_id % 3 = 0 THEN 'pending' ELSE 'reviewed' END AS state,
               CASE WHEN alert_id % 7 <> 0 THEN d * 2e0 END AS coord_x, d + 1e0 AS coord_y
        FROM (SELECT alert_id, ts, n, CAST((alert_id * 104729 * n) % 2001 - 1000 AS DOUBLE) / 5e2 AS d
              FROM alerts JOIN (SELECT CAST(1 AS BIGINT) AS n UNION ALL SELECT CAST(2 AS BIGINT)) two ON n = 1 OR alert_id % 5 = 0 WHERE alert_id % 4 <> 0) made"""),
    "windows": (("packets",), """
        SELECT CAST(b AS STRING) || '-' || sensor AS window_id, sensor, CASE WHEN sensor = 's0' THEN 'host' ELSE 'flow' END AS visao, b AS bucket,
               b * 780 AS t_start, (b + 1) * 780 AS t_end, n_rows, n_rows * 100 AS parquet_bytes,
               CASE WHEN b % 10 = 0 THEN 'flow-v2' ELSE 'flow-v1' END AS feature_set, CASE WHEN b % 7 = 0 THEN 'evicted' ELSE 'active' END AS pool_state,
               CASE WHEN b % 7 = 0 THEN CAST((b + 500) * 780 AS DOUBLE) END AS evicted_at, CASE WHEN b % 7 = 0 THEN 'drift' END AS evicted_reason,
               'pool/' || CAST(b AS STRING) || '-' || sensor AS path
        FROM (SELECT sensor, CAST(floor(ts / 780e0) AS BIGINT) AS b, count(*) AS n_rows FROM packets GROUP BY 1, 2) g"""),
    "models": (("events",), """
        SELECT CAST(g + 1 AS INT) AS model_id, stage, CASE WHEN g = 6 THEN 'decision_tree_surrogate' WHEN stage = 1 THEN 'isolation_forest' ELSE 'linear_svm' END AS kind,
               CASE WHEN stage = 1 THEN CASE WHEN g % 10 = 9 THEN 'host' ELSE 'flow' END END AS visao,
               CASE WHEN g IN (0, 2, 6) THEN 'promoted' WHEN g = 4 THEN 'retired' WHEN g IN (1, 3, 7) THEN 'candidate' WHEN g = 5 THEN 'shadow'
                    WHEN g % 3 = 0 THEN 'candidate' WHEN g % 3 = 1 THEN 'retired' ELSE 'shadow' END AS status, CAST(top AS INT) AS trained_at
        FROM (SELECT user_id % 64 AS g, CAST(CASE WHEN user_id % 64 IN (2, 3, 5) OR (user_id % 64 > 7 AND user_id % 2 = 0) THEN 2 ELSE 1 END AS INT) AS stage, max(event_id) AS top FROM events GROUP BY 1, 2) grouped"""),
    "provenance": (("windows",), "SELECT window_id, CAST(bucket % 6 + 1 AS INT) AS model_id, 1e0 AS weight FROM windows"),
    "tried": (("judged", "models"), """
        SELECT model_id, stage, doc_id, label, CASE WHEN label = 0 AND doc_id % 4 = 0 THEN 'benigno' WHEN doc_id % 3 = 0 THEN 'recon' ELSE 'brute_force' END AS scenario,
               CASE WHEN label = 1 AND (doc_id * 31 + model_id * 17) % 100 >= model_id % 25 THEN 1 WHEN label = 0 AND (doc_id * 13 + model_id * 7) % 100 < model_id % 4 THEN 1 ELSE 0 END AS predicted
        FROM (SELECT doc_id, label, 1 AS one FROM judged) j JOIN (SELECT model_id, stage, 1 AS one FROM models) m ON j.one = m.one"""),
    "evaluations": (("tried",), """
        SELECT model_id, 'scenario' AS scope, scenario, CAST(sum(label * predicted) AS DOUBLE) / nullif(CAST(sum(label) AS DOUBLE), 0e0) AS recall,
               CAST(sum((1 - label) * predicted) AS DOUBLE) / nullif(CAST(sum(1 - label) AS DOUBLE), 0e0) AS taxa_falso_positivo, 2 AS evaluated_at
        FROM tried GROUP BY model_id, scenario
        UNION ALL
        SELECT model_id, 'aggregate', CAST(NULL AS STRING), CAST(sum(label * predicted) AS DOUBLE) / nullif(CAST(sum(label) AS DOUBLE), 0e0),
               CAST(sum((1 - label) * predicted) AS DOUBLE) / nullif(CAST(sum(1 - label) AS DOUBLE), 0e0), CAST(part AS INT)
        FROM (SELECT model_id, label, predicted, 2 AS part FROM tried UNION ALL SELECT model_id, label, predicted, 1 FROM tried WHERE doc_id % 2 = 0) halves GROUP BY model_id, part"""),
    "floors": (("tried",), """
        SELECT stage, scenario, CASE WHEN scenario <> 'benigno' THEN CASE WHEN stage = 1 THEN 0.8e0 ELSE 0.85e0 END END AS recall_minimo, stage = 2 OR scenario = 'benigno' AS obrigatorio
        FROM (SELECT DISTINCT stage, scenario FROM tried WHERE stage = 1 OR scenario <> 'benigno') known"""),
    "scenarios": ((), "SELECT scenario FROM (VALUES ('s0'), ('s1'), ('s2'), ('s3'), ('none')) AS t(scenario)"),
    "judged": (("labels",), """
        SELECT doc_id, 's' || CAST(doc_id % 4 AS STRING) AS scenario, 'c' || CAST(doc_id % 8 AS STRING) AS capture, toxic AS label, 1 - quality AS predicted,
               CAST((doc_id * 7919) % 101 AS DOUBLE) / 1e2 + toxic * 0.25e0 AS score
        FROM labels"""),
    "captures": (("judged",), "SELECT capture, scenario, count(*) AS n_rows FROM judged GROUP BY 1, 2"),
    "history": (("events",), """
        SELECT 'p' || CAST(user_id % 5 AS STRING) AS key, event_id AS changed_at, floor(value / 50e0) AS value FROM events WHERE event_type = 'purchase'"""),
    "requests": (("events",), """
        SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'pending' END AS state, (event_id * 31) % 997 AS requested_at FROM events"""),
    # Tables made to break every invariant.
    "odd_windows": (("windows",), """
        SELECT CASE WHEN bucket % 19 = 0 THEN 'twice' ELSE window_id END AS window_id, CASE WHEN bucket % 23 = 0 THEN 'net' ELSE visao END AS visao, CASE WHEN bucket % 29 = 0 THEN 'same' ELSE path END AS path,
               CASE WHEN bucket % 31 = 0 THEN -1 ELSE n_rows END AS n_rows, CASE WHEN bucket % 3 = 0 THEN 'nfstream' WHEN bucket % 37 = 0 THEN 'perl' END AS extractor,
               CASE WHEN bucket % 41 = 0 THEN 'gone' ELSE pool_state END AS pool_state, CASE WHEN bucket % 17 = 0 THEN t_end ELSE t_start END AS t_start, t_end,
               CASE WHEN bucket % 14 <> 0 THEN evicted_at END AS evicted_at, CASE WHEN bucket % 21 <> 0 THEN evicted_reason END AS evicted_reason FROM windows"""),
    "odd_models": (("models",), """
        SELECT model_id, CASE WHEN model_id = 21 THEN 3 ELSE stage END AS stage, CASE WHEN model_id = 22 THEN 'oracle' ELSE kind END AS kind, CASE WHEN model_id = 24 THEN 'net' ELSE visao END AS visao,
               CASE WHEN model_id IN (2, 4) THEN 'promoted' WHEN model_id = 20 THEN 'lost' ELSE status END AS status, CASE WHEN model_id = 12 THEN 1 END AS explains_model_id,
               CASE WHEN model_id % 2 = 1 THEN trained_at END AS promoted_at, CASE WHEN model_id % 9 <> 0 THEN trained_at END AS retired_at,
               CASE WHEN model_id IN (25, 26) THEN 'same' ELSE 'm' || CAST(model_id AS STRING) END AS artifact_path FROM models"""),
    "odd_provenance": (("provenance",), """
        SELECT CASE WHEN model_id = 3 THEN 999 ELSE model_id END AS model_id, window_id, weight - CASE WHEN model_id = 2 THEN 1e0 ELSE 0e0 END AS weight FROM provenance
        UNION ALL SELECT model_id, window_id || 'x', weight FROM provenance WHERE model_id = 1 UNION ALL SELECT model_id, window_id, weight FROM provenance WHERE model_id = 4"""),
    "odd_evaluations": (("evaluations",), """
        SELECT model_id, CASE WHEN model_id = 6 THEN 'all' WHEN model_id = 7 THEN 'capture' ELSE scope END AS scope, CASE WHEN model_id % 5 = 0 AND scope = 'scenario' THEN NULL ELSE scenario END AS scenario,
               CASE WHEN model_id % 4 = 0 THEN 'c1' END AS capture, evaluated_at - 2 AS n FROM evaluations"""),
    "odd_alerts": (("alerts",), """
        SELECT CASE WHEN alert_id % 89 = 0 THEN 7 ELSE alert_id END AS alert_id, CASE WHEN alert_id % 89 = 0 THEN 0e0 ELSE ts END AS ts, CASE WHEN alert_id % 53 = 0 THEN 'net' ELSE visao END AS visao,
               dst_port - CASE WHEN alert_id % 59 = 0 THEN 70000 ELSE 0 END AS src_port, dst_port + CASE WHEN alert_id % 61 = 0 THEN 70000 ELSE 0 END AS dst_port, percentile * 1.01e0 AS percentile,
               CASE WHEN alert_id % 5 < 4 THEN alert_id % 3 END AS label_cic FROM alerts"""),
    "odd_verdicts": (("verdicts",), """
        SELECT CASE WHEN alert_id % 43 = 0 THEN -7 ELSE verdict_id END AS verdict_id, alert_id, veredito, alert_id % 7 AS confianca,
               CASE WHEN verdict_id % 47 = 0 THEN verdict_id ELSE coalesce(supersedes, -(alert_id % 50)) END AS supersedes FROM verdicts"""),
    "odd_assignments": (("assignments",), """
        SELECT CASE WHEN alert_id % 67 = 0 THEN 1 ELSE assignment_id END AS assignment_id, CASE WHEN alert_id % 71 = 0 THEN 3 ELSE alert_id END AS alert_id, model_id,
               CASE WHEN alert_id % 73 = 0 THEN 'talvez' ELSE predicted END AS predicted, CASE WHEN state = 'reviewed' AND alert_id % 2 = 0 THEN 'done' ELSE state END AS state,
               CASE WHEN alert_id % 4 = 2 THEN created_at END AS closed_at FROM assignments"""),
    "odd_requests": (("requests",), """
        SELECT CASE WHEN request_id % 79 = 0 THEN 5 ELSE request_id END AS request_id, CAST(request_id % 4 AS INT) AS stage, CASE request_id % 5 WHEN 0 THEN 'flow' WHEN 1 THEN 'host' WHEN 2 THEN 'net' END AS visao,
               CASE request_id % 6 WHEN 0 THEN 'analista' WHEN 1 THEN 'agendado' WHEN 2 THEN 'despejo' ELSE 'outro' END AS origem,
               CASE WHEN request_id % 7 = 0 THEN 'failed' WHEN request_id % 1000 = 1 THEN 'lost' ELSE state END AS state, CASE WHEN request_id % 14 = 0 THEN 'erro' END AS erro,
               CASE WHEN request_id % 2 = 0 THEN requested_at END AS finished_at FROM requests"""),
    "odd_captures": (("captures",), """
        SELECT CASE WHEN capture IN ('c1', 'c2') THEN 'c1' ELSE capture END AS capture, CASE WHEN capture = 'c3' THEN 'nowhere' ELSE scenario END AS scenario, CASE WHEN capture = 'c4' THEN 2 ELSE 1 END AS label,
               CASE WHEN capture = 'c5' THEN 'net' ELSE 'flow' END AS visao, n_rows - CASE WHEN capture = 'c6' THEN 1000000 ELSE 0 END AS n_rows, CASE WHEN capture IN ('c6', 'c7') THEN 'same' ELSE capture END AS parquet_path FROM captures"""),
}
_TABLES = ("events", "labels", "lineitem", "part", "documents", "embeddings")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or derived table as a DataFrame."""
    if name in _TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, sql = _VIEWS[name]
    sql = sql.replace("@MICROS", "unix_micros(CAST(ts AS TIMESTAMP))").replace("@K", "CAST(get_json_object(props, '$.k') AS BIGINT)")
    for n in needs:
        sql = _sub(sql, n)
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in needs})


def _sub(sql: str, name: str) -> str:
    return sql.replace(f"FROM {name}", "FROM {" + name + "}")


def duck(*names: str, then: str = "") -> str:
    """``WITH`` clause of the derived tables and what they need, for DuckDB; ``then`` follows."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _VIEWS[n][0]:
            if m in _VIEWS:
                add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_VIEWS[n][1]})" for n in order]
    return ("WITH RECURSIVE " + ",\n".join(parts) + " " if parts else "").replace("@MICROS", "epoch_us(ts)").replace("@K", "CAST(json_extract_string(props, '$.k') AS BIGINT)") + then


#: Flow rows in plain SQL, the oracle's own form.
FLOWS_SQL = """flows AS (
  SELECT src, dst, portA, portB, proto, min(ts) AS t0, count(*) AS n_packets, sum(length) AS n_bytes, max(ts) - min(ts) AS duration,
         CASE WHEN max(ts) > min(ts) THEN sum(length) / (max(ts) - min(ts)) ELSE sum(length) END AS bytes_per_sec,
         CASE WHEN max(ts) > min(ts) THEN count(*) / (max(ts) - min(ts)) ELSE count(*)::DOUBLE END AS pkts_per_sec,
         avg(length) AS mean_len, stddev_pop(length) AS std_len, min(length) AS min_len, max(length) AS max_len,
         coalesce(avg(gap), 0) AS mean_iat, coalesce(stddev_pop(gap), 0) AS std_iat,
         sum(length(flags) - length(replace(flags, 'S', ''))) / count(*) AS syn_ratio, sum(length(flags) - length(replace(flags, 'A', ''))) / count(*) AS ack_ratio,
         sum(length(flags) - length(replace(flags, 'F', ''))) / count(*) AS fin_ratio, sum(length(flags) - length(replace(flags, 'R', ''))) / count(*) AS rst_ratio,
         sum(length(flags) - length(replace(flags, 'P', ''))) / count(*) AS psh_ratio,
         CASE WHEN sum(length(flags) - length(replace(flags, 'S', ''))) > 0 AND sum(length(flags) - length(replace(flags, 'A', ''))) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS syn_no_ack
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY src, dst, portA, portB, proto ORDER BY ts) AS gap FROM
    (SELECT CASE WHEN ab THEN src ELSE dst END AS src, CASE WHEN ab THEN dst ELSE src END AS dst, CASE WHEN ab THEN sport ELSE dport END AS portA,
            CASE WHEN ab THEN dport ELSE sport END AS portB, proto, ts, length, flags FROM (SELECT *, src < dst OR (src = dst AND sport <= dport) AS ab FROM packets) p) k) g
  GROUP BY src, dst, portA, portB, proto)"""


def flows_duck(*names: str, then: str) -> str:
    return duck("packets", *names, then=", " + FLOWS_SQL + " " + then)


def r4(c: Column | str) -> Column:
    """Four digits, ties and float noise pushed up, as the oracle does."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-7, 4)


def rounded(df: DataFrame) -> DataFrame:
    """``df`` with every double at four digits."""
    return df.select(*[r4(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def r4_sql(*cols: str) -> str:
    return ", ".join(f"round({c} + 1e-7, 4) AS {c}" for c in cols)


class Registry:
    """Queries by name with their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return keep

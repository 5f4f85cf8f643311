"""Lifecycle chains on a store, exact samples, vanished files, CSV with a header."""

import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.operators import cycle, explore, lifecycle
from tidemark.operators import models as M
from tidemark.sources import packets as sources


def model(spark, *rows):
    return spark.createDataFrame([(*r, None, None, "p") for r in rows], cycle.SCHEMAS["models"])


def test_store_shows_whole_commits_only(spark, tmp_path):
    store = cycle.Store(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.read("models").count() == 0
    store.commit({"models": model(spark, (1, 1, "k", "flow", "candidate", 1.0))})
    # A chain that broke off after its tables, before its pointer.
    model(spark, (9, 1, "k", "flow", "candidate", 1.0)).write.parquet(f"{store.folder(2)}/models")
    assert [r["model_id"] for r in store.read("models").collect()] == [1]
    store.commit({"models": model(spark, (2, 1, "k", "flow", "candidate", 1.0)), "provenance": spark.createDataFrame([(2, "w", 1.0)], cycle.SCHEMAS["provenance"])})
    assert [r["model_id"] for r in store.read("models").collect()] == [2] and store.version() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit({"models": model(spark, (3, 1, "k", "flow", "candidate", 1.0))}, version=2)


@pytest.fixture(scope="module")
def points(spark):
    rows = [(i, float(i % 50) / 50, float((i * 7) % 13), "s0", float(i * 700), "w0") for i in range(300)]
    return spark.createDataFrame(rows, "id long, a double, b double, sensor string, t0 double, window_id string").cache()


def golden_of(points):
    return points.filter("id < 100").withColumns({"scenario": F.when(F.col("id") % 5 == 0, "recon").otherwise("limpo"), "capture": F.lit("c"), "label": (F.col("id") % 5 == 0).cast("int")})


def test_adoption_then_candidate_then_promotion(spark, tmp_path, points):
    store = cycle.Store(spark, str(tmp_path / "s"))
    bundle = M.detect(points, ["a", "b"], "id", trees=5)[1]
    golden = golden_of(points)
    with pytest.raises(ValueError, match="lacks"):
        cycle.adopt_bundle(store, {"cols": ["a"]}, points, golden, ["a"], "id", "flow", "x", 1)
    with pytest.raises(ValueError, match="other columns"):
        cycle.adopt_bundle(store, bundle, points, golden, ["b", "a"], "id", "flow", "x", 1)
    assert store.version() == 0
    first = cycle.adopt_bundle(store, bundle, points, golden, ["a", "b"], "id", "flow", "x", 1, seconds=86400)
    assert store.read("windows").agg(F.sum("n_rows")).first()[0] == 300
    floors = spark.createDataFrame([(1, "recon", 0.0, True)], "stage int, scenario string, recall_minimo double, obrigatorio boolean")
    pool = spark.createDataFrame([("w0", "flow", "active", "v1", 0, 300)], "window_id string, visao string, pool_state string, feature_set string, t_end long, n_rows long")
    second, check, verdict = cycle.make_candidate(store, points, pool, golden, floors, ["a", "b"], "id", "flow", 40 * 86400, trees=5)
    assert check.first()["incumbent_model_id"] == first and verdict.count() == 1
    assert cycle.promote_candidate(store, floors.withColumn("recall_minimo", F.lit(2.0)), second, "x", 5.0) == "reprovado"
    assert cycle.promote_candidate(store, floors.withColumn("recall_minimo", F.lit(2.0)), second, "x", 6.0, "because") == "sobreposto"
    status = {r["model_id"]: (r["status"], r["promoted_at"], r["retired_at"]) for r in store.read("models").collect()}
    assert status == {first: ("retired", 1.0, 6.0), second: ("promoted", 6.0, None)}
    assert [r["decisao"] for r in store.read("promotions").orderBy("decided_at").collect()] == ["adotado", "reprovado", "sobreposto"]
    assert "recon" in store.read("promotions").filter("decisao = 'reprovado'").first()["gate_report"]


def test_stage2_needs_both_classes_and_keeps_alerts_judged_once(spark, tmp_path, points):
    store = cycle.Store(spark, str(tmp_path / "s"))
    golden = points.withColumns({"label": (F.col("a") > 0.5).cast("int"), "scenario": F.when(F.col("id") % 2 == 0, "recon").otherwise("odd")})
    alerts = lifecycle.with_feature_json(points.select(F.col("id").alias("alert_id"), F.col("t0").alias("ts"), F.lit("flow").alias("visao"), "a", "b"), ["a"])
    verdicts = spark.createDataFrame([(1, 7, "ataque", None), (2, 7, "benigno", 1), (3, 8, "inconclusivo", None)], "verdict_id long, alert_id long, veredito string, supersedes long")
    labelled = cycle.stage2_labels(golden, alerts, verdicts, ["a", "b"])
    told = labelled.filter("origem = 'verdict'").collect()
    assert [(r["id"], r["label"], r["b"]) for r in told] == [(7, 0, 0.0)]  # the newest verdict; a column that the JSON lacks is 0
    scenarios = spark.createDataFrame([("recon",)], "scenario string")
    with pytest.raises(ValueError):
        cycle.train_stage2(store, labelled.filter("label = 0"), ["a", "b"], "flow", 1, scenarios)
    model_id, _, _ = cycle.train_stage2(store, labelled, ["a", "b"], "flow", 1, scenarios)
    scopes = {(r["scope"], r["scenario"]): r for r in store.read("evaluations").collect()}
    assert set(scopes) == {("aggregate", None), ("scenario", "recon")} and scopes["aggregate", None]["recall"] > 0.9
    with pytest.raises(ValueError):
        cycle.predict_pending(store, alerts, "flow", 2)
    cycle.promote_stage2(store, model_id, "x", 2)
    with pytest.raises(ValueError):
        cycle.promote_stage2(store, model_id, "x", 3)
    assert cycle.predict_pending(store, alerts, "flow", 4, limit=200) == 200
    assert cycle.predict_pending(store, alerts, "flow", 5) == 300
    assert store.read("assignments").select("alert_id").distinct().count() == 300


def test_exact_sample(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    order = sorted(range(5000), key=lambda i: ((i + 3) * 2654435761 % (1 << 32), i))
    for n in (0, 1, 777, 5000, 9000):
        assert sorted(r["k"] for r in explore.sample_exactly(df, n, "k", 3, bins=64).collect()) == sorted(order[:n])
    assert explore.sample_exactly(df.limit(0), 5, "k").count() == 0


def test_vanished_windows_and_headed_csv(spark, tmp_path):
    rows = spark.createDataFrame([("s", "flow", b, f"w{b}", 1.0) for b in range(4)], "sensor string, visao string, bucket long, window_id string, t0 double")
    sinks.write_pool(rows, str(tmp_path / "pool"))
    index = spark.read.parquet(str(tmp_path / "pool/index"))
    for f in (tmp_path / "pool/windows/sensor=s/visao=flow/bucket=2").iterdir():
        f.unlink()
    left, gone = sinks.read_windows(spark, index, str(tmp_path / "pool/windows"))
    assert gone == 1 and sorted(r["bucket"] for r in left.collect()) == [0, 1, 3]
    (tmp_path / "x.csv").write_text(" Flow Duration , Label\n12, BENIGN\nNaN,x\n,DoS\n")
    got = sources.read_headed_csv(spark, str(tmp_path / "x.csv"), "Label string, `Flow Duration` int")
    assert [tuple(r) for r in got.collect()] == [("BENIGN", 12), ("x", None), ("DoS", None)]


def test_optional_filters(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0), (3, "a", 7.0)], "id int, k string, t double")
    ask = lambda **f: [r["id"] for r in lifecycle.matching(df, **f).orderBy("id").collect()]
    assert ask() == ask(equal={"k": None}, since=("t", None), among={"k": None}) == [1, 2, 3]
    assert ask(equal={"k": "a"}, since=("t", 6.0)) == [3] and ask(until=("t", 6.0)) == [1] and ask(among={"k": ["b", "z"]}) == [2]

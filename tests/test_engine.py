"""Hand-computed fixtures and invariants of the engine's operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sinks
from tidemark.functions import scalars
from tidemark.operators import explore, flows, labels, lifecycle, models, stats, windows
from tidemark.schemas import FLOW_FEATURES, HOST_FEATURES, PACKET
from tidemark.sources import captures
from tidemark.sources import packets as sources


def one(df):
    return df.first().asDict()


def test_two_packet_flow(spark):
    p = spark.createDataFrame([(0.0, "A", "B", 6, 100, 1, 2, "S"), (2.0, "B", "A", 6, 300, 2, 1, "SA")], PACKET)
    r = one(flows.flow_features(p))
    want = dict(n_packets=2, n_bytes=400, duration=2, bytes_per_sec=200, mean_len=200, std_len=100, mean_iat=2, std_iat=0, syn_ratio=1, ack_ratio=0.5, syn_no_ack=0)
    assert {k: r[k] for k in want} == want
    assert set(FLOW_FEATURES) <= set(r)


def test_single_packet_and_text_order(spark):
    p = spark.createDataFrame([(5.0, "10.0.0.9", "10.0.0.10", 6, 60, 7, 8, "S")], PACKET)
    r = one(flows.flow_features(p))
    assert (r["src"], r["portA"], r["duration"], r["bytes_per_sec"], r["pkts_per_sec"], r["mean_iat"], r["syn_no_ack"]) == ("10.0.0.10", 8, 0, 60, 1, 0, 1)


def test_flow_slices_do_not_change_results(spark):
    rng = np.random.default_rng(1)
    rows = [(float(t), "a", "b", 17, int(n), None, None, "") for t, n in zip(np.sort(rng.uniform(0, 500, 200)), rng.integers(40, 1500, 200))]
    p = spark.createDataFrame(rows, PACKET)
    wide, fine = (one(flows.flow_features(p, slice_seconds=s)) for s in (1e9, 7.0))
    gaps = np.diff([r[0] for r in rows])
    assert wide["std_iat"] == pytest.approx(gaps.std()) and wide["std_len"] == pytest.approx(np.std([r[4] for r in rows]))
    assert all(wide[k] == pytest.approx(fine[k]) for k in FLOW_FEATURES)


def test_flow_invariants_on_demo(spark):
    p = sources.demo_packets(spark)
    f = flows.flow_features(p)
    assert f.agg(F.sum("n_packets")).first()[0] == p.count()
    assert f.agg(F.sum("n_bytes")).first()[0] == p.agg(F.sum("length")).first()[0]
    swapped = p.select("ts", F.col("dst").alias("src"), F.col("src").alias("dst"), "proto", "length", F.col("dport").alias("sport"), F.col("sport").alias("dport"), "flags")
    assert f.exceptAll(flows.flow_features(swapped)).count() == 0
    hosts = {r["src"]: r for r in flows.host_features(p).collect()}
    assert hosts["10.0.0.66"]["n_dports"] == 399 and hosts["10.0.0.66"]["n_dst"] == 1
    assert flows.host_features(p, max_ports=100).filter("src = '10.0.0.66'").first()["n_dports"] == 100
    assert set(HOST_FEATURES) <= set(hosts["10.0.0.66"].asDict())


def test_pcap_and_text(spark, tmp_path):
    ip = bytes([0x45, 0, 0, 44, 0, 0, 0, 0, 64, 6, 0, 0, 10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack(">HHIIBB", 51514, 443, 0, 0, 0x50, 0x12) + b"\0" * 8
    frame, arp = b"\0" * 12 + b"\x08\x00" + ip, b"\0" * 12 + b"\x08\x06" + b"\0" * 28
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for sec, data in ((1700000000, frame), (1700000001, arp)):
        body += struct.pack("<IIII", sec, 500000, len(data), len(data)) + data
    (tmp_path / "x.pcap").write_bytes(body)
    got = captures.read_pcap(spark, str(tmp_path / "x.pcap")).collect()
    assert [tuple(r) for r in got] == [(1700000000.5, "10.0.0.1", "10.0.0.2", 6, 56, 51514, 443, "SA")]
    lines = ["1700000000.123456 IP 10.0.0.1.51514 > 10.0.0.2.443: Flags [S.], length 0", "1700000001.5 IP 10.0.0.1.53 > 10.0.0.2.99: UDP, length 30", "1700000001.5 IP 10.0.0.1 > 10.0.0.2: ICMP echo request, length 64", "noise"]
    rows = sources.parse_tcpdump(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["proto"], r["sport"], r["dport"], r["length"], r["flags"]) for r in rows] == [(6, 51514, 443, 0, "S."), (17, 53, 99, 30, ""), (17, None, None, 64, "")]


def test_anchored_windows(spark):
    p = spark.createDataFrame([(float(t), "s") for t in (0, 4, 9, 12, 21, 23)], "ts double, sensor string")
    assert [(r[1], r[3]) for r in windows.anchored_windows(p).orderBy("w_start").collect()] == [(0, 3), (12, 2), (23, 1)]
    assert sorted(r["ts"] for r in windows.in_anchored_windows(p).collect()) == [0, 4, 9]


def test_late_rows(spark):
    rows = [("s", 1, 5), ("s", 2, 6), ("s", 3, 5), ("s", 3, 7), ("s", 4, 4)]
    got = windows.late_rows(spark.createDataFrame(rows, "sensor string, frame int, bucket long"))
    assert {(r["frame"], r["bucket"]) for r in got.filter("late").collect()} == {(3, 5)}


def test_weighted_quantile_and_lookup(spark):
    v = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 1.0, 2), (3.0, 2.0, 3)], "v double, w double, id int")
    q = {r["k"]: r["score"] for r in stats.weighted_quantiles(v, "v", "w", "id").collect()}
    assert len(q) == 1001 and q[500] == pytest.approx(2 + 1 / 3) and q[0] == 1 and q[1000] == 3
    grid = list(zip([0, 0.25, 0.5, 0.75, 1], [1, 1, 1, 2, 2]))
    s = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (3.0,), (0.0,), (None,)], "s double")
    assert [r["percentile"] for r in stats.percentile_lookup(s, "s", grid).collect()] == [0.5, 0.625, 1.0, 1.0, 0.0, None]


def test_weighted_quantile_against_interp(spark):
    rng = np.random.default_rng(2)
    v, w = np.round(rng.normal(size=400), 1), rng.uniform(0.1, 2, 400)
    df = spark.createDataFrame([(float(a), float(b), i) for i, (a, b) in enumerate(zip(v, w))], "v double, w double, id int")
    order = np.lexsort((np.arange(400), v))
    cdf = (np.cumsum(w[order]) - w[order] / 2) / w.sum()
    want = np.interp(np.arange(1001) / 1000, cdf, v[order])
    got = [r["score"] for r in stats.weighted_quantiles(df, "v", "w", "id", slices=7).orderBy("k").collect()]
    assert np.allclose(got, want)


def test_quantiles_and_empty(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    assert [r["value"] for r in stats.exact_quantiles(df, "x", [0.0, 0.5, 0.975, 1.0]).orderBy("q").collect()] == [0, 50, 97.5, 100]
    assert stats.exact_quantiles(df.filter("x < 0"), "x", [0.5]).first()["value"] is None


def test_pool_weights_and_verdicts(spark):
    day = 86400
    w = spark.createDataFrame([("a", "flow", "active", 14 * day, 5), ("b", "flow", "active", 0, 7)], "window_id string, visao string, pool_state string, t_end long, n_rows long")
    pool = lifecycle.pool_weights(lifecycle.training_pool(w, 40 * day))
    assert {r["window_id"]: round(r["peso"], 9) for r in pool.collect()} == {"a": 1.0, "b": 0.5}
    v = spark.createDataFrame([(1, 7, None), (2, 7, 1)], "verdict_id int, alert_id int, supersedes int")
    assert [r["verdict_id"] for r in lifecycle.current_verdicts(v).collect()] == [2]


def test_gate_three_valued(spark):
    models_ = spark.createDataFrame([(2, 1, "forest", "flow", "candidate"), (3, 1, "forest", "flow", "candidate")], "model_id int, stage int, kind string, visao string, status string")
    ev = spark.createDataFrame([(2, "scenario", "recon", 0.95, 0.0), (2, "scenario", "exfil", None, None), (3, "scenario", "exfil", None, None)], "model_id int, scope string, scenario string, recall double, taxa_falso_positivo double")
    floors = spark.createDataFrame([(1, "recon", 0.9, False), (1, "exfil", 0.8, False)], "stage int, scenario string, recall_minimo double, obrigatorio boolean")
    got = {r["candidate_model_id"]: r["aprovado"] for r in lifecycle.gate_verdict(lifecycle.gate_check(models_, ev, floors), floors).collect()}
    assert got == {2: True, 3: None}


def test_schedule(spark):
    s = labels.compile_schedule(spark, [("2017-07-06", "15:04", "15:45", "Infiltration-Dropbox", ["205.174.165.73"], ["192.168.10.8"]), ("2017-07-06", "15:04", "15:45", "Infiltration-PortScan", ["192.168.10.8"], [])])
    at = 1499364600.0  # 15:10 at UTC-3
    f = spark.createDataFrame([(at, "192.168.10.8", "205.174.165.73"), (at, "192.168.10.8", "192.168.10.5"), (at + 9999, "192.168.10.8", "192.168.10.5")], "t0 double, src string, dst string")
    assert [r["attack"] for r in labels.label_flows(f, s).collect()] == ["Infiltration-Dropbox", "Infiltration-PortScan", None]


def test_finite_and_hash(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in df.select(scalars.finite(F.col("x"))).collect()] == [0.0, 0.0, 0.0, 2.5]
    import hashlib

    h = spark.range(1).select(scalars.hash_code(F.lit("tcp"))).first()[0]
    assert h == int(hashlib.sha256(b"tcp").hexdigest(), 16) % 10**8


def test_forest_finds_outliers(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (2000, 3)), rng.normal(9, 0.5, (10, 3))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")
    flagged, bundle = models.detect(df, ["a", "b", "c"], "id", contamination=0.01, trees=60)
    top = [r["id"] for r in flagged.orderBy(F.desc("score")).limit(10).collect()]
    assert sum(i >= 2000 for i in top) >= 9
    assert 0.005 <= flagged.agg(F.avg("anomaly")).first()[0] <= 0.015
    assert bundle["grid"][990][1] == pytest.approx(bundle["threshold"], rel=0.02)
    sinks.write_bundle(spark, bundle, str(tmp_path / "bundle"))
    back = sinks.read_bundle(spark, str(tmp_path / "bundle"))
    assert back["same_version"] and np.allclose(back["forest"].scores(x[:50]), bundle["forest"].scores(x[:50]))
    assert flagged.select(models.explain(back["tree"]).alias("r")).filter("r is null").count() == 0


def test_path_constant():
    assert models.path_constant(1) == 0 and models.path_constant(2) == 1
    assert models.path_constant(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_forest_query_has_all_trees(spark, monkeypatch):
    from tidemark import catalog
    from tidemark.plans import scoring

    fitted = []
    fit = models.fit_forest
    monkeypatch.setattr(scoring.models, "fit_forest", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    catalog.queries()["iforest_fit_score"](spark, "/root/testdata/sf0.001")
    assert fitted[0].nodes["tree"].nunique() == 200


def test_nearest(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)]
    e = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    got = explore.nearest(e.filter("vec_id = 5"), e, 2).collect()
    assert {r["neighbour"] for r in got} == {4, 6}


def test_nearest_keeps_smallest_ids_of_equal_vectors_and_any_query_set(spark):
    vectors = {i: [float(i % 3), 0.1 * (i % 3), 1.0] for i in range(90)}
    e = spark.createDataFrame(list(vectors.items()), "vec_id long, vec array<double>").repartition(3)
    for groups in ({}, {"query_group": 10, "base_group": 25, "block": 7}):
        got = sorted((r["id"], r["rank"], r["neighbour"], round(r["distance"], 9)) for r in explore.nearest(e, e, 4, **groups).collect())
        want = []
        for i, v in vectors.items():
            near = sorted((math.dist(v, w), j) for j, w in vectors.items() if j != i)[:4]
            want += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near)]
        assert got == want
    many = spark.range(100_001).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("double")).alias("vec"))
    assert explore.nearest(many, many.filter("vec_id < 3"), 1).count() == 100_001


def test_pool_sink_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("s", "flow", 1, "w1", 2.0), ("s", "flow", 2, "w2", 3.0)], "sensor string, visao string, bucket long, window_id string, t0 double")
    for _ in range(2):
        sinks.write_pool(rows, str(tmp_path / "pool"))
    assert spark.read.parquet(str(tmp_path / "pool/windows")).count() == 2


def test_live_stream(spark, tmp_path):
    from tidemark.streaming import live

    src = str(tmp_path / "in")
    p = sources.demo_packets(spark).withColumn("sensor", F.lit("s0"))
    p.coalesce(1).write.parquet(src)
    tagged = live.tag_anchored(spark.readStream.schema(p.schema).parquet(src))
    sink = live.LiveSink(str(tmp_path / "live"), lambda f: f.withColumn("score", F.col("n_bytes")), [(0.0, 0.0), (1.0, 2000.0)], seconds=30)
    tagged.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    sink.finish(spark)
    pool = spark.read.parquet(str(tmp_path / "live/pool/windows"))
    assert pool.agg(F.sum("n_packets")).first()[0] == p.count()
    assert spark.read.parquet(str(tmp_path / "live/alerts/*")).filter("percentile < 0.95").count() == 0


def test_current_model_and_digests(spark, tmp_path):
    import hashlib

    role = str(tmp_path / "role")
    assert sinks.current(spark, role) is None
    sinks.set_current(spark, role, "m1", 1.0)
    sinks.set_current(spark, role, "m2", 2.0)
    assert sinks.current(spark, role) == "m2"
    (tmp_path / "a.bin").write_bytes(b"xyz")
    assert sinks.file_digests(spark, str(tmp_path / "a.bin")).first()["sha256"] == hashlib.sha256(b"xyz").hexdigest()


def test_surrogate_fidelity_regimes(spark):
    from tidemark.operators import models as m

    df = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), F.lit(1.0).alias("b")).withColumn("anomaly", (F.col("a") > 16).cast("int"))
    r = one(m.surrogate_fidelity(df, ["a", "b"], "id"))
    assert (r["regime"], r["f1"], r["f1_cv_mean"], r["f1_cv_std"], r["tp"] + r["fn"], r["tn"]) == ("held_out", 1.0, 1.0, 0.0, 18, 102)
    few = df.withColumn("anomaly", (F.col("id") < 3).cast("int"))
    r = one(m.surrogate_fidelity(few, ["a", "b"], "id"))
    assert r["regime"] == "in_sample" and r["f1_cv_mean"] is None and r["tp"] + r["fp"] + r["fn"] + r["tn"] == 400
    assert m.surrogate_fidelity(df.withColumn("anomaly", F.lit(0)), ["a"], "id") is None
    dealt = explore.stratified_folds(df, "anomaly", "id", 5).groupBy("anomaly", "fold").count().collect()
    assert {(r["anomaly"], r["count"]) for r in dealt} == {(0, 68), (1, 12)} and len(dealt) == 10


def test_knn_and_sweep(spark):
    from tidemark.operators import models as m

    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal(4 * (i % 2), 0.5)), float(rng.normal()), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    train, test = df.filter("id < 140"), df.filter("id >= 140")
    got = {r["id"]: r["prediction"] for r in m.knn(train, test, ["a", "b"], "y", "id", 3).collect()}
    x, mean, std = np.array([r[1:3] for r in rows]), np.array([r[1:3] for r in rows[:140]]).mean(0), np.array([r[1:3] for r in rows[:140]]).std(0)
    x = (x - mean) / std
    for i in range(140, 200):
        near = np.argsort(((x[:140] - x[i]) ** 2).sum(1))[:3]
        assert got[i] == int(np.mean([rows[j][3] for j in near]) > 0.5)
    swept = m.feature_sweep(train, test, ["a", "b"], "y", [1, 2]).collect()
    assert [r["n_features"] for r in swept] == [1, 2] and all(r["accuracy"] > 0.95 for r in swept)


def test_candidate_is_weighted(spark):
    from tidemark.operators import commands

    day = 86400
    w = spark.createDataFrame([("old", "flow", "active", "v1", 0, 600), ("new", "flow", "active", "v1", 14 * day, 600)], "window_id string, visao string, pool_state string, feature_set string, t_end long, n_rows long")
    chosen = commands.candidate_windows(w, "flow", 40 * day)
    rows = spark.range(1200).select("id", F.when(F.col("id") < 600, "old").otherwise("new").alias("window_id"), F.rand(3).alias("a"), (F.rand(4) + F.when(F.col("id") < 600, 3.0).otherwise(0.0)).alias("b"))
    bundle = commands.train_candidate(rows, chosen, ["a", "b"], "id", trees=40)
    assert bundle["scaler"]["b"][0] == pytest.approx(1.5, abs=0.05)  # two thirds of the weight lie near 0.5
    golden = rows.limit(100).withColumns({"scenario": F.lit("limpo"), "capture": F.lit("c"), "label": F.lit(0)})
    judged = commands.judge_captures(golden, bundle)
    model, provenance, evaluations = commands.candidate_rows(5, 1, "flow", 1, chosen, judged)
    assert model.first()["status"] == "candidate" and {r["window_id"]: round(r["weight"], 6) for r in provenance.collect()} == {"new": 1.0, "old": 0.5}
    assert {r["scope"]: r["fp"] + r["tn"] for r in evaluations.collect()} == {"capture": 100, "scenario": 100, "aggregate": 100}
    with pytest.raises(ValueError):
        commands.train_candidate(rows, chosen.limit(0), ["a"], "id")


def test_byte_sums_are_exact_in_any_order(spark):
    from decimal import Decimal

    rng = np.random.default_rng(8)
    lengths = {f"10.0.0.{i}": [float(v) / 100 for v in rng.integers(1, 9000, 12)] for i in range(40)} | {"10.0.0.90": [100.1, 0.1, 0.2, 199.6], "10.0.0.91": [1e19, 2e18], "10.0.0.92": [None, 1.5]}
    rows = [(float(k * 1500 + i), ip, v) for ip, all_ in lengths.items() for i, v in enumerate(all_) for k in [i]]
    p = spark.createDataFrame(rows, "ts double, src string, length double").selectExpr("ts", "src", "'9.9.9.9' AS dst", "6 AS proto", "length", "1 AS sport", "2 AS dport", "'A' AS flags")
    got = {r["src"]: r["n_bytes"] for r in flows.flow_features(p).collect()}
    assert got == {ip: float(sum(Decimal(str(v)) for v in all_ if v is not None)) for ip, all_ in lengths.items()}
    assert got["10.0.0.90"] == 300.0


def test_fits_read_their_rows_once(spark):
    """However many models are fitted and judged, a row of the input is made once for each half or table that is written."""
    from tidemark.operators import models as m

    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(120).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b", "CAST(id % 2 AS INT) AS y").repartition(2)
    df = rows.mapInArrow(seen, rows.schema)
    m.surrogate_fidelity(df, ["a", "b"], "id", "y").collect()
    assert made.value == 120
    m.feature_sweep(df.filter("id < 80"), df.filter("id >= 80"), ["a", "b"], "y", [1, 2]).collect()
    assert made.value == 360


def test_nearest_neighbours_of_copies(spark):
    from tidemark.operators import models as m

    rows = [(i, float(i % 5), float(i % 3), int(i // 15 % 2)) for i in range(150)] + [(200, -0.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    train, test = df.filter("id % 3 <> 1"), df.filter("id % 3 = 1")
    scaler = m.moments(train, ["a", "b"])
    at = {r[0]: [(v - scaler[c][0]) / scaler[c][1] for c, v in zip("ab", r[1:3])] for r in rows}
    for r in m.knn(train, test, ["a", "b"], "y", "id", 4).collect():
        near = sorted((math.dist(at[r["id"]], at[o[0]]), o[0], o[3]) for o in rows if o[0] % 3 != 1)[:4]
        ones = sum(n[2] for n in near)
        assert r["prediction"] == int(ones > 2), r


def test_nearest_writes_each_side_once(spark):
    """Bytes on disk grow with the sum of both sides, not with their product; finds are those of brute force, ties included."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(2500, 8)), rng.integers(0, 3, (1300, 8)).astype(float), np.zeros((200, 8))])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(4)
    disk = lambda: sum(f.length() for f in _scala(spark, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = disk()
    got = explore.nearest(e, e, 4, query_group=100, base_group=100, block=37).orderBy("id", "rank").collect()
    assert disk() - before < 12 * x.nbytes
    want = []
    for i, v in enumerate(x):
        far = np.sqrt(((x - v) ** 2).sum(1))
        far[i] = np.inf
        want += [(i, int(j), float(far[j]), r + 1) for r, j in enumerate(np.lexsort((np.arange(len(x)), far))[:4])]
    assert [tuple(r) for r in got] == want


def _scala(spark, found):
    return spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found)


def test_nearest_of_nothing_and_of_few(spark):
    e = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 1.0])], "vec_id long, vec array<double>")
    assert explore.nearest(e, e.limit(0), 2).count() == 0 and explore.nearest(e.limit(0), e, 2).count() == 0
    assert sorted((r["id"], r["neighbour"]) for r in explore.nearest(e, e, 9).collect()) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def test_sums_near_a_cut_follow_time(spark):
    """A flow whose doubles, added in time, pass a cut that their exact sum meets lies beyond it; one that is far keeps its exact sum."""
    lengths = {"10.0.0.1": [100.1, 0.1, 0.2, 199.6], "10.0.0.2": [5.95, 83.78, 86.68, 39.05, 17.49, 67.05], "10.0.0.3": [0.1, 0.2, 0.3], "10.0.0.4": [26.57, 71.23, 46.21, 15.99], "10.0.0.5": [None, 300.0]}
    rows = [(float(i * 4000), i, ip, v) for ip, all_ in lengths.items() for i, v in enumerate(all_)]
    p = spark.createDataFrame(rows, "ts double, event_id long, src string, length double").repartition(3).selectExpr("ts", "event_id", "src", "'9.9.9.9' AS dst", "6 AS proto", "length", "1 AS sport", "CAST(NULL AS INT) AS dport", "'A' AS flags")
    f = flows.flow_features(p)
    got = {r["src"]: (r["n_bytes"], r["mean_len"]) for r in flows.summed_in_time(f, p, {"n_bytes": {300.0}, "mean_len": {40.0}}, ("ts", "event_id")).collect()}
    added = {ip: 0.0 for ip in lengths}
    for ip, all_ in lengths.items():
        for v in all_:
            added[ip] += v or 0.0
    assert len(got) == 5
    exact = {r["src"]: r["n_bytes"] for r in f.collect()}
    assert got == {ip: (s, s / len(lengths[ip])) for ip, s in (added | {"10.0.0.3": exact["10.0.0.3"]}).items()}
    assert exact["10.0.0.2"] == 300.0 < got["10.0.0.2"][0] and exact["10.0.0.4"] == 160.0 and got["10.0.0.4"][1] > 40.0

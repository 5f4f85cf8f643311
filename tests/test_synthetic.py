"""Synthetic flows, and the ranking of importances."""

from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.schemas import FLOW_FEATURES
from tidemark.sources import synthetic


def test_same_rows_however_partitioned_and_kinds_differ(spark, monkeypatch):
    monkeypatch.setattr(synthetic, "BLOCK", 300)
    kinds = {"usual": synthetic.usual_flows(spark, 1000), "scan": synthetic.scan_flows(spark, 1000), "beacon": synthetic.beacon_flows(spark, 1000, 600.0)}
    for df in kinds.values():
        assert df.columns == ["id", *FLOW_FEATURES] and df.count() == 1000 == df.select("id").distinct().count()
        assert sorted(df.collect()) == sorted(df.coalesce(1).collect())
    mean = lambda kind, c: kinds[kind].agg(F.avg(c)).first()[0]
    assert mean("scan", "syn_no_ack") == 1 and mean("usual", "syn_no_ack") == 0 and mean("scan", "n_packets") < 2
    assert abs(mean("beacon", "duration") - 600) < 2 and mean("beacon", "std_iat") < 0.02 * mean("beacon", "mean_iat")
    assert synthetic.usual_flows(spark, 0).count() == 0


def test_importances_are_ranked(spark):
    got = models.ranked_importances(spark, {"a": 0.2, "b": 0.5, "c": 0.0, "d": 0.2}, 2).collect()
    assert [(r["place"], r["column"]) for r in got] == [(1, "b"), (2, "a")]

"""Synthetic flow rows: usual traffic, port scans and beacons, drawn in tasks.

Rows come in blocks of ``BLOCK`` that are each seeded by the seed and their number, so a table is the same
however it is partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import FLOW_FEATURES

BLOCK = 10_000
Draw = Callable[[np.random.Generator, int], dict[str, np.ndarray]]


def _usual(rng: np.random.Generator, n: int) -> dict[str, np.ndarray]:
    # Distributions of usual traffic.
    log, bell, share = rng.lognormal, rng.normal, rng.beta
    rows = {"n_packets": log(3.2, 0.8, n), "duration": log(1.0, 1.0, n), "mean_iat": log(-1.5, 1.0, n)}
    rows |= {"mean_len": bell(620, 180, n).clip(60, 1500), "std_len": bell(240, 80, n).clip(0), "min_len": bell(70, 12, n).clip(40), "max_len": bell(1400, 90, n).clip(60, 1514)}
    rows |= {f"{flag}_ratio": share(a, b, n) for flag, a, b in (("syn", 1.5, 30), ("ack", 9, 3), ("fin", 1.5, 30), ("rst", 1, 60), ("psh", 3, 8))}
    return rows | {"n_bytes": rows["n_packets"] * log(6.2, 0.5, n), "std_iat": rows["mean_iat"] * rng.uniform(0.3, 1.5, n), "syn_no_ack": np.zeros(n), "_least": np.full(n, 0.01)}


def _scan(rng: np.random.Generator, n: int) -> dict[str, np.ndarray]:
    # Tiny flows in a burst, SYN without ACK.
    none, size = np.zeros(n), rng.normal(60, 3, n)
    rows = _usual(rng, n) | {"n_packets": rng.integers(1, 3, n).astype(float), "duration": rng.uniform(0, 0.05, n), "mean_len": size, "min_len": size, "max_len": size, "std_len": none}
    rows |= {"mean_iat": rng.uniform(0, 0.01, n), "std_iat": none, "syn_ratio": rng.uniform(0.9, 1.0, n), "ack_ratio": none, "fin_ratio": none, "rst_ratio": rng.beta(2, 5, n), "psh_ratio": none}
    return rows | {"n_bytes": rows["n_packets"] * rng.normal(60, 4, n), "syn_no_ack": np.ones(n), "_least": np.full(n, 0.001)}


def _beacon(period: float) -> Draw:
    def draw(rng: np.random.Generator, n: int) -> dict[str, np.ndarray]:
        # Few packets at very even gaps.
        rows = _usual(rng, n) | {"n_packets": rng.integers(4, 10, n).astype(float), "duration": rng.normal(period, period * 0.01, n).clip(1)}
        gap = rows["duration"] / rows["n_packets"]
        return rows | {"n_bytes": rows["n_packets"] * rng.normal(300, 30, n), "mean_iat": gap, "std_iat": gap * rng.uniform(0.0, 0.02, n)}

    return draw


def _made(spark: SparkSession, n: int, seed: int, kind: int, draw: Draw) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["id"].tolist():
                rows = pd.DataFrame(draw(np.random.default_rng([seed, kind, block]), min(BLOCK, n - block * BLOCK)))
                seconds = np.maximum(rows["duration"], rows.pop("_least"))
                rows["bytes_per_sec"], rows["pkts_per_sec"] = rows["n_bytes"] / seconds, rows["n_packets"] / seconds
                rows["id"] = block * BLOCK + np.arange(len(rows))
                yield rows[["id", *FLOW_FEATURES]]

    schema = "id long, " + ", ".join(f"{c} double" for c in FLOW_FEATURES)
    return spark.range(-(-n // BLOCK)).mapInPandas(run, schema)


def usual_flows(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of common traffic: ``id`` and the flow features."""
    return _made(spark, n, seed, 0, _usual)


def scan_flows(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of a SYN scan."""
    return _made(spark, n, seed, 1, _scan)


def beacon_flows(spark: SparkSession, n: int, period: float, seed: int = 7) -> DataFrame:
    """``n`` rows of a beacon that calls every ``period`` seconds."""
    return _made(spark, n, seed, 2, _beacon(period))

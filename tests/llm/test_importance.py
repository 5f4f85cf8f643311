"""Importance resampling against a word-by-word version of its rules."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 313}" for i in range(40_000))
TEXTS = [None, "", " -\n", "One", "one TWO", "é ß ü x", "y" * 5000 + " z", "a\x00b c", LONG, LONG + " tail", *[f"the cat {i} sat on a mat " * (i % 5 + 3) for i in range(60)], None]


def brute(text, buckets=10_000):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(low)
    return len(words), sorted(zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1))


def runs(texts):
    return [pair for n, r in importance.bucket_runs(pa.array(texts, pa.string())) for pair in zip(n.tolist(), map(list, r))]


@pytest.mark.parametrize("words", [1 << 17, 7])
def test_buckets_are_crc32_of_every_run(monkeypatch, words):
    monkeypatch.setattr(importance, "SLICE_WORDS", words)
    texts = TEXTS if words > 7 else TEXTS[10:20]
    assert runs(texts) == [brute(t) for t in texts]
    sliced = pa.array(["x y", *texts], pa.string()).slice(1)
    assert [p for n, r in importance.bucket_runs(sliced) for p in zip(n.tolist(), map(list, r))] == [brute(t) for t in texts]


def test_spans_longer_than_a_matrix(monkeypatch):
    monkeypatch.setattr(importance, "LONG_SPAN", 4)
    assert runs(TEXTS[:8]) == [brute(t) for t in TEXTS[:8]]


def plain(rows, target, percent=5, k=10_000):
    docs, wanted = [(i, *brute(t)) for i, t in rows], Counter(b for t in target for b in brute(t)[1])
    held = Counter(b for _, _, r in docs for b in r)
    s_all, t_all = sum(held.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + float(k)) / ((held[b] + 1.0) * (t_all + float(k))))) for b in range(k)]
    out = []
    for i, n, r in docs:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in r)
        out.append((i, n, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((o for o in out if o[1] >= 20), key=lambda o: (-o[4], o[0] is not None, o[0]))
    return out, order, percent * len(order) // 100


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_report_matches_rules(spark, percent):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[11]), (20, TEXTS[20]), (20, TEXTS[20])]
    target = ["the cat 3 sat", None, "w1 w2 w3"]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, score string, _row int").repartition(5)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = importance.importance_report(docs, wanted, percent=percent).collect()
    out, order, draw = plain(rows, target, percent)
    same = lambda rows: sorted(rows, key=repr)
    assert same((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == same((o[0], *o[2:]) for o in out)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, draw + 1))
    assert [(r["doc_id"], r["score"]) for r in drawn] == [(o[0], o[4]) for o in order[:draw]]
    texts = importance.resample(docs, wanted, percent=percent)
    assert texts.columns == docs.columns and {r["doc_id"] for r in texts.collect()} == {o[0] for o in order[:draw]}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(["a"] * 30))], "doc_id long, text string")
    none = docs.limit(0)
    assert importance.importance_report(none, docs).count() == 0
    assert importance.importance_report(docs, none, percent=100).first()["rank"] == 1


def test_runs_survive_packing():
    some = [np.sort(np.random.default_rng(i).integers(0, 65_536, i * 7)) for i in range(5)]
    found, bounds = importance._unpacked(pa.array([importance._packed(r) for r in some], pa.binary()))
    assert all((found[a:b] == r).all() and b - a == len(r) for r, a, b in zip(some, bounds, bounds[1:]))

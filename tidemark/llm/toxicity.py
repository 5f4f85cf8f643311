"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= k) = sigmoid(theta_k - w x): one weight vector for all grades, thresholds in order. The
features are counts and shares of all words and word beginnings of a bounded labelled sample, as
sparse rows; the output is the probability of each grade and the expected severity, sum over k of P(grade > k).

Labels say toxic or not. Toxic documents are graded by how much of them is made of words that tell
toxic from other documents: 1 below the median share of the toxic sample, 2 from it on.

Edge cases: a null text counts as empty and has the base severity; repeated rows get equal results;
without labelled rows of both classes every severity is that of the thresholds; very long texts
are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import hash_share

#: Lengths in bytes of the word beginnings that count as features.
STEMS = (4, 5, 6, 7)
_KEEP = {*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of letters and digits, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


def terms(text: str | None) -> dict[bytes, int]:
    """Counts of the words of a text and of their beginnings, ``STEMS`` bytes long and marked with ``*``."""
    out: dict[bytes, int] = Counter(words(text))
    for word, n in list(out.items()):
        for size in STEMS:
            if len(word) > size:
                stem = word[:size] + b"*"
                out[stem] = out.get(stem, 0) + n
    return out


class Sparse:
    """Rows of (index, value) pairs, with products by vectors from either side."""

    __array_ufunc__ = None
    dtype = np.dtype(np.float64)

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.shape = (len(rows), width)
        self._bounds = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows], dtype=np.int64)])
        self._at, self._value = np.empty(self._bounds[-1], np.int32), np.empty(self._bounds[-1], np.float32)
        for (i, v), a, b in zip(rows, self._bounds, self._bounds[1:]):
            self._at[a:b], self._value[a:b] = i, v

    def _blocks(self, rows: int = 256):
        """Some rows at a time: their numbers from the first on, indices and values."""
        for first in range(0, self.shape[0], rows):
            last = min(first + rows, self.shape[0])
            a, b = self._bounds[first], self._bounds[last]
            yield first, last, np.repeat(np.arange(last - first), np.diff(self._bounds[first : last + 1])), self._at[a:b], self._value[a:b]

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[0])
        for first, last, row, at, value in self._blocks():
            out[first:last] = np.bincount(row, value * weights[at], last - first)
        return out

    def __rmatmul__(self, pull: np.ndarray) -> np.ndarray:
        out = np.zeros(self.shape[1])
        for first, last, row, at, value in self._blocks(1024):
            out += np.bincount(at, value * pull[first:last][row], self.shape[1])
        return out


@dataclass
class OrdinalModel:
    """Column of each term, weights (counts, then shares) and thresholds; terms without a column weigh nothing."""

    columns: dict[bytes, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Index and value of each term of a text: log(1 + count), then log(1 + count per hundred words)."""
        found = words(text)
        counts: dict[int, int] = {}
        columns = self.columns
        for word, n in Counter(found).items():
            if (i := columns.get(word)) is not None:
                counts[i] = counts.get(i, 0) + n
            for size in STEMS:
                if len(word) > size and (i := columns.get(word[:size] + b"*")) is not None:
                    counts[i] = counts.get(i, 0) + n
        at, n = np.fromiter(counts, np.int32, len(counts)), np.fromiter(counts.values(), np.float64, len(counts))
        return np.concatenate([at, at + len(self.columns)]), np.concatenate([np.log1p(n), np.log1p(n * (100 / max(1, len(found))))])

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        at, values = self.features(text)
        return 1 / (1 + np.exp(np.clip(self.thresholds - values @ self.weights[at], -40, 40)))


def fit_ordinal(x: np.ndarray | Sparse, grade: np.ndarray, n_grades: int, l2: float = 1e-4, steps: int = 500, rate: float = 0.1):
    """Shared weights and ordered thresholds by full-batch Adam; gaps between thresholds are exponentials."""
    n, d = x.shape
    k = n_grades - 1
    p = np.zeros(d + k)
    share = [(np.sum(grade <= j) + 1) / (n + 2) for j in range(k)]
    base = np.log(np.array(share) / (1 - np.array(share)))
    p[d] = base[0]
    p[d + 1 :] = np.log(np.maximum(np.diff(base), 0.1))
    m, v = np.zeros_like(p), np.zeros_like(p)
    pad = lambda t: np.concatenate([[-np.inf], t, [np.inf]])
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        theta = pad(p[d] + np.concatenate([[0.0], np.cumsum(gaps)]))
        u = x @ p[:d].astype(x.dtype)
        hi, lo = sig(theta[grade + 1] - u), sig(theta[grade] - u)
        inside = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / inside, lo * (1 - lo) / inside
        g = np.empty_like(p)
        g[:d] = (dhi - dlo).astype(x.dtype) @ x / n + l2 * p[:d]
        per = np.array([(-dhi[grade == j].sum() + dlo[grade == j + 1].sum()) / n for j in range(k)])
        g[d] = per.sum()
        g[d + 1 :] = [per[j + 1 :].sum() * gaps[j] for j in range(k - 1)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:d], p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))])


def _found(sample: DataFrame) -> DataFrame:
    """``toxic, terms`` of each sampled document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [list(terms(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.binary()))], names=["toxic", "terms"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic int, terms array<binary>")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000, **options) -> OrdinalModel:
    """Fit on at most ``max_rows`` labelled documents, those with the smallest id hashes, with every term of theirs.

    Grades come from terms whose log odds are 4 deviations or more above even; terms of any rarity have weights. The
    driver receives (index, value) pairs only, never texts.
    """
    options = {"l2": 3e-4, "steps": 150} | options
    labelled = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # About twice as many rows as wanted pass the bound on the hash, however many partitions there are.
    near = labelled.filter(hash_share(F.xxhash64("doc_id")) * max(1, labelled.count()) <= 2 * max_rows + 64)
    known = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("toxic", "text")
    sizes = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return OrdinalModel({}, np.zeros(0), np.array([-30.0, 30.0]) if sizes.get(1) else np.array([30.0, 31.0]))
    seen = (
        _found(picked).select("toxic", F.explode("terms").alias("term")).groupBy("term")
        .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).toArrow().sort_by("term")
    )
    n_terms, pos, neg = seen.num_rows, seen["pos"].to_numpy().astype(float), seen["neg"].to_numpy().astype(float)
    odds = np.log((pos + 0.5) / (sizes[1] - pos + 0.5)) - np.log((neg + 0.5) / (sizes[0] - neg + 0.5))
    telling = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5)) > 4
    columns = {}
    for chunk in seen["term"].chunks:
        for term in chunk:
            columns[term.as_py()] = len(columns)
    blank = OrdinalModel(columns, np.zeros(0), np.array([0.0, 1.0]))
    del seen

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [blank.features(t) for t in batch.column(1).to_pylist()]
            made = [batch.column(0), pa.array([i.astype("<i4").tobytes() for i, _ in x], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in x], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["toxic", "at", "value"])

    got = picked.mapInArrow(rows, "toxic int, at binary, value binary").toArrow().sort_by([("toxic", "ascending"), ("at", "ascending"), ("value", "ascending")])
    toxic = got["toxic"].to_numpy()
    pairs = [(np.frombuffer(a.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4")) for a, v in zip(got["at"], got["value"])]
    x = Sparse(pairs, 2 * n_terms)
    del got, pairs
    share = x @ np.concatenate([np.zeros(n_terms), telling.astype(float)])
    grade = np.where(toxic == 0, 0, 1 + (share >= np.median(share[toxic == 1])))
    weights, thresholds = fit_ordinal(x, grade, 3, **options)
    return OrdinalModel(blank.columns, weights.astype(np.float32), thresholds)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``doc_id, expected_severity, p_mild, p_severe, grade, toxic`` for every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = np.array([model.above(t.as_py()) for t in batch.column(1)]).reshape(-1, 2)
            shares = np.column_stack([1 - over[:, 0], over[:, 0] - over[:, 1], over[:, 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(over.sum(axis=1)), pa.array(shares[:, 1]), pa.array(shares[:, 2]), pa.array(shares.argmax(axis=1).astype(np.int32)), pa.array(over[:, 0] >= cut)],
                names=["doc_id", "expected_severity", "p_mild", "p_severe", "grade", "toxic"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, expected_severity double, p_mild double, p_severe double, grade int, toxic boolean")

"""Quality classifier by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of ``words`` words. Each passage is encoded (byte shares, mean word
length and word count through one hidden layer), a gated attention tanh(V h) * sigmoid(U h) weighs
the passages, and a logistic unit scores the weighted mean. Only document labels are used.

Fitting takes at most ``max_rows`` labelled documents, those with the smallest id hashes; fitting and
scoring read every passage of every text. The passages to fit on lie in a file of the driver, and
gradients are summed over parts of a mini-batch, so that memory holds one part or one long text.

Edge cases: null and empty texts are one empty passage and get a score like any other; a passage is
cut at white space only, so a very long word is one passage; repeated rows get equal scores; with
no labelled rows, or labels of one class, the score is 1.0 or that class; other columns are ignored.
"""

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.workspace import written

N_FEATURES = 258
#: Passages of one part of a mini-batch, and of one row on the way to the driver.
PART_PASSAGES, ROW_PASSAGES = 32_768, 4096


def passages(text: str | None, words: int = 64) -> np.ndarray:
    """Feature rows of a text's passages: square roots of byte shares, mean word bytes, word count."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(data):
        return np.zeros((1, N_FEATURES), np.float32)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    starts = ~gap
    starts[1:] &= gap[:-1]
    bag = np.maximum(np.cumsum(starts) - 1, 0) // words
    n = int(bag[-1]) + 1
    counts = np.bincount(bag * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float32)
    size = np.bincount(bag[~gap], minlength=n)
    tokens = np.bincount(bag[starts], minlength=n)
    out = np.empty((n, N_FEATURES), np.float32)
    out[:, :256] = np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    out[:, 256] = np.minimum(size / np.maximum(tokens, 1), 40) / 10
    out[:, 257] = np.log1p(tokens) / 4
    return out


@dataclass
class Attention:
    """Weights of the network; ``scores`` takes stacked passages and the start of each bag."""

    params: dict[str, np.ndarray]
    mean: np.ndarray
    spread: np.ndarray

    def scores(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _forward(self.params, (rows - self.mean) / self.spread, starts)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> dict:
    h = np.tanh(x @ w["E"] + w["e"])
    t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    logit = (t * g) @ w["a"]
    bag = np.repeat(np.arange(len(starts)), np.diff([*starts, len(x)]))
    top = np.maximum.reduceat(logit, starts)
    weight = np.exp(logit - top[bag])
    weight /= np.add.reduceat(weight, starts)[bag]
    z = np.add.reduceat(weight[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "bag": bag, "weight": weight, "z": z, "p": _sigmoid(z @ w["c"] + w["b"][0])}


def _gradient(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(w, x, starts)
    d = (f["p"] - y) / len(y)
    dz = d[:, None] * w["c"]
    along = (dz[f["bag"]] * f["h"]).sum(axis=1)
    mean = np.add.reduceat(f["weight"] * along, starts)[f["bag"]]
    dl = f["weight"] * (along - mean)
    dt, dg = dl[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), dl[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["weight"][:, None] * dz[f["bag"]] + dt @ w["V"].T + dg @ w["U"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "E": x.T @ dx, "e": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ dl,
        "c": f["z"].T @ d, "b": np.array([d.sum()]),
    }


def _parts(batch: np.ndarray, bags: list[np.ndarray]) -> Iterator[list[int]]:
    """The bags of a mini-batch in runs of at most ``PART_PASSAGES`` passages, or of one bag."""
    part: list[int] = []
    size = 0
    for i in batch.tolist():
        if part and size + len(bags[i]) > PART_PASSAGES:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(bags[i])
    if part:
        yield part


def train(bags: list[np.ndarray], labels: list[int], hidden: int = 24, gate: int = 12, epochs: int = 25, rate: float = 0.01, l2: float = 1e-4, seed: int = 7) -> Attention:
    """Fit the network by Adam on mini-batches of 64 bags; classes are not reweighted."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float64)
    n, total, squares = sum(map(len, bags)) or 1, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for bag in bags:
        total += np.sum(bag, axis=0, dtype=np.float64)
        squares += np.square(bag, dtype=np.float64).sum(axis=0)
    mean = (total / n).astype(np.float32)
    spread = np.sqrt(np.maximum(squares / n - (total / n) ** 2, 0)).astype(np.float32) + np.float32(0.02)
    shapes = {"E": (N_FEATURES, hidden), "e": (hidden,), "V": (hidden, gate), "U": (hidden, gate), "a": (gate,), "c": (hidden,), "b": (1,)}
    w = {k: np.zeros(s) if k in "eb" else rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    if len(set(labels)) < 2:
        w["c"][:] = 0
        w["b"][0] = 30 if not labels or labels[0] else -30
        return Attention(w, mean, spread)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            sums = {k: l2 * w[k] if k not in "eb" else np.zeros_like(w[k]) for k in w}
            for pick in _parts(batch, bags):
                x = (np.concatenate([bags[i] for i in pick]).astype(np.float32) - mean) / spread
                starts = np.cumsum([0, *(len(bags[i]) for i in pick[:-1])])
                for k, g in _gradient(w, x, starts, y[pick]).items():
                    sums[k] += g * (len(pick) / len(batch))
            step += 1
            for k, g in sums.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= rate * (0.5 if epoch > epochs // 2 else 1) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Attention({k: v.astype(np.float32) for k, v in w.items()}, mean, spread)


def remainder(id_col: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000,
    words: int = 64, held_out: tuple[int, int] | None = (4, 2), **options,
) -> Attention:
    """Fit on all passages of labelled documents outside the held-out remainder; passages are encoded in tasks."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        known = known.filter(remainder("doc_id", held_out[0]) != held_out[1])
    known = (
        known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, y in zip(*(c.to_pylist() for c in batch.columns)):
                rows = passages(text, words).astype(np.float16)
                head = {"key": str(key), "text": hashlib.sha256((text or "").encode()).digest(), "y": y}
                source = uuid.uuid4().bytes
                for at in range(0, len(rows), ROW_PASSAGES):
                    part = rows[at : at + ROW_PASSAGES].tobytes()
                    yield pa.RecordBatch.from_pylist([head | {"source": source, "at": at, "rows": part}], schema=schema)

    schema = pa.schema([("key", pa.string()), ("text", pa.binary()), ("y", pa.int32()), ("source", pa.binary()), ("at", pa.int64()), ("rows", pa.binary())])
    encoded = written(
        picked.select("doc_id", "text", "quality").mapInArrow(encode, "key string, text binary, y int, source binary, at long, rows binary"), "passages"
    )
    found: dict[bytes, dict] = {}
    size = N_FEATURES * 2
    with tempfile.TemporaryFile() as file:
        for r in encoded.toLocalIterator():
            own = found.setdefault(bytes(r["source"]), {"order": (r["key"], bytes(r["text"])), "y": r["y"], "parts": []})
            own["parts"].append((r["at"], file.tell() // size, len(r["rows"]) // size))
            file.write(r["rows"])
        file.flush()
        bags, labels_ = [], []
        stored = np.memmap(file, np.float16, "r").reshape(-1, N_FEATURES) if found else None
        for own in sorted(found.values(), key=lambda o: o["order"]):
            parts = [(a, n) for _, a, n in sorted(own["parts"])]
            joined = all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
            bags.append(stored[parts[0][0] : sum(parts[-1])] if joined else np.concatenate([stored[a : a + n] for a, n in parts]))
            labels_.append(own["y"])
        return train(bags, labels_, **options)


def score_quality(
    docs: DataFrame, model: Attention, text_col: str = "text", words: int = 64, group: int = 256, cut: float = 0.7,
    score_col: str = "quality_score", ok_col: str = "quality_ok",
) -> DataFrame:
    """``docs`` with a score (0 to 1) and whether it reaches ``cut``; ``ValueError`` where ``docs`` has a column of such a name."""
    if clash := {score_col, ok_col} & set(docs.columns):
        raise ValueError(f"the table already has {sorted(clash)}; name other columns for the score")

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [np.zeros(0)]
            for at in range(0, len(texts), group):
                bags = [passages(t, words) for t in texts.iloc[at : at + group]]
                starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
                out.append(model.scores(np.concatenate(bags), starts).astype(np.float64))
            yield pd.Series(np.concatenate(out))

    return docs.withColumn(score_col, score(F.col(text_col))).withColumn(ok_col, F.col(score_col) >= cut)


def drop_poor(docs: DataFrame, model: Attention, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the model accepts; columns stay as they are, whatever their names."""
    scored = score_quality(docs, model, text_col, score_col="__tm_score", ok_col="__tm_ok", **options)
    return scored.filter("__tm_ok").select(*[F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicates, found by the generalised pigeonhole principle (Qin et al., 2018).

The 64 fingerprint bits are grouped into partitions that hold correlated bits together. Each
partition i gets a threshold t_i >= -1 with sum(t_i) = radius - partitions + 1: two fingerprints
within the radius then differ in at most t_i bits in some partition. Dynamic programming picks the
thresholds with the least estimated work. Every distinct fingerprint probes the values within t_i
of its own in partition i, and each candidate is verified by its whole distance.

Copies share a fingerprint and take part once, so groups of copies cost nothing; links join
distinct fingerprints, and components are found with written rounds. At the end the rows of hot
fingerprints (fewer than ``HOT``) meet their class by a broadcast, the others by a shuffle. The fit reads a bounded sample
of fingerprints; it shapes the work only, the result is exact for every fit.

Edge cases: a null text counts as empty and has fingerprint zero; texts below ``shingle`` words are
one shingle; a null id sorts after every other, so a component of null ids only has a null id;
repeated rows are separate rows of one component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.workspace import hash_share, hot, written

SEED = 42
BITS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of a text, repeats included, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    first = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, ends[width - 1 :].tolist())], dtype="<u8")
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, th, fp`` per row; ``th`` is a hash of the text, ``fp`` the fingerprint as a signed long."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "th", "fp"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit groups and their thresholds; ``masks[i]`` selects the bits of group i."""

    groups: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]

    @property
    def masks(self) -> list[int]:
        return [sum(1 << b for b in g) for g in self.groups]

    def flips(self, i: int) -> list[int]:
        """Values to xor with partition i of a probe, all of weight up to its threshold."""
        return [sum(1 << b for b in pick) for k in range(self.thresholds[i] + 1) for pick in combinations(self.groups[i], k)]


def group_bits(sample: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Greedy groups of equal width: each takes the free bit most correlated with its bits so far."""
    width = -(-BITS // parts)
    free = list(range(BITS))
    if len(sample) > 1:
        bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(float)
        bits -= bits.mean(axis=0)
        spread = np.sqrt((bits**2).sum(axis=0))
        related = np.abs(bits.T @ bits) / np.maximum(np.outer(spread, spread), 1e-12)
    else:
        related = np.zeros((BITS, BITS))
    np.fill_diagonal(related, 0)
    groups = []
    while free:
        seed = max(free, key=lambda b: (related[b, free].max(), -b))
        group = [seed]
        free.remove(seed)
        while free and len(group) < width:
            pick = max(free, key=lambda b: (related[b, group].mean(), -b))
            group.append(pick)
            free.remove(pick)
        groups.append(tuple(sorted(group)))
    return tuple(groups)


def allocate(cost: list[list[float]], radius: int) -> tuple[int, ...]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 and the least total ``cost[i][t_i + 1]``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, picked) in best.items():
            for u in range(radius + 2 - used):
                new = (total + row[u], picked + (u - 1,))
                if used + u not in step or new < step[used + u]:
                    step[used + u] = new
        best = step
    return best[radius + 1][1]


def make_plan(sample: np.ndarray, n_prints: int, radius: int = 3, parts: int = 2, verify_cost: float = 4.0) -> Plan:
    """Group bits by the sample and allocate thresholds by the probes and candidates they would cost."""
    groups = group_bits(sample, parts)
    n_prints = max(1, n_prints)  # without any, every allocation would cost the same
    cost = []
    for g in groups:
        mask = np.uint64(sum(1 << b for b in g))
        seen = np.zeros(BITS + 1)
        for at in range(0, len(sample), 256):
            apart = np.bitwise_count((sample[at : at + 256, None] ^ sample[None]) & mask)
            seen += np.bincount(apart.ravel(), minlength=BITS + 1)
        seen[0] -= len(sample)
        within = np.cumsum(seen) / max(1, len(sample) * (len(sample) - 1)) * float(n_prints) ** 2
        probes = np.cumsum([comb(len(g), k) for k in range(radius + 1)]) * float(n_prints)
        cost.append([0.0, *(probes[t] + verify_cost * within[t] for t in range(radius + 1))])
    return Plan(groups, allocate(cost, radius))


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def links(prints: DataFrame, plan: Plan, radius: int = 3) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints in column ``fp`` that differ in ``radius`` bits or fewer."""
    live = [i for i, t in enumerate(plan.thresholds) if t >= 0]
    part = lambda i: F.col("fp").bitwiseAND(_signed(plan.masks[i]))
    kept = F.array(*[F.struct(F.lit(i).alias("part"), part(i).alias("key")) for i in live])
    sought = F.array(
        *[F.struct(F.lit(i).alias("part"), part(i).bitwiseXOR(_signed(m)).alias("key")) for i in live for m in plan.flips(i)]
    )
    index = prints.select(F.col("fp").alias("b"), F.inline(kept))
    probes = prints.select(F.col("fp").alias("a"), F.inline(sought))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return probes.join(index, ["part", "key"]).filter((F.col("a") < F.col("b")) & close).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, parts: int = 2, sample: int = 4096
) -> DataFrame:
    """``doc_id, th, fp, rep`` per row; ``rep`` (struct of doc_id and th) is the least row of its component.

    ``sample`` bounds the fingerprints that shape the plan, those with the smallest hashes.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    prints = written(rows.groupBy("fp").agg(least, F.count("*").alias("n")), "distinct-prints")
    n_prints, n_rows = prints.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # About twice the sample passes the bound on the hash, however many partitions there are.
    near = prints.select("fp").filter(hash_share(F.xxhash64("fp")) * max(1, n_prints) <= 2 * sample + 64)
    picked = [r[0] for r in near.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()]
    plan = make_plan(np.array(picked, dtype=np.int64).view(np.uint64), n_prints, radius, parts)
    roots = components(links(prints.select("fp"), plan, radius))
    classed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least", "n"
    )
    heads = classed.filter("root <> fp").groupBy("root").agg(F.min("least").alias("other"))
    own = classed.filter("root = fp").join(heads, "root", "left")
    by_root = own.select("root", F.when(F.col("other") < F.col("least"), F.col("other")).otherwise(F.col("least")).alias("rep"))
    found = written(classed.select("fp", "root", "n").join(by_root, "root").select("fp", "n", F.struct("rep.doc_id", "rep.th").alias("rep")), "classes")
    many = found.filter(hot(found, "n", n_rows)).select("fp", "rep")
    few = found.filter(~hot(found, "n", n_rows)).select("fp", "rep")
    # Fingerprints that many rows share are joined where the rows lie.
    rest = rows.join(F.broadcast(many.select(F.col("fp").alias("_hot"))), F.col("fp") == F.col("_hot"), "left_anti")
    return rows.join(F.broadcast(many), "fp").unionByName(rest.join(few, "fp")).select("doc_id", "th", "fp", "rep")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; columns stay as they are."""
    found = near_duplicates(docs, id_col, text_col, **options)
    kept = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th")))
        .select(F.col("doc_id").alias("__tm_id"), F.col("th").alias("__tm_th")).distinct()
    )
    own = docs.withColumn("__tm_own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    match = F.col(id_col).eqNullSafe(F.col("__tm_id")) & (F.col("__tm_own") == F.col("__tm_th"))
    return own.join(kept, match).dropDuplicates(["__tm_id", "__tm_th"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def component_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``."""
    found = near_duplicates(docs, id_col, text_col, **options)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep.doc_id").alias("component_id")
    )

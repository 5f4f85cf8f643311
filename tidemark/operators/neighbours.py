"""Exact nearest neighbours: the base is written once, cut into cells by a k-d tree, and every query looks through the cells that may matter.

Neither side is ever paired with the other on disk. A task holds one batch of queries with their finds so far, one block
of a cell, and a bounded store of cells that it read before; the tree comes from a bounded sample, and only shapes the cells.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.staging import fresh_path, opened, staged

FOUND = "id long, neighbour long, distance double"
#: At most so many rows of the base shape the tree, and so many bytes of cells stay in a task.
SAMPLE, STORE = 131_072, 64 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if column.null_count or len(set(lengths)) > 1:
        raise ValueError("vectors of unequal length")
    return flat.astype(float).reshape(len(column), -1)


def kd_cuts(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of ``(dimension, cut, left, right)`` with about ``cells`` cells; a negative child ``-1 - c`` is cell c."""
    nodes: list = []
    made, todo = 0, [(np.arange(len(x)), cells, None, 0)]
    while todo:
        rows, want, parent, side = todo.pop()
        part = x[rows]
        wide = part.max(0) - part.min(0) if len(rows) else np.zeros(0)
        spread = np.where(wide > 0, np.nan_to_num(part.std(0)) if len(rows) else 0, 0)
        if want <= 1 or not len(wide) or not spread.max() > 0:
            at, made = -1 - made, made + 1
        else:
            dim = int(spread.argmax())
            values = part[:, dim]
            cut = float(np.median(values))
            # The greater side is never empty.
            cut = cut if cut < values.max() else float(values[values < values.max()].max())
            at = len(nodes)
            nodes.append([dim, cut, -1, -1])
            low = values <= cut
            todo += [(rows[~low], want - want // 2, at, 3), (rows[low], want // 2, at, 2)]
        if parent is not None:
            nodes[parent][side] = at
    return [tuple(n) for n in nodes]


def cell_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    todo = [(np.arange(len(x)), 0)] if nodes else []
    while todo:
        rows, at = todo.pop()
        if at < 0:
            out[rows] = -1 - at
        elif len(rows):
            dim, cut, left, right = nodes[at]
            low = x[rows, dim] <= cut
            todo += [(rows[low], left), (rows[~low], right)]
    return out


class _Cells:
    """Blocks of the written cells, those read last kept."""

    def __init__(self, files: dict[int, list[str]], block: int):
        self.files, self.block = files, block
        self.kept: OrderedDict[int, list] = OrderedDict()
        self.bytes = 0

    def blocks(self, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if cell in self.kept:
            self.kept.move_to_end(cell)
            yield from self.kept[cell]
            return
        held: list | None = []
        size = 0
        for path in self.files[cell]:
            with opened(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(self.block, columns=["id", "v"]):
                    made = (batch["id"].to_numpy(), _matrix(batch["v"]))
                    yield made
                    size += made[0].nbytes + made[1].nbytes
                    # A cell of many equal rows is read anew each time.
                    held = held + [made] if held is not None and size <= STORE // 8 else None
        if held is not None:
            self.kept[cell], self.bytes = held, self.bytes + size
            while self.bytes > STORE:
                _, old = self.kept.popitem(last=False)
                self.bytes -= sum(i.nbytes + x.nbytes for i, x in old)


class _Finds:
    """The ``k`` nearest rows found so far of each query, smaller ids first where distances are equal."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.far, self.who = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def see(self, rows: np.ndarray, others: np.ndarray, x: np.ndarray) -> None:
        """Takes what of ``x`` is near to the queries ``rows``."""
        for at in range(0, len(rows), 512):
            own = rows[at : at + 512]
            q = self.q[own]
            norms = (q**2).sum(1)[:, None] + (x**2).sum(1)[None]
            apart = norms - 2 * q @ x.T
            # More than the products lose by rounding, so that nothing at the k-th distance is missed.
            slack = 1e-9 * norms.max(axis=1)
            apart[self.ids[own][:, None] == others[None]] = np.inf
            limit = self.far[own, -1] ** 2
            loose = np.isinf(limit)
            if loose.any():
                last = min(self.k, apart.shape[1]) - 1
                limit[loose] = np.partition(apart[loose], last, axis=1)[:, last] if last + 1 == self.k else np.inf
            row, col = np.nonzero((apart <= (limit + slack)[:, None]) & np.isfinite(apart))
            if not len(row):
                continue
            exact = np.empty(len(row))
            for s in range(0, len(row), 65_536):
                exact[s : s + 65_536] = np.sqrt(((q[row[s : s + 65_536]] - x[col[s : s + 65_536]]) ** 2).sum(1))
            # Finds of before and new ones, in order.
            met = np.unique(row)
            where = np.concatenate([np.repeat(met, self.k), row])
            far, who = np.concatenate([self.far[own[met]].ravel(), exact]), np.concatenate([self.who[own[met]].ravel(), others[col]])
            order = np.lexsort((who, far, where))
            where, far, who = where[order], far[order], who[order]
            place = np.arange(len(where)) - np.searchsorted(where, where)
            first = place < self.k
            self.far[own[where[first]], place[first]] = far[first]
            self.who[own[where[first]], place[first]] = who[first]

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.who[row, col]), pa.array(self.far[row, col])], ["id", "neighbour", "distance"])


def _gaps(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from queries to the boxes of cells, a little less than they are."""
    out = np.zeros((len(q), len(low)))
    for d in range(q.shape[1]):
        out += np.fmax(np.fmax(low[None, :, d] - q[:, d, None], q[:, d, None] - high[None, :, d]), 0.0) ** 2
    return out * (1 - 1e-9)


def nearest(queries: DataFrame, base: DataFrame, k: int = 5, vector: str = "vec", id_col: str = "vec_id", block: int = 4096, query_group: int = 2048, base_group: int = 2048) -> DataFrame:
    """``id, neighbour, distance, rank``: exact k nearest rows of ``base`` for each query, smaller ids first where distances are equal.

    Cells hold about ``base_group`` rows; equal rows share one, whatever their number, and it is read in blocks. Queries
    go in order of cells, ``query_group`` at once: first through their own cell, then through every cell whose box
    is no farther than their k-th find. Where boxes part nothing that is all cells, but what is written stays one copy of each side.
    """
    spark = base.sparkSession
    sides = [d.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")) for d in (queries, base)]
    left, right = (staged(d, what)[0] for d, what in zip(sides, ("near-queries", "near-base")))
    n_queries, n_base = left.count(), right.count()
    cells = max(1, -(-n_base // base_group))
    share = min(SAMPLE, 64 * cells) / max(1, n_base)
    drawn = right if share >= 1 else right.filter(F.xxhash64(F.lit(11), "id") / F.lit(2.0**64) + 0.5 <= share)
    rows = drawn.select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
    nodes = kd_cuts(_matrix(rows), cells) if len(rows) else []

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("cell", pa.array(cell_of(_matrix(batch["v"]), nodes)))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for batch in batches:
            x, own = _matrix(batch["v"]), batch["cell"].to_numpy()
            for c in np.unique(own).tolist():
                part = x[own == c]
                low[c] = np.fmin(low.get(c, np.inf), np.fmin.reduce(part))
                high[c] = np.fmax(high.get(c, -np.inf), np.fmax.reduce(part))
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), pa.array([v.tolist() for v in low.values()]), pa.array([v.tolist() for v in high.values()])], ["cell", "low", "high"])

    parts = lambda n: max(1, min(4096, -(-n // 8192)))
    held = right.mapInArrow(celled, "id long, v array<double>, cell int").repartitionByRange(parts(n_base), "cell", "id").sortWithinPartitions("cell")
    path = fresh_path(spark, "near-cells")
    held.write.partitionBy("cell").parquet(path)
    written = spark.read.schema("id long, v array<double>, cell int").parquet(path)
    files: dict[int, list[str]] = {}
    for file in sorted(written.inputFiles()):
        files.setdefault(int(file.rsplit("cell=", 1)[1].split("/")[0]), []).append(file)
    low, high = {}, {}
    # A row per cell and task.
    for r in written.mapInArrow(boxes, "cell int, low array<double>, high array<double>").toLocalIterator():
        low[r["cell"]] = np.fmin(low.get(r["cell"], np.inf), np.array(r["low"]))
        high[r["cell"]] = np.fmax(high.get(r["cell"], -np.inf), np.array(r["high"]))
    names = sorted(files)
    shared = spark.sparkContext.broadcast((nodes, files, np.array([low[c] for c in names]), np.array([high[c] for c in names])))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, paths, lows, highs = shared.value
        store = _Cells(paths, block)
        for batch in batches:
            for at in range(0, batch.num_rows, query_group):
                some = batch.slice(at, query_group)
                finds = _Finds(some["id"].to_numpy(), _matrix(some["v"]), k)
                if not names:
                    continue
                gap = _gaps(finds.q, lows, highs)
                home = gap.argmin(axis=1)
                for c in np.unique(home).tolist():
                    for others, x in store.blocks(names[c]):
                        finds.see(np.flatnonzero(home == c), others, x)
                least = gap.min(axis=0)
                for c in np.argsort(least, kind="stable").tolist():
                    if least[c] > (finds.far[:, -1] ** 2).max():
                        break
                    rows = np.flatnonzero((home != c) & (gap[:, c] <= finds.far[:, -1] ** 2))
                    if len(rows):
                        for others, x in store.blocks(names[c]):
                            finds.see(rows, others, x)
                yield finds.rows()

    dealt = left.mapInArrow(celled, "id long, v array<double>, cell int").repartitionByRange(max(1, min(8192, -(-n_queries // query_group))), "cell", "id").sortWithinPartitions("cell")
    near = dealt.mapInArrow(search, FOUND)
    order = Window.partitionBy("id").orderBy("distance", "neighbour")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

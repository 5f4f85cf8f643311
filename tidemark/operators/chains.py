"""Chained starts: a chain begins at a first row, and each next start is the first row ``span`` seconds after the last.

Anchored windows and active timeouts are such chains; with ``idle``, a row that comes later than that after
the one before it is a start too. Where a chain runs depends on all rows before, so a key's rows are cut
into blocks of ``spans`` spans. Each block gets a map from the start that is open when it begins to the one
that is open when it ends: only the rows of a block's first span (and one more) can be its first start, so
the map has as many entries, and it is advanced for all of them at once. The maps of a key are composed in
order, a row per block; then every block, with its entry known, marks its starts on its own. Within a batch
of rows starts are marked by doubling the pointers from each row to the next start after it.

Equal times are one row with a count. Null times are left out; null keys are keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import staged

FAR = float("inf")


def first_after(times: np.ndarray, starts: np.ndarray, span: float) -> np.ndarray:
    """Index of the first time t with ``t - start >= span`` as doubles compare, for each start."""
    at = np.searchsorted(times, starts + span)
    padded = np.concatenate([[-FAR], times, [FAR]])
    while (early := padded[at] - starts >= span).any():
        at = at - early
    while (late := padded[at + 1] - starts < span).any():
        at = at + late
    return at


def mark_starts(times: np.ndarray, resets: np.ndarray, first: int, span: float) -> np.ndarray:
    """Which rows are starts, from the one at index ``first`` on: pointers to the next start, doubled."""
    n = len(times)
    after = np.append(np.flatnonzero(resets), n)
    reset = after[np.searchsorted(after, np.arange(1, n + 1))]
    jump = np.append(np.minimum(first_after(times, times, span), reset), n)
    marked = np.zeros(n + 1, bool)
    marked[first] = True
    while first < n and jump[first] < n:
        marked[jump[marked]] = True
        jump = jump[jump]
    marked[jump[marked]] = True
    return marked[:n]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, slice]]:
    """Key, block and rows of each stretch of one block in a batch that is sorted by both."""
    keys = batch.column("_key").dictionary_encode()
    codes, names = keys.indices.to_numpy(), keys.dictionary
    blocks = batch.column("_block").to_numpy()
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(codes)]):
        if b > a:
            yield names[codes[a]].as_py(), int(blocks[a]), slice(a, b)


class _Map:
    """The map of one block while its rows pass: possible first starts, and the start that each leads to so far.

    ``reset`` tells that the last of them is a start whatever was open before. Without a span only the
    first row and the first reset matter.
    """

    def __init__(self, edge: float, first: float):
        self.edge, self.first, self.last = edge, first, first
        self.open, self.reset, self.entries, self.now = True, False, np.zeros(0), np.zeros(0)

    def feed(self, times: np.ndarray, span: float, idle: float) -> None:
        resets = np.flatnonzero(np.diff(times, prepend=self.last) > idle)
        taken = np.zeros(0, np.int64)
        if self.open:
            # Rows up to the first one a span into the block, or to the first reset.
            edge, reset = int(np.searchsorted(times, self.edge)), int(resets[0]) if len(resets) else len(times)
            end = min(edge, reset)
            taken = np.arange(min(end + 1, len(times)))
            if span == FAR:
                taken = np.array([i for i in (0, reset) if i < len(times) and (i or not len(self.entries))], np.int64)
            self.reset = reset <= edge and reset < len(times)
            self.open = end >= len(times)
        at = np.concatenate([np.full(len(self.now), -1), taken])
        self.entries, self.now = np.concatenate([self.entries, times[taken]]), np.concatenate([self.now, times[taken]])
        after = np.append(resets, len(times))
        while True:
            step = np.minimum(np.maximum(first_after(times, self.now, span), at + 1), after[np.searchsorted(after, at + 1)])
            moving = step < len(times)
            if not moving.any():
                break
            at[moving] = step[moving]
            self.now[moving] = times[step[moving]]
        self.last = float(times[-1])


def _maps(rows: DataFrame, width: float, span: float, idle: float) -> DataFrame:
    """``_key, _block, first, last, reset, entries, exits`` of each block, from rows sorted within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, int] | None = None
        own: _Map | None = None

        def row(key: str, block: int, m: _Map) -> dict:
            return {"_key": key, "_block": block, "first": m.first, "last": m.last, "reset": m.reset, "entries": m.entries.tolist(), "exits": m.now.tolist()}

        for batch in batches:
            times, done = batch.column("ts").to_numpy(), []
            for key, block, part in _runs(batch):
                if (key, block) != held:
                    if own:
                        done.append(row(*held, own))
                    held, own = (key, block), _Map(block * width + span, float(times[part.start]))
                own.feed(times[part], span, idle)
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if own:
            yield pa.RecordBatch.from_pylist([row(*held, own)], schema=schema)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("_key", pa.string()), ("_block", pa.int64()), ("first", pa.float64()), ("last", pa.float64()), ("reset", pa.bool_()), ("entries", doubles), ("exits", doubles)])
    return rows.mapInArrow(run, "_key string, _block long, first double, last double, reset boolean, entries array<double>, exits array<double>")


def _entries(maps: DataFrame, span: float, idle: float) -> DataFrame:
    """``_key, _block, start, before``: the start that is open when a block begins, and the last row before it; null for a key's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start, before = None, None, None
        for batch in batches:
            out = []
            for i, (key, block, first, last, reset) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_key", "_block", "first", "last", "reset")))):
                if key != held:
                    held, start, before = key, None, None
                out.append((key, block, start, before))
                entries, exits = (batch.column(c)[i].values.to_numpy() for c in ("entries", "exits"))
                fresh = start is None or first - before > idle
                at = 0 if fresh else int(first_after(entries, np.array([start]), span)[0])
                at = min(at, len(entries) - 1) if reset else at
                if at < len(exits):
                    start = float(exits[at])
                before = last
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "_block", "start", "before"])

    types = (pa.string(), pa.int64(), pa.float64(), pa.float64())
    ordered = maps.repartition("_key").sortWithinPartitions("_key", "_block")
    return ordered.mapInArrow(run, "_key string, _block long, start double, before double")


def _marked(rows: DataFrame, span: float, idle: float) -> DataFrame:
    """``_key, start, last, n`` of each stretch of rows that a batch holds of a chain link; an entry row (``n`` 0) comes before a block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, start, before = None, None, None
        for batch in batches:
            times, counts = batch.column("ts").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            given, seen = batch.column("start").to_numpy(zero_copy_only=False), batch.column("before").to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], []]
            for key, block, part in _runs(batch):
                if (key, block) != held:
                    held, start, before = (key, block), None, None
                a, b = part.start, part.stop
                if counts[a] == 0:
                    start, before = (None, None) if np.isnan(given[a]) else (float(given[a]), float(seen[a]))
                    a += 1
                if a == b:
                    continue
                t, n = times[a:b], counts[a:b]
                resets = np.diff(t, prepend=t[0] if before is None else before) > idle
                first = 0
                if start is not None:
                    hits = np.flatnonzero(resets)
                    first = min(int(first_after(t, np.array([start]), span)[0]), int(hits[0]) if len(hits) else len(t))
                marked = mark_starts(t, resets, first, span)
                at = np.flatnonzero(marked)
                if first > 0:
                    at = np.concatenate([[0], at])
                ends = np.append(at[1:], len(t))
                begins = t[at]
                if first > 0:
                    begins[0] = start
                total = np.concatenate([[0], np.cumsum(n)])
                for column, values in zip(out, ([key] * len(at), begins, t[ends - 1], total[ends] - total[at])):
                    column.extend(values)
                start, before = float(begins[-1]), float(t[-1])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["_key", "start", "last", "n"])

    types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
    return rows.mapInArrow(run, "_key string, start double, last double, n long")


def chain_starts(rows: DataFrame, keys: Sequence[str], ts: str = "ts", span: float = FAR, idle: float = FAR, spans: int = 4096, width: float | None = None) -> DataFrame:
    """``keys, start, last, n``: each link of each key's chain with its first and last time and its number of rows.

    A block is ``width`` seconds, else ``spans`` times the span (the idle time where there is no span).
    """
    width = width or spans * (span if span < FAR else idle)
    key = F.to_json(F.struct(*keys))
    fields = rows.select(*keys).schema
    timed = rows.filter(F.col(ts).isNotNull()).select(key.alias("_key"), F.floor(F.col(ts) / width).cast("long").alias("_block"), F.col(ts).cast("double").alias("ts"))
    counted = timed.groupBy("_key", "_block", "ts").agg(F.count("*").alias("n"))
    reach = timed.agg(F.min("_block"), F.max("_block")).first()
    ready = counted.select("_key", "_block", "ts", "n", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("before"))
    if reach[0] != reach[1]:
        counted, _ = staged(counted, "times")
        ordered = counted.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "ts")
        maps, _ = staged(_maps(ordered, width, span, idle), "chain-maps")
        heads = _entries(maps, span, idle).select("_key", "_block", F.lit(-FAR).alias("ts"), F.lit(0).cast("long").alias("n"), "start", "before")
        ready = counted.select("_key", "_block", "ts", "n", F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("before")).unionByName(heads)
    ordered = ready.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "ts")
    links = _marked(ordered, span, idle).groupBy("_key", "start").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    return links.select(F.from_json("_key", fields).alias("_k"), "start", "last", "n").select(*[F.col(f"_k.{k}").alias(k) for k in keys], "start", "last", "n")


def in_links(rows: DataFrame, links: DataFrame, keys: Sequence[str], ts: str = "ts", grain: float = 3600.0) -> DataFrame:
    """``rows`` with the ``start`` of their link: an equi-join on key and time cell with the interval as residue."""
    cells = links.select(
        *[F.col(k).alias(f"_{k}") for k in keys], "start", "last", F.explode(F.sequence(F.floor(F.col("start") / grain), F.floor(F.col("last") / grain))).alias("_cell")
    )
    same = F.col("_cell") == F.floor(F.col(ts) / grain)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    held = rows.join(cells, same & F.col(ts).between(F.col("start"), F.col("last")))
    return held.drop("_cell", "last", *[f"_{k}" for k in keys])

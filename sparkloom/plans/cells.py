"""Triangles of directed edges without a row for any open pair: vertices have colours, and a cell closes pairs of two colours.

Edges run from the lower to the higher end of some order.  The cell (k, l) gets all edges from colour k to colour l, which it
holds, and the neighbours of colours k and l of each vertex u, which pass by.  Of u, v and w the triangle is found once, in the cell
of the colours of v and w; there the neighbours of v are looked up among those of u.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 8_000_000  # edges that a cell holds, about
PASSED = 18_000_000  # edges of which a slice's vertices pass by, about, for each colour
CHUNK = 200_000  # edges that are dealt out at once
MARKS = 1 << 25  # bytes of marks in a cell
OPENED = 1 << 20  # pairs that are looked up at once, about


def cells_of(edges: int) -> tuple[int, int]:
    """Colours and slices for so many edges. Each edge is sent to at most ``2 * colours - 1 + slices`` cells, of which there are ``colours ** 2 * slices``."""
    colours = max(math.ceil(math.sqrt(edges / HELD)), min(3, math.ceil(math.sqrt(edges / 250_000))), 1)
    return colours, max(1, math.ceil(edges / (colours * PASSED)))


def closed(edges: DataFrame, count: int, wide: bool, cells: Callable[[int], tuple[int, int]] = cells_of) -> DataFrame:
    """``v1, v2, v3``, ascending, of about ``count`` edges (low, high) of type long; they may repeat. Without ``wide`` ids fit 32 bits."""
    colours, slices = cells(count)
    if wide:
        by_low = edges.select("low", "high").repartition("low").sortWithinPartitions("low", "high")
    else:  # both ends are one number
        both = edges.select(F.shiftleft("low", 32).bitwiseOR(F.col("high").bitwiseAND(0xFFFFFFFF)).alias("both"))
        by_low = both.repartition(F.shiftright("both", 32)).sortWithinPartitions("both")
    sent = by_low.mapInArrow(lambda batches: _dealt(batches, colours, slices, pa.int64() if wide else pa.int32()), "cell int, held boolean, lists binary")
    by_cell = sent.repartition(4 * colours * colours * slices, "cell").sortWithinPartitions("cell", F.col("held").desc())
    return by_cell.mapInArrow(lambda batches: _closed(batches, colours, slices), "v1 long, v2 long, v3 long")


def _colour(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def _slice(ids: np.ndarray, n: int) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(35)) % np.uint64(n)).astype(np.int64)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _by_low(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole vertices with their distinct edges, CHUNK edges or more at a time."""
    held, n = [], 0
    for batch in batches:
        ends = [batch.column(c).to_numpy() for c in range(batch.num_columns)]
        held.append(ends if len(ends) == 2 else [ends[0] >> 32, ends[0].astype(np.int32).astype(np.int64)])
        n += batch.num_rows
        if n >= CHUNK:
            low, high = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(low, low[-1]))
            held, n = [[low[cut:], high[cut:]]], len(low) - cut
            if cut:
                yield _once(low[:cut], high[:cut])
    if n:
        yield _once(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _once(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fresh = np.ones(len(low), dtype=bool)
    fresh[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[fresh], high[fresh]


def _dealt(batches: Iterator[pa.RecordBatch], colours: int, slices: int, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
    for low, high in _by_low(batches):
        new = np.ones(len(low), dtype=bool)
        new[1:] = low[1:] != low[:-1]
        u = low[new]
        key = (np.cumsum(new) - 1) * colours + _colour(high, colours)
        values = high[np.argsort(key, kind="stable")].astype(ids.to_pandas_dtype())
        counts = np.bincount(key, minlength=len(u) * colours)
        starts = (np.cumsum(counts) - counts).reshape(-1, colours)
        counts = counts.reshape(-1, colours)

        def sent(rows: np.ndarray, *of: int) -> bytes:
            lists = {"u": pa.array(u[rows])}  # noqa: B023
            for name, k in zip("ab", of, strict=False):
                lists[f"{name}_size"] = pa.array(counts[rows, k].astype(np.int32))  # noqa: B023
                lists[name] = np.diff(values[_ranges(starts[rows, k], counts[rows, k])], prepend=values.dtype.type(0))  # noqa: B023
            return _packed(lists)

        own, part = _colour(u, colours), _slice(u, slices)
        rows_out: list[tuple[int, bool, bytes]] = []
        for k in range(colours):
            for c in range(colours):
                if len(rows := np.flatnonzero((own == c) & (counts[:, k] > 0))):
                    lists = sent(rows, k)
                    rows_out += [((c * colours + k) * slices + s, True, lists) for s in range(slices)]
                both = (counts[:, k] > (k == c)) & (counts[:, c] > 0)
                for s in range(slices):
                    if len(rows := np.flatnonzero(both & (part == s))):
                        rows_out.append(((k * colours + c) * slices + s, False, sent(rows, k, *[c] * (k != c))))
        cell, held, lists = zip(*rows_out, strict=True) if rows_out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(held, pa.bool_()), pa.array(lists, pa.binary())], names=["cell", "held", "lists"])


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    """The columns, of whatever lengths, each as a compressed batch of its own."""
    out = pa.BufferOutputStream()
    for name, values in columns.items():
        batch = pa.RecordBatch.from_arrays([pa.array(values)], names=[name])
        with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    """Differences are summed up again; sums wrap around as differences did."""
    source, found = pa.BufferReader(data), {}
    while source.tell() < source.size():
        with pa.ipc.open_stream(source) as reader:
            table = reader.read_all()
        name, values = table.column_names[0], table.column(0).to_numpy()
        found[name] = np.cumsum(values, dtype=values.dtype) if name in ("a", "b") else values.astype(np.int64)
    return found


class _Held:
    """The edges of a cell: vertices ``v`` in order, of each a range of ``codes``, which are places in the vertices ``w``."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        v, sizes, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*rows, strict=True)) or [()] * 3))
        order = np.argsort(v)
        self.v, self.sizes, self.starts = v[order], sizes[order], (np.cumsum(sizes) - sizes)[order]
        self.w, codes = np.unique(ends, return_inverse=True)
        self.codes = codes.astype(np.int32)
        self.at_once = max(1, min(4096, MARKS // max(1, len(self.w))))
        self.marks = np.zeros(self.at_once * len(self.w), dtype=bool)

    def close(self, u: np.ndarray, a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Triangles of at most ``at_once`` vertices ``u``; ``a`` and ``b`` are neighbours of those with the numbers ``of_a`` and ``of_b``."""
        at = np.searchsorted(self.w, b)
        known = self.w[np.minimum(at, len(self.w) - 1)] == b
        marked = of_b[known] * len(self.w) + at[known]
        self.marks[marked] = True
        at = np.minimum(np.searchsorted(self.v, a), len(self.v) - 1)
        known = np.flatnonzero(self.v[at] == a)
        at, a, of_a = at[known], a[known], of_a[known]
        total = np.cumsum(self.sizes[at])
        cut = 0
        while cut < len(at):
            end = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + OPENED, side="right")))
            sizes = self.sizes[at[cut:end]]
            w = self.codes[_ranges(self.starts[at[cut:end]], sizes)]
            hit = np.flatnonzero(self.marks[np.repeat(of_a[cut:end] * len(self.w), sizes) + w])
            if len(hit):
                edge = cut + np.searchsorted(np.cumsum(sizes), hit, side="right")
                yield u[of_a[edge]], a[edge], self.w[w[hit]]
            cut = end
        self.marks[marked] = False


def _closed(batches: Iterator[pa.RecordBatch], colours: int, slices: int) -> Iterator[pa.RecordBatch]:
    """Rows come by cell, those that are held first."""
    now, rows, block = None, [], None
    for batch in batches:
        for cell, held, data in zip(*(batch.column(c) for c in range(3)), strict=True):
            if cell.as_py() != now:
                now, rows, block = cell.as_py(), [], None
            lists = _unpacked(data.as_buffer())
            u, a_size, a = lists["u"], lists["a_size"], lists["a"]
            if held.as_py():
                rows.append((u, a_size, a))
                continue
            if block is None:
                block, rows = _Held(rows), []
            if not len(block.v):
                continue
            b_size, b = lists.get("b_size", a_size), lists.get("b", a)
            a_end, b_end = np.concatenate([[0], np.cumsum(a_size)]), np.concatenate([[0], np.cumsum(b_size)])
            for x in range(0, len(u), block.at_once):
                y = min(x + block.at_once, len(u))
                numbers = np.arange(y - x)
                part = a[a_end[x] : a_end[y]], np.repeat(numbers, a_size[x:y]), b[b_end[x] : b_end[y]], np.repeat(numbers, b_size[x:y])
                for found in block.close(u[x:y], *part):
                    ordered = np.sort(np.stack([c.astype(np.int64) for c in found]), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in ordered], names=["v1", "v2", "v3"])

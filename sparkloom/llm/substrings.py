"""Exact substring dedup over all documents by suffix sorting of the places where repeats begin or end.

Two equal strings of ``length`` bytes hold the same least k-gram at the same place (a minimiser), so they meet under
that anchor's hash.  The windows that an anchor owns are compared as a whole first; where the anchor
has different surroundings they are cut into chunks of ``chunk`` window starts, and chunks that share their core
but not all their bytes are suffix-sorted (``suffix``), the core standing as one symbol of its own length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, posix_root, saved, scratch
from .suffix import Workspace, sort_suffixes


@dataclass(frozen=True)
class SubstringOptions:
    """``length`` bytes make a repeat; ``gram`` is the anchors' width.  Groups of over ``group`` chunks of one core are told
    apart window by window, in aggregates; others are suffix-sorted, about ``shard`` chunks at a time within ``memory``
    bytes. Tables of up to ``broadcast_rows`` rows and ``broadcast_items`` list items are broadcast, larger ones shuffled."""

    length: int = 200
    gram: int = 50
    chunk: int = 16
    group: int = 20_000
    shard: int = 40_000
    memory: int = 128 << 20
    broadcast_rows: int = 1_500_000
    broadcast_items: int = 4_000_000

    def __post_init__(self):
        if not (1 <= self.gram <= self.length and 1 <= self.chunk <= self.length):
            raise ValueError("gram and chunk go from 1 to length")

    @property
    def windows(self) -> int:
        return self.length - self.gram + 1

    @property
    def core(self) -> int:
        return self.length - self.chunk + 1


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        have = _powers[base] = np.multiply.accumulate(x)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    m, s = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
    h = (h ^ (h >> s)) * m
    h = (h ^ (h >> s)) * m
    return h ^ (h >> s)


class _Hashes:
    """Hashes of any substring of texts that lie in a row, from prefix sums modulo 2^64; equal strings have one hash wherever they are."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power(_BASE, n)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = _power(_INVERSE, n + 1)

    def of(self, a: np.ndarray, b: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a] + np.uint64(0x9FB21C651E98DF25) * np.asarray(salt, np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from each place on."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.inverse[: len(h)]
        return _mix(h)


def _sliding(h: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest value of each ``width`` consecutive ones, by those of 1, 2, 4 ... consecutive ones."""
    f, have = (np.minimum if least else np.maximum), 1
    while 2 * have <= width:
        h, have = f(h[:-have], h[have:]), 2 * have
    return f(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def _anchors(hashes: _Hashes, begin: np.ndarray, end: np.ndarray, o: SubstringOptions) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts of at least ``length`` bytes that lie in a row, each from ``begin`` to ``end``: the text's number,
    gram hash, place, first and last window start that they own."""
    w, gram = o.windows, hashes.every(o.gram)
    least = _sliding(gram, w, True)  # of each window
    for x in end[:-1].tolist():
        least[x - o.length + 1 : x] = 0  # no window goes from one text into the next
    pad = np.zeros(w - 1, np.uint64)
    p = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), w, False) == gram)
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least)) - 1
    own, value = np.searchsorted(end, p, "right"), least[begins]
    low, high = np.maximum(p - w + 1, begin[own]), np.minimum(p, end[own] - o.length)
    r = np.searchsorted(begins, low, "right") - 1
    while True:  # the first run of windows from low on whose least gram is this one
        r2 = np.where((ends[r] < low) | (value[r] != gram[p]), r + 1, r)
        if (r2 == r).all():
            break
        r = r2
    first = np.maximum(begins[r], low)
    # equal grams close by may part what one owns; it takes all up to the last such window
    q = np.searchsorted(begins, high, "right") - 1
    while True:
        q2 = np.where(value[q] != gram[p], q - 1, q)
        if (q2 == q).all():
            break
        q = q2
    return own, gram[p], p, first, np.minimum(ends[q], high)


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text, th, n, key)``; equal texts have one key, so they are handled alike and their spans are kept once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("th", F.xxhash64("text")).withColumn("n", F.octet_length("text").cast("long"))
    return out.withColumn("key", F.concat_ws(":", "th", "n"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What the texts, binaries or lists of a column have, in a row, and where each begins (and the last ends)."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offsets = column.offsets.to_numpy().astype(np.int64)
        return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of texts that are worked on together, so that arrays with an element for each stay in a core's cache.
_TOGETHER = 1 << 15


def _each(make, names: list[str]):
    """mapInArrow function that runs ``make`` on some texts (the first column: hashes, where they begin and end, the bytes) and
    the other columns of their rows."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ends = _values(whole.column(0))[1][1:]
            found, start, held = [], 0, 0
            while start < whole.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + _TOGETHER, "right")))
                b = whole.slice(start, stop - start)
                raw, places = _values(b.column(0))
                found.append([x if isinstance(x, pa.Array) else pa.array(x) for x in make(raw, places[:-1], places[1:], *b.columns[1:])])
                start, held = stop, held + len(found[-1][0])
                if held > 1 << 14 or start == whole.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*found, strict=True)], names)
                    found, held = [], 0

    return apply


def _binaries(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    """Binary values of ``size`` bytes from ``begin`` on."""
    ends = np.cumsum(size)
    data = raw[_counted(size) + np.repeat(begin, size)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def anchors(table: DataFrame, o: SubstringOptions) -> DataFrame:
    """``(g, rh, th, n, p, first, last)``: anchors, with a hash of all bytes of the windows they own."""

    def make(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, th: pa.Array, n: pa.Array):
        hashes = _Hashes(raw)
        own, g, p, first, last = _anchors(hashes, begin, end, o)
        rh, at = hashes.of(first, last + o.length, ((p - first) << 24) + (p - last)), begin[own]
        return g.view(np.int64), rh.view(np.int64), th.to_numpy()[own], n.to_numpy()[own], p - at, first - at, last - at

    names = ["g", "rh", "th", "n", "p", "first", "last"]
    long = table.where(F.col("n") >= o.length).select("text", "th", "n")
    return long.mapInArrow(_each(make, names), ", ".join(f"{c} long" for c in names))


def _shared(rows: DataFrame, key: str, value: str, o: SubstringOptions) -> DataFrame:
    """``rows`` whose ``key`` occurs more than once, with ``mixed``: its rows differ in ``value``; ``m`` has their number."""
    counts = rows.groupBy(key).agg(F.count("*").alias("m"), F.min(value).alias("_x"), F.max(value).alias("_y")).where("m > 1")
    counts = saved(counts.select(key, "m", (F.col("_x") != F.col("_y")).alias("mixed")), "shared")
    if counts.count() <= o.broadcast_rows:
        return rows.join(F.broadcast(counts), key)
    return lookup(rows, counts.withColumn("weight", F.col("m")), key, "weight", value, counts.agg(F.sum("m")).first()[0]).where("m is not null")


def _at_places(table: DataFrame, places: DataFrame, items: list[str], o: SubstringOptions) -> DataFrame:
    """Rows of ``table`` (text, key) with lists of ``items`` of their places: the lists are broadcast if small."""
    lists = saved(places.groupBy("key").agg(F.collect_list(F.struct(*items)).alias("_all"), F.count("*").alias("_n")), "places")
    size = lists.agg(F.count("*").alias("rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("items")).first()
    split = lists.select("key", *[F.col("_all")[c].alias(c) for c in items])
    if size.rows <= o.broadcast_rows and size["items"] <= o.broadcast_items:
        return table.join(F.broadcast(split), "key")
    weights = table.groupBy("key").agg(F.count("*").alias("weight"))
    weighted = saved(split.join(weights, "key"), "weighted")
    return lookup(table, weighted, "key", "weight", "id", table.count()).where(F.col(items[0]).isNotNull())


def _chunks(table: DataFrame, places: DataFrame, o: SubstringOptions) -> DataFrame:
    """``(ck, cr, th, n, s, a, w)``: chunks of the windows of some anchors; cr hashes all bytes of a chunk, ck those of its core.

    ``s`` is the first window's start, ``a`` how far it is before the core, ``w`` the number of windows.
    """

    def make(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, th: pa.Array, n: pa.Array, *lists: pa.Array):
        hashes = _Hashes(raw)
        places, ends = _values(lists[0])
        own = np.repeat(np.arange(len(begin)), np.diff(ends))
        most, least = (places - _values(x)[0] for x in lists[1:])  # how far before p windows start
        low = least // o.chunk
        size = most // o.chunk - low + 1
        j = np.repeat(low, size) + _counted(size)
        own, p, most, least = (np.repeat(x, size) for x in (own, places + begin[own], most, least))
        l0, l1 = np.maximum(least, j * o.chunk), np.minimum(most, (j + 1) * o.chunk - 1)
        core, a = p - j * o.chunk, l1 - j * o.chunk
        s, w = core - a, l1 - l0 + 1
        ck, cr = hashes.of(core, core + o.core, 1 + j), hashes.of(s, s + w - 1 + o.length, a)
        return ck.view(np.int64), cr.view(np.int64), th.to_numpy()[own], n.to_numpy()[own], s - begin[own], a.astype(np.int32), w.astype(np.int32)

    items = ["p", "first", "last"]
    rows = _at_places(table, places, items, o).select("text", "th", "n", *items)
    return rows.mapInArrow(_each(make, ["ck", "cr", "th", "n", "s", "a", "w"]), "ck long, cr long, th long, n long, s long, a int, w int")


def _with_bytes(table: DataFrame, chunks: DataFrame, o: SubstringOptions) -> DataFrame:
    """Mixed chunks with their bytes before and after the core (``left``, ``right``)."""

    def make(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, th: pa.Array, n: pa.Array, *lists: pa.Array):
        ends = _values(lists[0])[1]
        own = np.repeat(np.arange(len(begin)), np.diff(ends))
        ck, s, a, w, m = (_values(x)[0].astype(np.int64) for x in lists)
        at = s + begin[own]
        left, right = _binaries(raw, at, a), _binaries(raw, at + a + o.core, w - a + o.chunk - 2)
        return ck, th.to_numpy()[own], n.to_numpy()[own], s, a, w, m, left, right

    items = ["ck", "s", "a", "w", "m"]
    rows = _at_places(table, chunks.withColumn("key", F.concat_ws(":", "th", "n")), items, o).select("text", "th", "n", *items)
    names = ["ck", "th", "n", "s", "a", "w", "m"]
    return rows.mapInArrow(_each(make, [*names, "left", "right"]), ", ".join(f"{c} long" for c in names) + ", left binary, right binary")


def repeated_windows(ck: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, w: np.ndarray, o: SubstringOptions, space: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Chunk number of every window, and whether it equals a window of another chunk: of its neighbours in suffix
    order one has ``length`` bytes or more in common.

    A chunk has ``a`` bytes before its core and w - a + chunk - 2 after it, and ``w`` windows; ``left`` and ``right`` have
    all chunks' such bytes in a row.  A core counts as one symbol of its whole length.  What has an element for each
    symbol belongs to the workspace and is worked on in blocks.
    """
    n = len(ck)
    kinds, core = np.unique(ck, return_inverse=True)
    # numbers in an order that has nothing to do with the strings': induced suffixes then lie far from their sources
    mixed = np.random.default_rng(0)
    core, number = mixed.permutation(len(kinds))[core], mixed.permutation(n) + 1
    after = w - a + o.chunk - 2
    # each string is [its number][left][core][right]: no two numbers are equal, so nothing in common goes past an end
    starts = np.concatenate([[0], np.cumsum(a + after + 2)])
    lefts, rights = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(after)])
    at_core = starts[:-1] + a + 1
    text = space.array(int(starts[-1]) + 1, np.int32 if 2 * n + 300 < 2**31 else np.int64)
    step = max(1, space.block // (2 * o.chunk))
    for x in range(0, n, step):
        y = min(n, x + step)
        own = np.arange(x, y)
        part = np.empty(int(starts[y] - starts[x]), text.dtype)
        at = starts[x:y] - starts[x]
        part[at], part[at_core[x:y] - starts[x]] = number[own], n + 257 + core[own]
        for raw, ends, size, first in ((left, lefts, a, at + 1), (right, rights, after, at_core[x:y] - starts[x] + 1)):
            some = raw[ends[x] : ends[y]]
            part[np.arange(len(some)) + np.repeat(first - (ends[x:y] - ends[x]), size[x:y])] = some.astype(text.dtype) + n + 1
        text[starts[x] : starts[y]] = part
    text[-1] = 0
    sa, lcp = sort_suffixes(text, space)
    long_enough = space.array(len(text), bool)
    for x, y in space.blocks(len(text)):
        # chunk symbols in common, with the suffix before or behind: a core has fewer on either side, so it is among them
        common = np.append(lcp[x : min(y + 1, len(text))], 0)
        long_enough[sa[x:y]] = np.maximum(common[: y - x], common[1 : y - x + 1]) >= o.length - o.core + 1
    out = [long_enough[np.repeat(starts[x : x + step][: n - x] + 1, w[x : x + step]) + _counted(w[x : x + step])] for x in range(0, n, step)]
    return np.repeat(np.arange(n), w), np.concatenate(out) if out else np.zeros(0, bool)


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, in a row."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _sorted_spans(rows: DataFrame, o: SubstringOptions, parent: str | None) -> DataFrame:
    """Spans of repeats among chunks of the same core; every partition sorts its groups shard by shard."""

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ck, th, n, s, a, w = (t.column(c).to_numpy() for c in ("ck", "th", "n", "s", "a", "w"))
        with Workspace(o.memory, parent) as space:
            at, flags = repeated_windows(ck, *(_values(t.column(c).combine_chunks())[0] for c in ("left", "right")), a, w, o, space)
        # runs of repeated windows: at has the windows' chunks, in order
        first = s[at] + np.arange(len(at)) - np.searchsorted(at, at)
        edge = np.concatenate([[True], at[1:] != at[:-1], [True]])
        on = flags & (edge[:-1] | ~np.concatenate([[False], flags[:-1]]))
        off = flags & (edge[1:] | ~np.concatenate([flags[1:], [False]]))
        which = at[on]
        return pa.RecordBatch.from_pydict({"th": pa.array(th[which]), "n": pa.array(n[which]), "start": pa.array(first[on]), "end": pa.array(first[off] + o.length)})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            ck = b.column(0).to_numpy()
            if size >= o.shard and ck[0] != ck[-1]:  # the last group may go on in the next batch
                cut = int(np.flatnonzero(ck != ck[-1])[-1]) + 1
                yield solve([*held[:-1], b.slice(0, cut)])
                held, size = [b.slice(cut)], b.num_rows - cut
        if held:
            yield solve(held)

    dealt = rows.select("ck", "th", "n", "s", "a", "w", "left", "right").repartition("ck").sortWithinPartitions("ck")
    return dealt.mapInArrow(apply, "th long, n long, start long, end long")


def _window_spans(rows: DataFrame, o: SubstringOptions) -> DataFrame:
    """Spans of repeats in groups too large for one task: each window is counted by its bytes."""
    each = rows.select("th", "n", "ck", "s", "a", "left", "right", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("i"))
    i = F.col("i").cast("int")
    text = F.struct(F.substring("left", i + 1, F.lit(o.length)), F.substring("right", F.lit(1), o.chunk - 1 - F.col("a").cast("int") + i))
    named = each.withColumn("window", F.sha2(F.concat(F.col("ck").cast("string").cast("binary"), F.lit(b":"), F.hex(text.getField("col1")).cast("binary"), F.lit(b":"), F.hex(text.getField("col2")).cast("binary")), 256))
    counts = saved(named.groupBy("window").agg(F.count("*").alias("m")).where("m > 1"), "windows")
    found = lookup(named.select("window", "th", "n", "s", "i"), counts.withColumn("again", F.lit(True)), "window", "m", "s", counts.agg(F.sum("m")).first()[0] or 0).where("again")
    return found.select("th", "n", (F.col("s") + F.col("i")).alias("start"), (F.col("s") + F.col("i") + o.length).alias("end"))


def _any_row(*names: str) -> list:
    """Columns of one row of a group, whichever comes first: in one aggregate all are of the same row."""
    return [F.first(c).alias(c) for c in names]


def repeats(table: DataFrame, o: SubstringOptions) -> DataFrame:
    """``(key, spans)``: bytes [start, end) of each text that has any, covered by repeated strings, merged."""
    with scratch() as keep:
        root = posix_root(table.sparkSession)
        parent = f"{root}/sparkloom/suffix" if root else None
        whole = lambda rows: rows.select("th", "n", F.col("s").alias("start"), (F.col("s") + F.col("w") - 1 + o.length).alias("end"))
        span = lambda rows: rows.select("th", "n", F.col("first").alias("start"), (F.col("last") + o.length).alias("end"))
        found = saved(anchors(table, o), "anchors")
        shared = _shared(found, "g", "rh", o)
        spans = [span(shared.where("not mixed"))]
        both = lambda *c: F.struct(*c).alias("both")  # noqa: E731  two hashes as one key
        mixed = saved(shared.where("mixed").drop("m", "mixed"), "mixed")
        regions = saved(mixed.groupBy("g", "rh").agg(F.count("*").alias("m"), *_any_row("th", "n", "p", "first", "last")), "regions")
        same = regions.where("m > 1").select(both("g", "rh"), "m", F.lit(True).alias("again"))
        spans.append(span(lookup(mixed.select("*", both("g", "rh")), same, "both", "m", "p", same.agg(F.sum("m")).first()[0] or 0).where("again")))
        chunks = saved(_chunks(table, regions.select(F.concat_ws(":", "th", "n").alias("key"), "p", "first", "last"), o), "chunks")
        parted = _shared(chunks, "ck", "cr", o)
        spans.append(whole(parted.where("not mixed")))
        parted = saved(parted.where("mixed").drop("mixed"), "parted")
        kinds = saved(parted.groupBy("ck", "cr").agg(F.count("*").alias("copies"), *_any_row("th", "n", "s", "a", "w", "m")), "kinds")
        same = kinds.where("copies > 1").select(both("ck", "cr"), "copies", F.lit(True).alias("again"))
        spans.append(whole(lookup(parted.select("*", both("ck", "cr")), same, "both", "copies", "s", same.agg(F.sum("copies")).first()[0] or 0).where("again")))
        unequal = saved(_with_bytes(table, kinds.select("ck", "th", "n", "s", "a", "w", "m"), o), "unequal")
        spans.append(_sorted_spans(unequal.where(F.col("m") <= o.group), o, parent))
        large = unequal.where(F.col("m") > o.group)
        if not large.isEmpty():
            spans.append(_window_spans(large, o))
        every = spans[0]
        for s in spans[1:]:
            every = every.union(s)
        lists = every.distinct().groupBy("th", "n").agg(F.collect_list(F.struct("start", "end")).alias("all"))
        lists = lists.select(F.concat_ws(":", "th", "n").alias("key"), F.col("all.start").alias("start"), F.col("all.end").alias("end"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                firsts, lasts = [], []
                for start, end in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    s, e = np.array(start), np.array(end)
                    order = np.argsort(s, kind="stable")
                    s, e = s[order], np.maximum.accumulate(e[order])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    firsts.append(s[new])
                    lasts.append(e[np.append(new[1:], True)])
                yield pa.RecordBatch.from_pydict({"key": b.column(0), "start": pa.array(firsts, pa.list_(pa.int64())), "end": pa.array(lasts, pa.list_(pa.int64()))})

        return keep(saved(lists.mapInArrow(merge, "key string, start array<long>, end array<long>"), "spans"))


def deduplicate_substrings(docs: DataFrame, o: SubstringOptions = SubstringOptions(), id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes if asked for).

    Each byte that lies in a string of ``length`` bytes that also starts anywhere else, in the same or another
    document, is removed; overlaps count, strings are judged on the input, and none crosses documents.  Of equal
    strings no one stays.  A null text is empty; texts under ``length`` bytes lose nothing; repeated rows are
    each other's copies; other columns are ignored. Strings are told apart by 64-bit hashes of at least ``gram`` bytes until the suffix sort.
    """
    table = _table(docs, id_col, text_col)
    spans = repeats(table, o)
    size = spans.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("start")), F.lit(0)).alias("items")).first()
    if size.rows <= o.broadcast_rows and size["items"] <= o.broadcast_items:
        rows = table.join(F.broadcast(spans), "key", "left")
    else:
        weights = table.groupBy("key").agg(F.count("*").alias("weight"))
        rows = lookup(table, saved(spans.join(weights, "key"), "weighted"), "key", "weight", "id", table.count())
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
            for text, start, end in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True):
                raw, last, parts = _bytes(text), 0, []
                for x, y in zip(start or [], end or [], strict=True):
                    parts.append(raw[last:x])
                    last = y
                kept = b"".join([*parts, raw[last:]])
                for c, v in zip(out, (len(raw), len(raw) - len(kept), len(start or []), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(v)
            types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_pydict({id_col: b.column(0)} | {c: pa.array(v, types[c]) for c, v in out.items() if c != "kept" or with_bytes})

    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return rows.select("id", "text", "start", "end").mapInArrow(cut, schema)

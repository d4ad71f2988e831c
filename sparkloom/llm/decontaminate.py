"""Benchmark decontamination: a broadcast set of normalised test n-grams scans the words of whole documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, lookup, saved

#: A-Z to a-z; what is no word character (ASCII other than a-z and 0-9) to a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
ACTIONS = ("flag", "remove_documents", "remove_spans")


def words(text: str | None) -> list[bytes]:
    """The words of a text after lower-casing A-Z; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class NgramSet:
    """Windows of ``n`` consecutive item words (an item of fewer words is one window), by word id.

    Different windows of one size are rows of a matrix in order of their hash, with the items that hold them; a
    window takes about 4 n + 20 bytes, a different word about 150.
    """

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.names)}
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            found = words(text)
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint32)
            if size := min(n, len(ids)):
                parts.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(ids, size), number[item]))
        #: By size: hashes in order, windows, where the items of each begin, the items.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, found in sorted(parts.items()):
            rows = np.concatenate([w for w, _ in found])
            item = np.repeat(np.array([k for _, k in found], np.int32), [len(w) for w, _ in found])
            hashed = self._hash([rows[:, j] for j in range(size)])
            order = np.lexsort((item, *(rows[:, j] for j in range(size)), hashed))
            rows, item, hashed = rows[order], item[order], hashed[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])
            other = new | np.concatenate([[True], item[1:] != item[:-1]])
            starts = np.append(np.flatnonzero(new[other]), np.count_nonzero(other)).astype(np.int32)
            self.windows[size] = (hashed[new], rows[new], starts, item[other])

    @staticmethod
    def _hash(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            out = out * _BASE + c.astype(np.uint64)
        return out ^ (out >> np.uint64(29))

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: its number of words, maximal runs of hit words [from, to), and the items found."""
        counts, parts = [], []
        get = self.vocabulary.get
        for text in texts:
            found = words(text)
            counts.append(len(found))
            parts.append(np.fromiter(map(get, found, repeat(0)), np.uint32, len(found)))
            parts.append(np.zeros(1, np.uint32))  # no window crosses documents
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.concatenate([[0], np.cumsum([c + 1 for c in counts])]).astype(np.int64)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        delta = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for size, (hashes, rows, first, item) in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if not len(at):
                continue
            hashed = self._hash([ids[at + j] for j in range(size)])
            slot = np.searchsorted(hashes, hashed)
            while len(at):  # the exact check, also of windows that share a hash
                live = slot < len(hashes)
                live[live] = hashes[slot[live]] == hashed[live]
                at, slot, hashed = at[live], slot[live], hashed[live]
                equal = (ids[at[:, None] + np.arange(size)] == rows[slot]).all(1)
                np.add.at(delta, at[equal], 1)
                np.add.at(delta, at[equal] + size, -1)
                doc = np.searchsorted(starts, at[equal], "right") - 1
                for d, k in {*zip(doc.tolist(), slot[equal].tolist(), strict=True)}:
                    items.setdefault(d, set()).update(self.names[x] for x in item[first[k] : first[k + 1]])
                slot = slot + 1
        out = []
        for d, n in enumerate(counts):
            spans = []
            if d in items:
                covered = np.cumsum(delta[starts[d] : starts[d] + n + 1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered[:n], [False]]).astype(np.int8)))
                spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
            out.append((n, spans, items.get(d, set())))
        return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between words of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


#: Bytes that a built set may take on a worker.
SET_BYTES = 64 << 20
_FOUND = "array<struct<start:int,end:int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, action: str = "flag", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", max_set_bytes: int = SET_BYTES, max_broadcast_rows: int = 500_000) -> DataFrame:
    """Find words of documents inside any occurrence of a benchmark window, and act on them.

    ``flag`` adds ``_n_words``, ``_spans`` (array of struct<start,end> word numbers) and ``_items`` to the columns of
    ``docs``, in place of columns so named; ``remove_documents`` keeps documents without a hit; ``remove_spans`` cuts hit
    words out of the text; both keep all columns.  Before anything is built the benchmark's words are counted: it is broadcast
    in as many blocks (by a hash of the item) as keep a built set under ``max_set_bytes`` (a block has one item at least). One
    block is scanned without a shuffle; more are scanned apart, so that a worker holds one set, and what they find returns
    to the documents by a hash of their text.  Null and empty texts have no words and are never hit. Items without words, and
    null items' ids, are ignored. Repeated items count once by id, equal texts under different ids count for each id; repeated
    documents are judged each by itself; empty tables give empty ones, or leave documents unchanged.
    """
    if action not in ACTIONS:
        raise ValueError(f"action is one of {ACTIONS}")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    # a window for each word; as if each were a word that occurs nowhere else
    size = items.agg(F.sum(F.size(F.split(F.trim("t"), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")) * F.lit(4 * n + 170))).first()[0] or 0
    blocks = max(1, -(-int(size) // max_set_bytes))
    sets = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).collect()  # what makes a set of max_set_bytes, or one item
        sets.append(spark.sparkContext.broadcast(NgramSet([(r.i, r.t) for r in rows], n)))
    if blocks == 1:
        return _acted(docs, action, text_col, lambda texts, _: sets[0].value.scan(texts))
    texts = docs.where(F.octet_length(text_col) > 0).select(F.xxhash64(text_col).alias("own"), F.octet_length(text_col).alias("bytes"), F.col(text_col).alias("text"))
    hits = None
    for grams in sets:
        here = texts.mapInArrow(_hits(grams), f"own long, bytes int, spans {_FOUND}, items array<string>")
        hits = here if hits is None else hits.union(here)
    hits = hits.distinct().groupBy("own", "bytes").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    key, hit = free_names(docs, "_key", "_hit")
    hits = saved(hits.select(F.concat_ws(":", "own", "bytes").alias(key), F.struct("spans", "items").alias(hit)), "hits")
    keyed = docs.withColumn(key, F.concat_ws(":", F.xxhash64(text_col), F.octet_length(text_col)))
    if hits.count() <= max_broadcast_rows:
        joined = keyed.join(F.broadcast(hits), key, "left").select(*docs.columns, hit)
    else:
        (weight,) = free_names(docs, "_weight")
        counts = keyed.groupBy(key).agg(F.count("*").alias(weight))
        joined = lookup(keyed, saved(hits.join(counts, key), "weighted"), key, weight, key, keyed.count()).select(*docs.columns, hit)

    def found(texts: list[str | None], hit: list) -> list:
        return [(len(words(t)), _merged([(s["start"], s["end"]) for s in h["spans"]]) if h else [], {*h["items"]} if h else set()) for t, h in zip(texts, hit, strict=True)]

    return _acted(joined, action, text_col, found, hit)


def _hits(grams):
    """Rows (own, bytes, text) that are hit by one set."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                found = grams.value.scan(b.column(2).to_pylist())
                hit = b.filter(pa.array([bool(f[1]) for f in found], pa.bool_()))
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                spans = pa.array([[{"start": x, "end": y} for x, y in f[1]] for f in found if f[1]], kind)
                yield pa.RecordBatch.from_arrays([hit.column(0), hit.column(1), spans, pa.array([sorted(f[2]) for f in found if f[1]], pa.list_(pa.string()))], ["own", "bytes", "spans", "items"])

    return apply


def _acted(docs: DataFrame, action: str, text_col: str, find, extra: str | None = None) -> DataFrame:
    """The action on what ``find`` gives for texts (and the values of ``extra``, which goes): words, spans and items of each."""
    added = ("_n_words", "_spans", "_items") if action == "flag" else ()
    base = [c for c in docs.columns if c not in (*added, extra)]
    kept = docs.select(*base, *([extra] if extra else []))
    out = kept.select(*base)
    if action == "flag":
        out = out.withColumns({"_n_words": F.lit(0).cast("long"), "_spans": F.expr(f"cast(array() as {_FOUND})"), "_items": F.expr("cast(array() as array<string>)")})
    schema, at = out.schema, base.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch], arrow=_arrow(schema)) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = batch.column(at).to_pylist()
                found = find(texts, batch.column(len(base)).to_pylist() if extra else None)
                columns = [batch.column(j).cast(arrow.field(j).type) for j in range(len(base))]
                if action == "flag":
                    more = [f[0] for f in found], [[{"start": a, "end": b} for a, b in f[1]] for f in found], [sorted(f[2]) for f in found]
                    columns += [pa.array(x, arrow.field(len(base) + k).type) for k, x in enumerate(more)]
                elif action == "remove_spans":
                    columns[at] = pa.array([without_spans(t, f[1]) if f[1] else t for t, f in zip(texts, found, strict=True)], arrow.field(at).type)
                out = pa.RecordBatch.from_arrays(columns, schema=arrow)
                yield out.filter(pa.array([not f[1] for f in found], pa.bool_())) if action == "remove_documents" else out

    return kept.mapInArrow(apply, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination_digest(flagged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: counts of words, hit words and items, and a digest of the items."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    listed = F.array_join(F.array_sort("_items"), ",")
    return flagged.select(
        id_col, F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )

"""SimHash near-duplicates by bit-sliced comparison of vertical bit planes.

``near_duplicates`` links all fingerprints within a radius.  ``keep_one`` links documents by the Jaccard similarity of
their shingles: buckets of equal minima hold the candidates, whose fingerprints are compared bit-sliced within a radius
that similar sets hardly ever exceed, and what is near is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, hash_masks, lookup, saved, scratch
from .components import connected_components
from .similar import few, similar_sets

BITS, ALL = 64, np.uint64(0xFFFFFFFFFFFFFFFF)
#: A byte's bits, one in each byte of a word: sums of up to 255 of them don't run over.
_SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)
#: Fingerprints of one bucket that are compared together; larger buckets are split by further bits.
BUCKET = 4096


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else [], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(words) - width + 1)


def fingerprints_of(texts: list[str | None], width: int = 3, seed: int = 42) -> np.ndarray:
    """A bit is 1 if it is set in over half the shingles' hashes; no word: zero."""
    return prints_of([shingle_hashes(t, width, seed) for t in texts])


def prints_of(hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    some = [k for k, h in enumerate(hashes) if len(h)]
    if not some:
        return out
    sizes = np.array([len(hashes[k]) for k in some])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    pieces = np.concatenate([np.arange(s, s + n, 255) for s, n in zip(starts, sizes, strict=True)])  # 255 rows at most
    first = np.searchsorted(pieces, starts)
    raw = np.concatenate([hashes[k] for k in some]).view(np.uint8).reshape(-1, 8)
    found = np.zeros(len(some), np.uint64)
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[raw[:, byte]], pieces).view(np.uint8).reshape(-1, 8).astype(np.int64)
        over = np.add.reduceat(sums, first, axis=0) * 2 > sizes[:, None]
        for k in range(8):
            found |= over[:, k].astype(np.uint64) << np.uint64(8 * byte + k)
    out[some] = found
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """``(id, fp)`` for every document; ``fp`` is the fingerprint as a signed long."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                yield pa.RecordBatch.from_pydict({id_col: b.column(0), "fp": pa.array(fingerprints_of(b.column(1).to_pylist(), width, seed).view(np.int64))})

    return docs.select(id_col, text_col).mapInArrow(apply, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def _masks(bits: list[int], parts: int, take: int) -> list[int]:
    """Masks of ``take`` of the ``parts`` near-equal parts of some bit positions, in all combinations."""
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    blocks = [sum(1 << b for b in bits[cut[k] : cut[k + 1]]) for k in range(parts)]
    return [sum(c) for c in combinations(blocks, take)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _planes(table: np.ndarray, bits: list[int]) -> dict[int, np.ndarray]:
    """Vertical bit planes of words of 64 fingerprints: a word for each bit, a lane for each fingerprint."""
    return {b: np.packbits((table >> np.uint64(b) & np.uint64(1)).astype(bool), axis=1, bitorder="little").view("<u8").ravel() for b in bits}


def _near_cells(planes: dict[int, np.ndarray], own: np.ndarray, w: np.ndarray, open_: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(cell, lane)`` of distances of at most ``radius``; a cell is a query ``own`` against the word ``w`` of lanes.

    Two planes at a time go through a carry-save step into the lowest counter bit and their carry on into the
    upper ones.  Counters start so high that the carry out of the highest bit tells a distance over the radius; a
    cell is abandoned once it has come out of all its ``open_`` lanes.
    """
    cell, high = np.arange(len(own)), (radius + 1).bit_length()
    start = (1 << high) - 1 - radius
    counter = [np.full(len(own), ALL if start >> k & 1 else 0, np.uint64) for k in range(high)]
    bits = list(planes)
    differ = lambda b: planes[b][w] ^ (np.uint64(0) - (own >> np.uint64(b) & np.uint64(1)))
    for n in range(0, len(bits), 2):
        x, y = differ(bits[n]), differ(bits[n + 1]) if n + 1 < len(bits) else np.zeros(len(own), np.uint64)
        both = x ^ y
        carry = x & y | counter[0] & both
        counter[0] ^= both
        for k in range(1, high):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        open_ = open_ & ~carry
        if n % 4 == 2 or n + 2 >= len(bits):
            live = open_ != 0
            if not live.all():
                cell, own, w, open_ = (a[live] for a in (cell, own, w, open_))
                counter = [a[live] for a in counter]
            if not len(cell):
                break
    at, lane = np.nonzero(np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return cell[at], lane


def bit_sliced_links(groups: list[np.ndarray], radius: int, fixed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of fingerprints in the same group that differ in at most ``radius`` bits.

    Fingerprints are stored as vertical bit planes, 64 lanes to a word, see ``_near_cells``.  ``fixed`` are bits that
    a group has in common.
    """
    words, lanes, query, cell_q, cell_w, below = [], [], [], [], [], []
    n_words = n_query = 0
    for g in groups:
        w = -(-len(g) // 64)
        padded = np.zeros(w * 64, np.uint64)
        padded[: len(g)] = g
        words.append(padded.reshape(w, 64))
        for k in range(w):  # query lane i against the words that hold lanes before it
            i = np.arange(max(1, 64 * k + 1), len(g))
            cell_q.append(n_query + i)
            cell_w.append(np.full(len(i), n_words + k))
            part = np.minimum(i - 64 * k, 64).astype(np.uint64)
            below.append(np.where(part == 64, ALL, (np.uint64(1) << (part % np.uint64(64))) - np.uint64(1)))
        query.append(g)
        lanes.append(n_query)
        n_words, n_query = n_words + w, n_query + len(g)
    none = np.zeros(0, np.uint64)
    if not cell_q:
        return none, none
    table, asked = np.concatenate(words), np.concatenate(query)
    cell_q, cell_w, below = np.concatenate(cell_q), np.concatenate(cell_w), np.concatenate(below)
    planes = _planes(table, [b for b in range(BITS) if not fixed >> b & 1])
    left, right = [none], [none]
    for at in range(0, len(cell_q), 1 << 16):
        q, w = cell_q[at : at + (1 << 16)], cell_w[at : at + (1 << 16)]
        cell, lane = _near_cells(planes, asked[q], w, below[at : at + (1 << 16)], radius)
        left.append(asked[q[cell]])
        right.append(table[w[cell], lane])
    return np.concatenate(left), np.concatenate(right)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as those given, one fewer than nodes of a component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def _compare(radius: int, batch_lanes: int = 1 << 14):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (mask, value, fp) in order of mask and value; a bucket may go over batches."""
        held: list[np.ndarray] = []
        size, key, run = 0, None, []

        def flush(mask: int) -> pa.RecordBatch:
            a, b = bit_sliced_links(held, radius, mask & ((1 << 64) - 1))
            a, b = _forest(a, b)
            return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, value, fp = (batch.column(k).to_numpy() for k in range(3))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                here = (int(mask[s]), int(value[s]))
                if here != key:
                    if sum(map(len, run)) > 1:
                        held.append(np.concatenate(run))
                        size += len(held[-1])
                    if held and (here[0] != key[0] or size >= batch_lanes):
                        yield flush(key[0])
                        held.clear()
                        size = 0
                    key, run = here, []
                run.append(fp[s:e].view(np.uint64).copy())
        if sum(map(len, run)) > 1:
            held.append(np.concatenate(run))
        if held:
            yield flush(key[0])

    return apply


def links(distinct: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints (column ``fp``) that span the components at ``radius``.

    Of 4 blocks of 16 bits, two fingerprints within 2 bits agree in 2 blocks at least, so the 6 choices of
    2 blocks find every pair.  A bucket of over ``bucket`` fingerprints is split again by the bits still
    free: of 3 parts of them one at least agrees.  After three such splits a bucket can't hold more
    than 2^10 distinct fingerprints, so nothing is left out and no bucket is large.
    """
    masks = _masks(list(range(BITS)), radius + 2, 2)
    keyed = distinct.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    found = None
    while True:
        counts = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket)
        free = BITS - max(bin(m).count("1") for m in masks)
        large = None if 1 << free <= bucket else saved(counts, "large")
        if large is None or large.isEmpty():
            small, keyed = keyed, None
        else:
            named = keyed.withColumn("_key", F.concat_ws(":", "mask", "value"))
            marked = lookup(named, large.select(F.concat_ws(":", "mask", "value").alias("_key"), "n", F.lit(True).alias("_large")), "_key", "n", "fp", large.agg(F.sum("n")).first()[0])
            small = marked.where("_large is null").select("mask", "value", "fp")
            further = {m: [m | s for s in _masks([b for b in range(BITS) if not m >> b & 1], radius + 1, 1)] for m in masks}
            split = F.create_map(*[x for m, more in further.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(s)) for s in more]))])
            keyed = marked.where("_large").select(F.explode(F.element_at(split, F.col("mask"))).alias("mask"), "fp").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
            masks = sorted({s for more in further.values() for s in more})
        dealt = small.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        pairs = dealt.mapInArrow(_compare(radius), "a long, b long")
        found = pairs if found is None else found.union(pairs)
        if keyed is None:
            return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(id, fp, component_id)`` for every document: the smallest id reachable over links within ``radius`` bits.

    Copies share a fingerprint and are folded into one before the search, so a fingerprint that a
    third of all documents have is one row there; its rows get their component by a broadcast of the
    few such fingerprints.  Texts without words have fingerprint zero and are linked like others. Null
    ids don't count as smallest; a component of nulls alone has a null id. Repeated rows are all returned.
    """
    with scratch() as keep:
        prints = keep(saved(fingerprints(docs, id_col, text_col, width, seed), "fingerprints"))
        distinct = saved(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("n")), "distinct")
        graph = saved(connected_components(links(distinct.select("fp"), radius, bucket)), "components")
        named = distinct.join(graph.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
        least = named.groupBy("component").agg(F.min("first").alias("component_id"))
        of = keep(saved(named.join(least, "component").select("fp", "n", "component_id"), "named"))
        return lookup(prints, of, "fp", "n", id_col, distinct.agg(F.sum("n")).first()[0] or 0)


@dataclass(frozen=True)
class NearOptions:
    """Documents are similar if the sets of their ``width``-word shingles have a Jaccard similarity of ``similarity`` or more.

    Candidates share a bucket: one of ``bands`` bands of ``rows`` minima, which a pair at 0.8 does with probability
    1 - (1 - 0.8 ** rows) ** bands (0.997 as set).  At 0.8 fingerprints differ in 9.7 bits on average (standard
    deviation 2.9), so ``radius`` passes all but 1 of 10,000; unrelated ones differ in 32.  ``block`` members of
    a bucket are compared together; larger buckets are dealt out over several tasks."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 8
    rows: int = 3
    radius: int = 20
    seed: int = 42
    block: int = 4096
    broadcast_rows: int = 500_000


def shingle_set(text: str | None, width: int, seed: int) -> np.ndarray:
    """Sorted hashes of the word shingles; a text without words has one element of its own."""
    found = np.unique(shingle_hashes(text, width, seed))
    return found if len(found) else np.zeros(1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band: of ``rows`` minima, each over its own hash of the elements."""
    masks = np.array(hash_masks(bands * rows), np.int64).view(np.uint64)[:, None]
    minima = np.full(bands * rows, ALL)
    for at in range(0, len(found), 4096):
        minima = np.minimum(minima, _mixed(found[None, at : at + 4096] ^ masks).min(axis=1))
    minima = minima.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(minima[b].tobytes(), b) for b in range(bands)], np.uint64)


def _by_text(docs: DataFrame, id_col: str, text_col: str, schema: str, of) -> DataFrame:
    """``of`` (texts to columns) over the texts in small slices, beside the id and the text's XXH64 ``own``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                b = whole.slice(start, 128)
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "own": b.column(1)} | of(b.column(2).to_pylist()))

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("own"), F.col(text_col).alias("text")).mapInArrow(apply, f"id {kind}, own long, {schema}")


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64))


def _signed_sets(docs: DataFrame, o: NearOptions, id_col: str, text_col: str) -> DataFrame:
    """``(id, own, h, fp, b0, b1, ...)``: a digest of the shingle set, its fingerprint and the keys of its bands."""

    def of(texts: list[str | None]) -> dict:
        sets = [shingle_set(t, o.width, o.seed) for t in texts]
        keys = np.array([band_keys(s, o.bands, o.rows) for s in sets], np.uint64).reshape(-1, o.bands).view(np.int64)
        return {"h": _digests(sets), "fp": pa.array(prints_of(sets).view(np.int64))} | {f"b{k}": pa.array(np.ascontiguousarray(keys[:, k])) for k in range(o.bands)}

    return _by_text(docs, id_col, text_col, "h long, fp long, " + ", ".join(f"b{k} long" for k in range(o.bands)), of)


def _pivot_links(radius: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (band, part, h, fp, label, rank, is_pivot), those of one band and part together; these may go over batches."""
        key, run = None, []

        def compared() -> Iterator[pa.RecordBatch]:
            h, fp, label, rank, pivot = (np.concatenate(x) for x in zip(*run, strict=True))
            p, m = np.flatnonzero(pivot), np.flatnonzero(~pivot)
            if not len(p) or not len(m):
                return
            w = -(-len(m) // 64)
            table = np.zeros(w * 64, np.uint64)
            table[: len(m)] = fp[m].view(np.uint64)
            planes = _planes(table.reshape(w, 64), list(range(BITS)))
            used = np.full(w, ALL)
            if len(m) % 64:
                used[-1] = (np.uint64(1) << np.uint64(len(m) % 64)) - np.uint64(1)
            step = max(1, (1 << 16) // w)
            for at in range(0, len(p), step):
                asked = p[at : at + step]
                q, words = np.repeat(asked, w), np.tile(np.arange(w), len(asked))
                cell, lane = _near_cells(planes, fp[q].view(np.uint64), words, used[words], radius)
                a, b = q[cell], m[words[cell] * 64 + lane]
                ok = (rank[b] > rank[a]) & (label[a] != label[b])
                a, b = a[ok], b[ok]
                if len(a):
                    yield pa.RecordBatch.from_pydict({"ha": pa.array(h[a]), "hb": pa.array(h[b]), "la": pa.array(label[a]), "lb": pa.array(label[b])})

        for batch in batches:
            if not batch.num_rows:
                continue
            band, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 7)]
            cuts = np.flatnonzero((band[1:] != band[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(band)], strict=True):
                here = (int(band[s]), int(part[s]))
                if here != key:
                    if run:
                        yield from compared()
                    key, run = here, []
                run.append([c[s:e].copy() for c in columns])
        if run:
            yield from compared()

    return apply


class _DocumentSets:
    """Shingle sets of documents, named by their digest ``h``, of those that hold them the first (by id) is read again."""

    def __init__(self, docs: DataFrame, distinct: DataFrame, o: NearOptions, id_col: str, text_col: str):
        self.docs, self.distinct, self.o, self.id_col, self.text_col = docs, distinct, o, id_col, text_col

    def prepare(self, wanted: DataFrame) -> None:
        o = self.o
        wanted = saved(wanted.join(self.distinct.select("h", "id"), "h"), "wanted")
        held = self.docs.join(few(wanted.select(F.col("id").alias(self.id_col)).distinct(), o.broadcast_rows), self.id_col, "left_semi")

        def of(texts: list[str | None]) -> dict:
            sets = [shingle_set(t, o.width, o.seed) for t in texts]
            return {"h": _digests(sets), "set": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))}

        sets = _by_text(held, self.id_col, self.text_col, "h long, set array<long>", of)
        self.sets = saved(sets.select("id", "h", "set").join(few(wanted, o.broadcast_rows), ["h", "id"], "left_semi").select("h", "set"), "sets")

    def near(self, pairs: DataFrame) -> DataFrame:
        prints = self.distinct.select("h", "fp")
        for c in "ab":
            pairs = pairs.join(prints.select(F.col("h").alias(c), F.col("fp").alias(f"{c}_fp")), c)
        return pairs.where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) <= self.o.radius).drop("a_fp", "b_fp")

    def near_pivots(self, ranked: DataFrame, done: int, until: int) -> DataFrame:
        full = ranked.join(self.distinct.select("h", "fp"), "h").withColumn("parts", F.ceil(F.col("m") / self.o.block).cast("int"))
        row = ["h", "fp", "label", "rank"]
        members = full.where(F.col("rank") > done).select("band", F.pmod("h", "parts").cast("int").alias("part"), *row, F.lit(False).alias("pivot"))
        pivots = full.where((F.col("rank") > done) & (F.col("rank") <= until)).select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *row, F.lit(True).alias("pivot"))
        dealt = members.union(pivots).repartition("band", "part").sortWithinPartitions("band", "part")
        return dealt.mapInArrow(_pivot_links(self.o.radius), "ha long, hb long, la long, lb long")

    def similar(self, pairs: DataFrame) -> DataFrame:
        for c in "ab":
            pairs = pairs.join(self.sets.select(F.col("h").alias(c), F.col("set").alias(f"{c}_set")), c)
        shared = F.size(F.array_intersect("a_set", "b_set"))
        return pairs.where((1 + self.o.similarity) * shared >= self.o.similarity * (F.size("a_set") + F.size("b_set")) - 1e-9).drop("a_set", "b_set")


def keep_one(docs: DataFrame, o: NearOptions = NearOptions(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of similar documents the one with the smallest id, all columns unchanged.

    Linked are documents whose sets of ``o.width``-word shingles (ASCII case folded) have a Jaccard similarity of
    ``o.similarity`` or more, see ``NearOptions``.  Equal sets are folded into one before.  A text of at most ``width`` words is one
    shingle; texts without words (null, empty) equal each other.  Rows with one id but different texts are documents
    of their own (of those the smallest text hash stays); of rows that agree in both one stays (the smallest by
    all columns). Rows with a null id stay as they are. An empty table gives an empty one.
    """
    with scratch() as keep:
        key, own, row = free_names(docs, "_id", "_own", "_row")
        named = docs.where(F.col(id_col).isNotNull())
        signed = saved(_signed_sets(named, o, id_col, text_col), "signed")
        bands = [f"b{k}" for k in range(o.bands)]
        folded = signed.groupBy("h").agg(F.min(F.struct("id", "own")).alias("first"), F.min("fp").alias("fp"), *[F.min(b).alias(b) for b in bands])
        distinct = saved(folded.select("h", "first.id", "first.own", "fp", *bands), "distinct")
        graph = similar_sets(distinct.select(F.explode(F.array(*bands)).alias("band"), "h"), _DocumentSets(named, distinct, o, id_col, text_col), o.broadcast_rows)
        of = saved(distinct.select("h", "id", "own").join(graph, "h", "left").withColumn("component", F.coalesce("component", "h")), "components")
        stay = saved(of.groupBy("component").agg(F.min(F.struct("id", "own")).alias("first")).select("first.*"), "stay")
        rows = signed.groupBy("id", "own").agg(F.count("*").alias("n"))
        gone = keep(saved(rows.join(stay, ["id", "own"], "left_anti").select(F.col("id").alias(key), F.col("own").alias(own)), "gone"))
        twice = keep(saved(rows.where("n > 1").join(stay, ["id", "own"], "left_semi").select(F.col("id").alias(key), F.col("own").alias(own)), "twice"))
        here = lambda x: (docs[id_col] == x[key]) & (F.xxhash64(docs[text_col]) == x[own])
        kept = docs.join(few(gone, o.broadcast_rows), here(gone), "left_anti")
        if twice.isEmpty():
            return kept
        again = docs.join(few(twice, o.broadcast_rows), here(twice)).groupBy(key, own).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
        return kept.join(few(twice, o.broadcast_rows), here(twice), "left_anti").unionByName(again)

"""Quality rules: document statistics and gradient-boosted trees flattened into numpy node arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, saved, scratch

_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = b".,;:!?'\"()-"
_CONTINUATION = bytes(range(128, 192))
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the sign of their effect on quality: -1 may only lower the score as it grows, 1 only raise it.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": -1, "digit_share": 0, "punct_share": 0, "distinct_share": 1, "log_lines": 0,
}
#: Labelled rows that a model is fitted on at most, chosen by a hash of the id.
FIT_ROWS = 20_000


def _tally(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that are found twice or more, the first time included."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, n)
    key = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        key = (key ^ (key >> np.uint64(31))) * _MIX + a[j : n - width + 1 + j] + np.uint64(1)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    delta = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + width, -1)
    return int((np.cumsum(delta[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of a whole text; null counts as empty, and an empty text has zeros throughout."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    chars = len(raw) - _tally(raw, _CONTINUATION)
    word_chars = chars - _tally(raw, _SPACE)
    symbols = _tally(raw, _SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    share = lambda k, of: k / of if of else 0.0
    features = [
        math.log1p(n), share(word_chars, n), share(symbols, word_chars), share(dup_lines, len(lines)), share(repeats, n),
        share(_tally(raw, _UPPER), word_chars), share(_tally(raw, _DIGIT), word_chars), share(_tally(raw, _PUNCT), word_chars),
        share(len(set(words)), n), math.log1p(len(lines)),
    ]
    return [n, word_chars, symbols, dup_lines, repeats], features


def base_failed(counts: list[int], min_words: int = 10, max_repeat_percent: int = 20) -> bool:
    return counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]


@dataclass
class Trees:
    """All trees as flat arrays: node k of tree t tests feature[t, k] < threshold[t, k]; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row, all rows walking down together."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int32)
            for _ in range(self.depth):
                low = x[rows, self.feature[t, node]] < self.threshold[t, node]
                node = np.where(low, self.left[t, node], self.right[t, node])
            total += self.value[t, node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms.

    A split on a feature with a sign is taken only if its two leaf values stand in that order; the mid of both
    bounds all leaves below on either side, so every tree, and their sum, is monotonic. One class alone
    (or no row at all) gives a constant score.
    """
    nodes = 2 ** (depth + 1) - 1
    prior = min(max((y.sum() + 0.5) / (len(y) + 1.0), 1e-3), 1 - 1e-3)
    out = Trees(np.zeros((trees, nodes), np.int32), np.zeros((trees, nodes)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.tile(np.arange(nodes, dtype=np.int32), (trees, 1)), np.zeros((trees, nodes)), math.log(prior / (1 - prior)), depth)
    if not len(x) or y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(x), out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        todo = [(0, np.arange(len(x)), -np.inf, np.inf, 0)]
        while todo:
            node, rows, low, high, level = todo.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            leaf = lambda g, h, low=low, high=high: np.clip(-g / (h + ridge), low, high)
            gain = lambda g, h, v: -(g * v + 0.5 * (h + ridge) * v * v)
            value = leaf(g, h)
            out.value[t, node] = rate * value
            best = (1e-6 + gain(g, h, value), None)
            for j, c in enumerate(cuts) if level < depth else ():
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(binned[rows, j], grad[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(binned[rows, j], hess[rows], len(c) + 1))[:-1]
                a, b = leaf(gs, hs), leaf(g - gs, h - hs)
                total = gain(gs, hs, a) + gain(g - gs, h - hs, b)
                bad = (hs < least) | (h - hs < least) | ((signs[j] > 0) & (a > b)) | ((signs[j] < 0) & (a < b))
                k = int(np.argmax(np.where(bad, -np.inf, total)))
                if not bad[k] and total[k] > best[0]:
                    best = (total[k], (j, k, a[k], b[k]))
            if best[1] is None:
                margin[rows] += rate * value
                continue
            j, k, a, b = best[1]
            mid, go = (a + b) / 2, binned[rows, j] <= k
            out.feature[t, node], out.threshold[t, node] = j, cuts[j][k]
            out.left[t, node], out.right[t, node] = 2 * node + 1, 2 * node + 2
            up, down = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
            todo += [(2 * node + 1, rows[go], *up, level + 1), (2 * node + 2, rows[~go], *down, level + 1)]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = FIT_ROWS) -> Trees:
    """Fit on at most about ``max_rows`` labelled documents; only their statistics reach the driver.

    Null ids and labels are left out. A document labelled more than once counts once, by its smallest label; of rows that
    share an id one counts, that with the least statistics in order. Without a labelled document all scores are alike.
    """
    with scratch():
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_y"))
        known = saved(bounded_sample(known, id_col, max_rows, known.count()), "labels")
        # at most about max_rows rows of an id and a number
        rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _slices(batches):
                found = [statistics(t)[1] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "y": b.column(2), "x": pa.array(found, pa.list_(pa.float64()))})

        kind = docs.schema[id_col].dataType.simpleString()
        got = rows.mapInArrow(measure, f"id {kind}, y int, x array<double>").groupBy("id").agg(F.min("y").alias("y"), F.min("x").alias("x")).orderBy("id").collect()
        x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
        return fit_trees(x, np.array([r.y > 0 for r in got], float), list(FEATURES.values()))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, so that few texts are held as strings at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, min_score: float = 0.5) -> DataFrame:
    """One row a document: id, COUNTS, ``score``, ``base_failed`` and ``kept``. No shuffle.

    Null texts count as empty, which the base rules fail. Repeated rows are each judged; other columns are ignored.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(trees)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            counts, score, failed, kept = verdicts(b.column(1).to_pylist(), model.value, min_words, max_repeat_percent, min_score)
            yield pa.RecordBatch.from_pydict({"id": b.column(0)} | {k: pa.array([c[j] for c in counts], pa.int64()) for j, k in enumerate(COUNTS)} | {"score": pa.array(score), "base_failed": pa.array(failed), "kept": pa.array(kept)})

    kind = docs.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(apply, f"id {kind}, {fields}, score double, base_failed boolean, kept boolean").withColumnRenamed("id", id_col)


def verdicts(texts: list[str | None], trees: Trees, min_words: int = 10, max_repeat_percent: int = 20, min_score: float = 0.5) -> tuple[list[list[int]], np.ndarray, list[bool], list[bool]]:
    found = [statistics(t) for t in texts]
    score = trees.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES)))
    failed = [base_failed(c, min_words, max_repeat_percent) for c, _ in found]
    return [c for c, _ in found], score, failed, [not f and bool(s >= min_score) for f, s in zip(failed, score.tolist(), strict=True)]


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", min_words: int = 10, max_repeat_percent: int = 20, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged. Null and empty texts don't; repeated rows are each judged."""
    model = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            kept = verdicts(b.column(at).to_pylist(), model.value, min_words, max_repeat_percent, min_score)[3]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)



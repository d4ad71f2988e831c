"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled, noisy-or joins them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, saved, scratch

#: Labelled rows that a model is fitted on at most, chosen by a hash of the id.
FIT_ROWS = 12_000
#: Bytes of words of theirs that are fitted on at most, about; beyond, fewer rows are chosen.
FIT_BYTES = 64 << 20
#: Words that a model weighs at most: those whose presence depends most on the label.
FIT_WORDS = 1_000
_SENTENCE = re.compile(r"[^.!?\n]+")
#: ASCII other than letters, digits and ' to a space, A-Z to a-z; other bytes stay.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c == 39 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split()


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Spans of sentences (runs without . ! ? or a line end) that hold more than white space."""
    return [m.span() for m in _SENTENCE.finditer(text or "") if m.group().strip()]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def _sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        get = self.weights.get
        return [(a, b, float(_sigmoid(self.bias + sum(get(w, 0.0) for w in set(words(text[a:b])))))) for a, b in sentences(text)]

    def score(self, text: str | None) -> float:
        """Noisy-or of the sentences' probabilities; a text without sentences has one of no words."""
        plain = float(_sigmoid(self.bias))
        if not text:
            return plain
        if not self.weights.keys() & set(words(text)):
            return 1 - (1 - plain) ** max(1, sum(1 for m in _SENTENCE.finditer(text) if m.group().strip()))
        clean = 1.0
        for _, _, p in self._sentence_scores(text):
            clean *= 1 - p
        return 1 - clean

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Character spans and scores of sentences that are likely toxic by themselves."""
        if not text or not self.weights.keys() & set(words(text)):
            return []
        return [x for x in self._sentence_scores(text) if x[2] >= least]


class _Bags(Sequence):
    """Documents as bytes, a sentence a line; split when they are read, so that the words aren't all held at once."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, k: int) -> list[list[bytes]]:
        return [s.split(b" ") for s in self.raw[k].split(b"\n")] if self.raw[k] else []


def _gradient(theta: np.ndarray, y: np.ndarray, plain: np.ndarray, doc_of: np.ndarray, sent_of: np.ndarray, word_of: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Loss of the noisy-or likelihood, and its gradient by the words' weights and the bias (last).

    ``plain`` counts each document's sentences without a word; others are of ``doc_of``, and hold ``word_of`` at ``sent_of``.
    """
    ps = _sigmoid(theta[-1] + np.bincount(sent_of, theta[word_of], len(doc_of)))
    p0 = _sigmoid(theta[-1])
    clean = plain * np.log1p(-p0) + np.bincount(doc_of, np.log1p(-np.minimum(ps, 1 - 1e-12)), len(y))
    q = np.clip(np.exp(clean), 1e-12, 1 - 1e-12)  # probability of a clean document
    loss = -(y * np.log(1 - q) + (1 - y) * np.log(q)).mean() + decay / 2 * (theta[:-1] ** 2).sum()
    # d loss / d log q is y q / (1 - q) - (1 - y); d log(1 - sigmoid(z)) / dz is -sigmoid(z)
    g = y * q / (1 - q) - (1 - y)
    gs = -g[doc_of] * ps
    grad = np.append(np.bincount(word_of, gs[sent_of], len(theta) - 1), gs.sum() - (g * plain).sum() * p0) / len(y)
    grad[:-1] += decay * theta[:-1]
    return float(loss), grad


def train(bags: Sequence[list[list[bytes]]], labels: list[int], max_words: int = FIT_WORDS, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> ToxicityModel:
    """Sentence weights from document labels, by gradient descent on the noisy-or likelihood.

    ``bags`` has the words of each sentence of each document.  Words are chosen by how far the number
    of labelled documents that hold them departs from chance. One class alone, or nothing, gives a constant score.
    """
    y = np.array(labels, float)
    base = float(np.clip((y.sum() + 0.5) / (len(y) + 1.0), 1e-3, 1 - 1e-3))
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, float(np.log(base / (1 - base))))
    seen, toxic = Counter(), Counter()
    for bag, label in zip(bags, labels, strict=True):
        own = {w for s in bag for w in s}
        seen.update(own)
        if label:
            toxic.update(own)
    z = {w: (toxic[w] - n * base) / np.sqrt(n * base * (1 - base)) for w, n in seen.items() if n >= 5}
    chosen = sorted((w for w in z if z[w] >= 4), key=lambda w: (-z[w], w))[:max_words]
    index = {w: k for k, w in enumerate(chosen)}
    plain = np.zeros(len(bags))  # sentences without a chosen word
    doc_of, sent_of, word_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            hit = {index[w] for w in s if w in index}
            if hit:
                sent_of += [len(doc_of)] * len(hit)
                word_of += sorted(hit)
                doc_of.append(d)
            else:
                plain[d] += 1
        if not bag:
            plain[d] = 1
    doc_of, sent_of, word_of = (np.array(x, np.int64) for x in (doc_of, sent_of, word_of))
    theta = np.zeros(len(chosen) + 1)
    theta[:-1] = 2.0
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = _gradient(theta, y, plain, doc_of, sent_of, word_of, decay)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return ToxicityModel({w: float(theta[k]) for w, k in index.items()}, float(theta[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_fold: tuple[int, int] | None = (5, 0), max_rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on at most about ``max_rows`` labelled documents outside the held-out fold, and FIT_BYTES of their words.

    Null ids and labels are left out. A document labelled more than once counts once, by its largest label; of rows that
    share an id one counts, whichever has the least words in order. Without a labelled document all scores are alike.
    """
    with scratch():
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
        if held_out_fold:
            known = known.where(fold(id_col, held_out_fold[0]) != held_out_fold[1])
        known = saved(bounded_sample(known, id_col, max_rows, known.count()), "labels")
        rows = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # about max_rows rows of an id and a number

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bags = [b"\n".join(b" ".join(sorted(set(words(t[a:e])))) for a, e in sentences(t)) if t else b"" for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "y": b.column(2), "bag": pa.array(bags, pa.binary())})

        kind = docs.schema[id_col].dataType.simpleString()
        one = saved(rows.mapInArrow(split, f"id {kind}, y int, bag binary").groupBy("id").agg(F.max("y").alias("y"), F.min("bag").alias("bag")), "bags")
        got = bounded_sample(one, "id", FIT_BYTES, one.agg(F.sum(F.octet_length("bag"))).first()[0] or 0).orderBy("id").toArrow()
        return train(_Bags(got.column("bag").to_pylist()), [int(y > 0) for y in got.column("y").to_pylist()])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``(id, score, predicted)`` for every whole text, and with ``spans`` the offending sentences. No shuffle.

    Null and empty texts get the score of a sentence without words. Repeated rows are each scored; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                texts = b.column(1).to_pylist()
                found = [shared.value.score(t) for t in texts]
                out = {"id": b.column(0), "score": pa.array(found, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in found], pa.int32())}
                if spans:
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                    out["sentences"] = pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in shared.value.offending(t)] for t in texts], kind)
                yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", sentences array<struct<start:int,end:int,score:double>>" if spans else ""
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(apply, f"id {kind}, score double, predicted int{more}").withColumnRenamed("id", id_col)

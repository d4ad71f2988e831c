"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, saved, scratch

#: Labelled documents a language is learned from at most, chosen by a hash of the id.
FIT_DOCUMENTS = 500
#: Distinct words of the sample that are learned from at most, over all languages: the most frequent ones of each.
FIT_WORDS = 150_000
#: Bytes from which on a sampled word is learned from in parts; texts are scored whole.
FIT_LONGEST = 1024
#: Words whose scores a worker remembers, of up to CACHE_LONGEST bytes; all are forgotten when there are so many.
CACHE_WORDS, CACHE_LONGEST = 400_000, 64
#: Places of words that are worked on together.
CELLS = 1 << 16
UNDETERMINED = "und"
#: ASCII other than letters to a space; other bytes stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@lru_cache(2)
def vocabulary(path: str) -> dict[bytes, int]:
    """All pieces of the file; each single byte is a piece, so every text has a segmentation."""
    with open(path, "rb") as lines:
        pieces = {base64.b64decode(x.split()[0]) for x in lines if x.strip()}
    return {p: k for k, p in enumerate(sorted(pieces | {bytes([b]) for b in range(256)}))}


@lru_cache(2)
def _lengths(path: str) -> list[int]:
    return sorted({len(p) for p in vocabulary(path)})


def words(text: str) -> list[bytes]:
    """Lower-cased runs of letters, each with a space before it."""
    return [b" " + w for w in text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()]


def _parts(word: bytes, most: int) -> list[bytes]:
    """The word in parts of up to ``most`` bytes, cut between characters."""
    out = []
    while len(word) > most:
        cut = next((k for k in range(most, most - 4, -1) if word[k] & 0xC0 != 0x80), most)
        out.append(word[:cut])
        word = word[cut:]
    return [*out, word]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def batches_of(some: list[bytes]) -> Iterator[np.ndarray]:
    """Numbers of words, shortest first, such that all together take up to CELLS places when padded (or one word)."""
    sizes = np.array([len(w) for w in some], np.int64)
    order, at = np.argsort(sizes, kind="stable"), 0
    while at < len(order):
        fits = np.arange(1, len(order) - at + 1) * (sizes[order[at:]] + 1) <= CELLS
        n = max(1, int(np.count_nonzero(fits)))
        yield order[at : at + n]
        at += n


class Lattice:
    """All pieces at all places of some words, by where they end and by where they start; sums are over logarithms."""

    def __init__(self, some: list[bytes], path: str):
        pieces, lengths = vocabulary(path), _lengths(path)
        word, start, end, piece = [], [], [], []
        for k, w in enumerate(some):
            n = len(w)
            for i in range(n):
                for size in lengths:
                    if i + size > n:
                        break
                    if (p := pieces.get(w[i : i + size])) is not None:
                        word.append(k)
                        start.append(i)
                        end.append(i + size)
                        piece.append(p)
        self.n, self.lengths = len(some), np.array([len(w) for w in some], np.int64)
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        self.longest = int(self.lengths.max(initial=0))

    def _by(self, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each place: the edges there in order of word, where each word's edges begin, and the words."""
        order = np.lexsort((self.word, place))
        cuts = np.searchsorted(place[order], np.arange(self.longest + 2))
        for j in range(self.longest + 1):
            e = order[cuts[j] : cuts[j + 1]]
            if len(e):
                heads = np.flatnonzero(np.concatenate([[True], np.diff(self.word[e]) > 0]))
                yield j, e, heads, self.word[e[heads]]

    @staticmethod
    def _sum(v: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Logarithms of sums of exp(v) over stretches of rows."""
        most = np.maximum.reduceat(v, heads, axis=0)
        return most + np.log(np.add.reduceat(np.exp(v - np.repeat(most, np.diff(np.append(heads, len(v))), axis=0)), heads, axis=0))

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """alpha[place, word, ...]: log of the summed probability of all segmentations up to a place; ``logp`` is by piece."""
        alpha = np.full((self.longest + 1, self.n, *logp.shape[1:]), -np.inf)
        alpha[0] = 0
        for j, e, heads, who in self._by(self.end):
            alpha[j, who] = self._sum(alpha[self.start[e], self.word[e]] + logp[self.piece[e]], heads)
        return alpha

    def log_likelihood(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.lengths, np.arange(self.n)]

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, summed over all segmentations of all words (forward-backward)."""
        alpha = self.forward(logp)
        beta = np.full_like(alpha, -np.inf)
        beta[self.lengths, np.arange(self.n)] = 0
        for i, e, heads, who in reversed(list(self._by(self.start))):
            beta[i, who] = self._sum(beta[self.end[e], self.word[e]] + logp[self.piece[e]], heads)
        total = alpha[self.lengths, np.arange(self.n)]
        use = np.exp(alpha[self.start, self.word] + logp[self.piece] + beta[self.end, self.word] - total[self.word])
        return np.bincount(self.piece, use * counts[self.word], len(logp))


def _streamed(word: bytes, logp: np.ndarray, path: str) -> np.ndarray:
    """``Lattice.log_likelihood`` of one word that may be very long: only as many places as a piece has bytes are held."""
    pieces, lengths = vocabulary(path), _lengths(path)
    ring = lengths[-1] + 1
    alpha = np.full((ring, logp.shape[1]), -np.inf)
    alpha[0] = 0
    for j in range(1, len(word) + 1):
        found = [(p, (j - size) % ring) for size in lengths if size <= j and (p := pieces.get(word[j - size : j])) is not None]
        v = logp[[p for p, _ in found]] + alpha[[i for _, i in found]]
        most = v.max(0)
        alpha[j % ring] = most + np.log(np.exp(v - most).sum(0))
    return alpha[len(word) % ring]


def log_likelihoods(some: list[bytes], logp: np.ndarray, path: str) -> np.ndarray:
    """A row for each word, a column for each language."""
    out = np.zeros((len(some), logp.shape[1]))
    short = [k for k, w in enumerate(some) if len(w) < CELLS // 64]
    for at in batches_of([some[k] for k in short]):
        here = [short[k] for k in at]
        out[here] = Lattice([some[k] for k in here], path).log_likelihood(logp)
    for k, w in enumerate(some):
        if len(w) >= CELLS // 64:
            out[k] = _streamed(w, logp, path)
    return out


@dataclass
class LanguageModel:
    """Piece probabilities of each language; ``path`` names the vocabulary file."""

    languages: list[str]
    probabilities: np.ndarray  # language x piece
    path: str
    cache: dict[bytes, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self):
        return {"languages": self.languages, "probabilities": self.probabilities, "path": self.path, "cache": {}, "rows": None}

    def _learn_words(self, new: list[bytes]) -> None:
        if self.rows is None or len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.rows = np.zeros((1 << 16, len(self.languages)), np.float32)
        at = len(self.cache)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(new)] = log_likelihoods(new, np.log(self.probabilities).T, self.path)
        self.cache.update(zip(new, range(at, at + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability (all languages alike beforehand).

        Words of a text are no independent witnesses: the sum of their log-likelihoods counts by the root of their number.
        """
        split = [words(t) if has_letter(t) else [] for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        if len(self.cache) > CACHE_WORDS or self.rows is None:
            self._learn_words([])
        cache = self.cache
        self._learn_words(list({w for s in split for w in s if w not in cache and len(w) <= CACHE_LONGEST}))
        long = [(k, w) for k, s in enumerate(split) for w in s if len(w) > CACHE_LONGEST]
        sums = np.zeros((len(texts), len(self.languages)))
        if long:
            np.add.at(sums, [k for k, _ in long], log_likelihoods([w for _, w in long], np.log(self.probabilities).T, self.path))
        out = []
        for k, s in enumerate(split):
            if not s:
                out.append((UNDETERMINED, 0.0))
                continue
            known = [cache[w] for w in s if len(w) <= CACHE_LONGEST]
            total = (self.rows[np.array(known, np.int64)].sum(0, dtype=np.float64) + sums[k]) / np.sqrt(len(s))
            p = np.exp(total - total.max())
            best = int(np.argmax(p))
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out


def estimate(counts: dict[str, dict[bytes, int]], path: str, rounds: int = 3, smoothing: float = 0.02) -> LanguageModel:
    """Piece probabilities by EM over all segmentations, from word counts of each language.

    The start favours long pieces; the result is mixed with the mean of all languages, and that with equal shares of all pieces.
    """
    pieces = vocabulary(path)
    langs = sorted(counts)
    start = np.array([float(len(p)) for p in pieces])
    found = []
    for lang in langs:
        own: Counter = Counter()
        for w, n in counts[lang].items():
            own.update({x: n for x in _parts(w, FIT_LONGEST)} if len(w) > FIT_LONGEST else {w: n})
        some = sorted(own)
        lattices = [(Lattice([some[k] for k in at], path), np.array([own[some[k]] for k in at], float)) for at in batches_of(some)]
        p = start / start.sum()
        for _ in range(rounds):
            use = sum((x.expected(np.log(p), n) for x, n in lattices), np.zeros(len(p))) + 1e-9
            p = use / use.sum()
        found.append(p)
    flat = np.full(len(pieces), 1 / len(pieces))
    if not found:
        return LanguageModel([], np.zeros((0, len(pieces))), path)
    mean = 0.9 * np.mean(found, 0) + 0.1 * flat
    return LanguageModel(langs, np.stack([(1 - smoothing) * p + smoothing * mean for p in found]), path)


def word_share(sizes: list[int], bound: int) -> int:
    """The most words of a language such that all together keep ``bound`` at most."""
    level = 0
    for k, n in enumerate(sorted(sizes)):
        level = bound // (len(sizes) - k)
        if n > level:
            return level
        bound -= n
    return max(sizes, default=0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out_fold: tuple[int, int] | None = (4, 2), path: str | None = None, max_documents: int = FIT_DOCUMENTS) -> LanguageModel:
    """Learn from text and non-null language of documents outside the held-out fold.

    At most about ``max_documents`` of a language are used, chosen by a hash of the id against the
    language's own count, and of their distinct words the most frequent, FIT_WORDS over all
    languages: what languages with few words leave of an equal share goes to the others. Ties go by a hash of the word.
    """
    with scratch():
        known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
        if held_out_fold:
            known = known.where(fold(id_col, held_out_fold[0]) != held_out_fold[1])
        sizes = {r[0]: r[1] for r in known.groupBy(lang_col).agg(F.count("*")).collect()}  # one row a language
        sample = None
        for lang, total in sorted(sizes.items()):
            share = min(1.0, max_documents / total)
            here = (F.col(lang_col) == lang) & (F.pmod(F.xxhash64(F.lit("language"), F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)))
            sample = here if sample is None else sample | here
        path = path or default_path()
        if sample is None:
            return estimate({}, path)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found: Counter = Counter()
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found.update((lang, w) for w in words(text))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

        totals = known.where(sample).select(lang_col, text_col).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        counts: dict[str, dict[bytes, int]] = {lang: {} for lang in sizes}
        totals = saved(totals, "words")
        level = word_share([r[1] for r in totals.groupBy("lang").agg(F.count("*")).collect()], FIT_WORDS)
        place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.xxhash64("word"), "word"))
        for r in totals.withColumn("place", place).where(F.col("place") <= level).collect():
            counts[r.lang][bytes(r.word)] = r.n
        return estimate({k: v for k, v in counts.items() if v}, path)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every whole text, without a shuffle.

    ``und`` with score 0 for null texts and texts without a letter. Repeated rows are each judged; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                found = shared.value.predict(b.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([min(1.0, s) for _, s in found], pa.float64())})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(apply, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

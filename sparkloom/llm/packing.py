"""Sum-of-squares online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Words whose ids a worker remembers, by the library's own encoding; all are forgotten when there are so many.
CACHE_WORDS = 300_000
#: Windows that a partition holds open at most; beyond, all are cut into full ones as at its end.
MAX_OPEN = 4096
#: Sequence ids of a partition start at its number times this.
SEQUENCES = 1 << 32
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class WordEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own for the whole text.

    The vocabulary lower-cases, drops white space and never joins over it, so ids of a text are those of
    its space-separated parts in turn, which this dictionary remembers.  Between an ASCII letter and
    a full stop or comma no piece joins either, so such a part is put together from both.  A text that
    may hold a special token's string goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, part: bytes) -> bytes:
        if part.isalpha():  # of ASCII letters alone: the rules before the model change nothing
            ids = [x.id for x in self.model.tokenize(part.decode())]
        elif part[-1:] in (b".", b",") and part[-2:-1].isalpha():
            return self._keep(part, self[part[:-1]] + self[part[-1:]])
        else:
            ids = self.tokenizer.encode(part.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        return self._keep(part, _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes())

    def _keep(self, part: bytes, ids: bytes) -> bytes:
        if len(part) <= 200:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if b"<|" in raw:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join(map(self.__getitem__, raw.lower().replace(b"\n", b" ").split(b" "))))
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


Piece = tuple[int, int, bytes, int]  # document (row number), start, ids, ids of the document


class SquaresPacker:
    """Places each document's remainder into the fill level that keeps the sum of squared level counts least.

    ``count[h]`` is the number of open windows filled to h. Moving a window from h to h + r changes the sum by
    2 (count[h + r] - count[h]) + 2; a new window by 2 count[r] + 1; filling one up by 1 - 2 count[h].
    Ties go to the fullest window. Whole windows of a long document are closed at once.
    """

    def __init__(self, size: int):
        self.size, self.count = size, np.zeros(size + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.windows = 0

    def add(self, doc: int, ids: bytes, total: int) -> Iterator[list[Piece]]:
        """Windows that are closed by this document."""
        size, whole = self.size, total // self.size
        for k in range(whole):
            yield [(doc, k * size, ids[4 * k * size : 4 * (k + 1) * size], total)]
        r = total - whole * size
        if not r:
            return
        after = self.count[r:].copy()  # after[h] = count[h + r]
        after[-1] = 0
        cost = 2 * (after - self.count[: size - r + 1]) + 2
        cost[-1] -= 1
        cost[self.count[: size - r + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * self.count[r] + 1
        h = len(cost) - 1 - int(np.argmin(cost[::-1]))
        window = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
            self.windows -= 1
        window.append((doc, whole * size, ids[4 * whole * size :], total))
        if h + r == size:
            yield window
        else:
            self.count[h + r] += 1
            self.open[h + r].append(window)
            self.windows += 1
            if self.windows > MAX_OPEN:
                yield from self.rest(last=False)

    def rest(self, last: bool = True) -> Iterator[list[Piece]]:
        """What is open, cut into full windows; at the end the last ones have powers of two ids and need no padding, before it what is left stays open."""
        pieces = [p for h in range(self.size, 0, -1) for w in self.open[h] for p in w]
        left = sum(len(p[2]) // 4 for p in pieces)
        self.count[:], self.open, self.windows = 0, [[] for _ in range(self.size + 1)], 0
        window: list[Piece] = []
        room = target = 0
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    target = room = self.size if left >= self.size or not last else 1 << (left.bit_length() - 1)
                take = min(room, len(ids) // 4 - at // 4)
                window.append((doc, start + at // 4, ids[at : at + 4 * take], total))
                at, room, left = at + 4 * take, room - take, left - take
                if not room:
                    yield window
                    window = []
        assert left == 0 and (not window or not last), target
        if window:
            self.count[self.size - room], self.windows = 1, 1
            self.open[self.size - room].append(window)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    Every partition is packed as it is read, without a shuffle; it holds its open windows, MAX_OPEN of under
    ``size`` ids each at most, which are concatenated and cut at its end so that none is padded.  Each id of a document lies in exactly
    one piece. A null or empty text is ``end_id`` alone. Repeated rows are packed each; other columns are ignored.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size is a power of two")
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path or default_path()), SquaresPacker(size)
        last = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() * SEQUENCES
        kind = None
        rows: list[tuple] = []

        def place(window: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, total in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, offset, np.frombuffer(ids, "<u4").astype(np.int64) if with_ids else None))
                offset += n
            sequence += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            out = {id_col: pa.array([r[0] for r in rows], kind)} | {c: pa.array([r[k + 1] for r in rows], pa.int64()) for k, c in enumerate(names)}
            return pa.RecordBatch.from_pydict(out | ({"ids": pa.array([r[7] for r in rows], pa.list_(pa.int64()))} if with_ids else {}))

        for whole in batches:
            kind = whole.column(0).type
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                    ids += last
                    for window in packer.add(doc, ids, len(ids) // 4):
                        place(window)
                if rows:
                    yield batch_of(rows)
                    rows = []
        encode.clear()  # a worker goes on to other work
        for window in packer.rest():
            place(window)
        if rows:
            yield batch_of(rows)

    return docs.select(id_col, text_col).mapInArrow(apply, schema)

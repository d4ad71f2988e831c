"""Suffix and LCP arrays by external induced sorting.

Suffixes are induced from sorted ones in order of their first symbol.  What is induced waits in a monotone priority queue
whose far ranges lie on disk beyond a memory budget; with each suffix goes the length of its common prefix with the one before
it.  Suffixes of the left-most-S kind are sorted first, by the same procedure on the string of their names (recursion).
Whatever has an element for each symbol is an array of the workspace, on disk beyond a share of the budget, and is worked
on in blocks; so are the suffixes of one first symbol, however many they are.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

_ENTRY = np.dtype([("key", "<i8"), ("suffix", "<i8"), ("lcp", "<i4")])
FAR = int(np.iinfo(np.int64).max)


class Workspace:
    """Arrays in memory up to a share of a budget of bytes, beyond that in files of a folder that goes at the end.

    Without a ``parent`` folder all stays in memory.  ``spilled`` counts the bytes that queues wrote, ``deepest`` the recursions.
    """

    def __init__(self, budget: int = 256 << 20, parent: str | None = None):
        self.budget, self.parent, self.folder, self.files = budget, parent, None, 0
        #: Elements that are worked on together, of which some hundred bytes are held each.
        self.block = min(1 << 16, max(256, budget // 1024))
        #: Reduced strings of up to so many symbols are sorted in memory, which ends the recursion.
        self.base = budget // 256
        self.spilled = self.deepest = 0
        self.paths: dict[int, str] = {}

    def path(self) -> str:
        if self.folder is None:
            os.makedirs(self.parent, exist_ok=True)
            self.folder = tempfile.mkdtemp(prefix="suffix-", dir=self.parent)
        self.files += 1
        return f"{self.folder}/{self.files}"

    def array(self, n: int, dtype) -> np.ndarray:
        if self.parent is None or n * np.dtype(dtype).itemsize <= self.budget // 64:
            return np.empty(n, dtype)
        path = self.path()
        out = np.memmap(path, dtype, "w+", shape=(n,)).view(np.ndarray)  # plain slices cost less
        self.paths[out.ctypes.data] = path
        return out

    def blocks(self, n: int, first: int = 0) -> Iterator[tuple[int, int]]:
        for a in range(first, n, self.block):
            yield a, min(n, a + self.block)

    def free(self, *arrays: np.ndarray | None) -> None:
        """Files of arrays that are not needed any more."""
        for a in arrays:
            if a is not None and (path := self.paths.pop(a.ctypes.data, None)):
                os.remove(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        if self.folder is not None:
            shutil.rmtree(self.folder, ignore_errors=True)


class MonotoneQueue:
    """Entries (key, suffix, lcp) by key, first in first out; what is pushed is never below the keys taken so far.

    Keys are split into ranges.  Only the range at the front is in memory, in order; others are
    buffers, which all go to their files when together they exceed their share of the budget.  A key so frequent that
    it would fill a range has one to itself, which needs no order and is read block by block.
    """

    def __init__(self, sample: np.ndarray, total: int, space: Workspace):
        """``sample`` has keys in order, out of ``total`` to come."""
        width = min(1 << 13, max(64, space.budget // (12 * _ENTRY.itemsize)))
        step = max(1, int(len(sample) * width / max(total, 1)))
        cuts = sample[step::step] if total > width else sample[:0]
        heavy = np.unique(cuts[1:][cuts[1:] == cuts[:-1]])
        self.bounds, self.space = np.unique(np.concatenate([cuts, heavy + 1])), space
        self.single = np.concatenate([[False], np.isin(self.bounds, heavy)])
        n = len(self.bounds) + 1
        self.ahead: dict[int, list[np.ndarray]] = {}  # to be read before the file
        self.files: dict[int, str] = {}
        self.read: dict[int, int] = {}
        self.later: dict[int, list[np.ndarray]] = {}  # in place of files where there is no folder
        self.pending: list[np.ndarray] = []  # to be read after the file, of all ranges
        self.counts = np.zeros(n, np.int64)  # entries outside the front
        self.held, self.at, self.front = 0, 0, np.empty(0, _ENTRY)

    def push(self, entries: np.ndarray) -> None:
        """``entries`` are in order of key."""
        where = np.searchsorted(self.bounds, entries["key"], "right")
        if where[0] < self.at:  # the front was taken from further on, as nothing lay here
            if len(self.front):
                self.ahead.setdefault(self.at, []).insert(0, self.front)
                self.counts[self.at] += len(self.front)
            self.at, self.front = int(where[0]), np.empty(0, _ENTRY)
        if where[0] == self.at and not self.single[self.at]:
            here = int(np.searchsorted(where, self.at, "right"))
            both = np.concatenate([self.front, entries[:here]])
            self.front = both.take(_order(both["key"]))
            entries, where = entries[here:], where[here:]
        if len(entries):
            self.pending.append(entries.copy())
            np.add.at(self.counts, where, 1)
            self.held += entries.nbytes + 150  # with what an array takes besides
            if self.held > min(1 << 20, self.space.budget // 12):
                self._spill()

    def _spill(self) -> None:
        every = np.concatenate(self.pending)
        self.pending, self.held = [], 0
        where = np.searchsorted(self.bounds, every["key"], "right")
        order = _order(where)
        every, where = every.take(order), where[order]
        cuts = [0, *(np.flatnonzero(np.diff(where)) + 1).tolist(), len(every)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            r = int(where[a])
            if not self.space.parent:
                self.later.setdefault(r, []).append(every[a:b])
                continue
            if r not in self.files:
                self.files[r] = self.space.path()
            with open(self.files[r], "ab") as out:
                out.write(every[a:b].tobytes())
        self.space.spilled += every.nbytes if self.space.parent else 0

    def _waiting(self, r: int) -> list[np.ndarray]:
        """Takes a range's entries out of what is pending."""
        if not self.pending:
            return []
        every = np.concatenate(self.pending)
        mine = np.searchsorted(self.bounds, every["key"], "right") == r
        self.pending = [every.take(np.flatnonzero(~mine))] if not mine.all() else []
        self.held = sum(x.nbytes + 150 for x in self.pending)
        return [every.take(np.flatnonzero(mine))] if mine.any() else []

    def _taken(self, r: int, most: int) -> np.ndarray:
        """Up to ``most`` entries of a range (or some more) in the order in which they came."""
        out, n = [], 0
        while n < most and self.ahead.get(r):
            out.append(self.ahead[r].pop(0))
            n += len(out[-1])
        if n < most and r in self.files:
            done = self.read.get(r, 0)
            more = np.fromfile(self.files[r], _ENTRY, count=most - n, offset=done * _ENTRY.itemsize)
            self.read[r] = done + len(more)
            out.append(more)
            n += len(more)
            if self.read[r] * _ENTRY.itemsize >= os.path.getsize(self.files[r]):
                os.remove(self.files.pop(r))
                del self.read[r]
        if n < most and r not in self.files:
            out += self.later.pop(r, []) + self._waiting(r)
            n = sum(map(len, out))
        self.counts[r] -= n
        return np.concatenate(out) if out else np.empty(0, _ENTRY)

    def head(self) -> np.ndarray:
        """The first entries in order: of a range, or some of one that has a single key."""
        if not len(self.front):
            more = np.flatnonzero(self.counts)
            if len(more):
                self.at = r = int(more[0])
                if self.single[r]:
                    self.front = self._taken(r, self.space.block)
                else:
                    both = self._taken(r, int(self.counts[r]))
                    self.front = both.take(_order(both["key"]))
        return self.front

    def limit(self) -> int:
        """Entries outside the front have at least this key."""
        if self.single[self.at]:
            return int(self.bounds[self.at - 1])
        return int(self.bounds[self.at]) if self.at < len(self.bounds) else FAR

    def take(self, n: int) -> None:
        self.front = self.front[n:]


def _order(key: np.ndarray) -> np.ndarray:
    """Places in order of key, equal ones as they come: a radix sort by 16 bits at a time, as far as the keys differ."""
    if not len(key):
        return np.zeros(0, np.int64)
    low = key.min()
    rest, order = int(key.max()) - int(low), None
    key = key - low
    while True:
        part = key if order is None else key[order]
        more = np.argsort(part.astype(np.uint16), kind="stable")
        order = more if order is None else order[more]
        rest >>= 16
        if not rest:
            return order
        key = key >> 16


def _range_min(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of a[lo..hi], ends included, by a table of powers of two."""
    span = hi - lo + 1
    out = np.empty(len(lo), a.dtype)
    level, width, table = 0, 1, a
    todo = np.frexp(span)[1] - 1
    while True:
        here = np.flatnonzero(todo == level)
        out[here] = np.minimum(table[lo[here]], table[hi[here] - width + 1])
        if level >= todo.max(initial=0):
            return out
        table = np.minimum(table[:-width], table[width:])
        level, width = level + 1, 2 * width


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, which differ before the end."""
    out = np.zeros(len(a), np.int32)
    live = np.arange(len(a))
    while len(live):
        live = live[t[a[live] + out[live]] == t[b[live] + out[live]]]
        out[live] += 1
    return out


class _Group:
    """What a group of suffixes of one first symbol, that is worked on in blocks, has induced so far under each symbol."""

    def __init__(self, symbols: int, space: Workspace):
        self.space, self.now, self.first = space, 0, 0
        self.block, self.least = space.array(symbols, np.int32), space.array(symbols, np.int32)
        for a, b in space.blocks(symbols):
            self.block[a:b] = -1
        # least common prefixes of finished blocks: of each the number, and the least from it on; both rise
        self.top, self.numbers, self.minima = 0, np.empty(64, np.int64), np.empty(64, np.int64)

    def begin(self) -> None:
        self.first, self.top = self.now, 0

    def link(self, symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """Common prefixes less one of suffixes induced by those ``at`` with the last ones under their (different) symbols; -1: none yet."""
        known = np.flatnonzero(self.block[symbol] >= self.first)
        out = np.full(len(symbol), -1, np.int64)
        if len(known):
            earlier = self.block[symbol[known]]
            here = np.minimum.accumulate(lcp.astype(np.int64))[at[known]]
            k = np.searchsorted(self.numbers[: self.top], earlier, "right")
            between = np.where(k < self.top, self.minima[np.minimum(k, len(self.minima) - 1)], FAR)  # of the blocks since
            out[known] = np.minimum(np.minimum(self.least[symbol[known]], between), here)
        return out

    def end(self, symbol: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> None:
        """The block is over: ``at`` are the last that induced the ``symbol``s."""
        behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(np.int32).max)
        self.block[symbol], self.least[symbol] = self.now, behind[at + 1]
        least = int(lcp.min())
        while self.top and self.minima[self.top - 1] >= least:
            self.top -= 1
        if self.top == len(self.minima):
            for name in ("numbers", "minima"):
                old = getattr(self, name)
                new = self.space.array(2 * len(old), np.int64)
                new[: len(old)] = old
                setattr(self, name, new)
                self.space.free(old)
        self.numbers[self.top], self.minima[self.top] = self.now, least
        self.top += 1
        self.now += 1


def _sample(t: np.ndarray, n: int, of, space: Workspace) -> np.ndarray:
    """Keys of some of ``n`` elements, evenly spread, in order."""
    return np.sort(of(np.arange(0, n, max(1, n // (4 * space.block)))))


def _induce(t: np.ndarray, symbols: int, run: np.ndarray, is_s: np.ndarray, want_s: bool, total: int, seeds: np.ndarray, seed_lcp: np.ndarray | None, space: Workspace) -> tuple[np.ndarray, np.ndarray | None]:
    """Suffixes of one kind in order (S: the largest first), with their common prefixes; the end is of neither kind.

    ``seeds`` are sorted suffixes of the other kind, which follow those of equal first symbol.  In each step a stretch of
    keys is taken from queue and seeds of which no suffix induces one that would belong into it; what is
    induced has 1 + the least common prefix in between in common.  Without common prefixes of the seeds there are none.  A symbol that induces itself, or that has too many
    suffixes, is taken alone, block by block.
    """
    sign, end = (-1 if want_s else 1), len(t) - 1
    out_s, out_l = space.array(total, np.int64), None if seed_lcp is None else space.array(total, np.int32)
    keys_of = lambda places: sign * t[places].astype(np.int64)

    def induced(suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which suffixes have one before them of the kind, and the key of that."""
        before = suffix - 1
        able = (suffix > 0) & (is_s[before] == want_s) & (before != end)
        return able, np.where(able, keys_of(before), FAR)

    queue = MonotoneQueue(_sample(t, len(t), keys_of, space), total, space)
    group: _Group | None = None
    done, at, cap = 0, 0, max(64, space.block // 16)
    key_at = lambda k: int(keys_of(seeds[k : k + 1])[0]) if k < len(seeds) else FAR

    def emit(suffix: np.ndarray, lcp: np.ndarray | None) -> None:
        nonlocal done
        out_s[done : done + len(suffix)] = suffix
        if out_l is not None:
            out_l[done : done + len(suffix)] = lcp
        done += len(suffix)

    def push(hit: np.ndarray, to: np.ndarray, suffix: np.ndarray, lcp: np.ndarray | None, group: _Group | None = None) -> None:
        hit = hit[_order(to[hit])]
        entries = np.empty(len(hit), _ENTRY)
        entries["key"], entries["suffix"], entries["lcp"] = to[hit], suffix[hit] - 1, -1
        if lcp is None:
            if len(hit):
                queue.push(entries)
            return
        first = np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]]) if len(hit) else np.zeros(0, bool)
        near = np.flatnonzero(~first)
        if len(near):
            entries["lcp"][near] = 1 + _range_min(lcp, hit[near - 1] + 1, hit[near])
        if group is not None:
            heads = np.flatnonzero(first)
            symbol = sign * entries["key"][heads]
            since = group.link(symbol, hit[heads], lcp)
            entries["lcp"][heads] = np.where(since < 0, -1, 1 + since)
            lasts = np.append(heads[1:], len(hit))[: len(heads)] - 1
            group.end(symbol, hit[lasts], lcp)
        if len(hit):
            queue.push(entries)

    def alone(first: int) -> None:
        """All suffixes of one first symbol: what is and comes into the queue, then seeds."""
        nonlocal at, group
        if out_l is not None:
            group = group or _Group(symbols, space)
            group.begin()
        before, seeded = -1, False
        while True:
            head = queue.head()
            if len(head) and head["key"][0] == first:
                n = min(space.block, int(np.searchsorted(head["key"], first, "right")))
                suffix, lcp, now = head["suffix"][:n].copy(), None if out_l is None else head["lcp"][:n].copy(), False
                queue.take(n)
            else:
                suffix = np.array(seeds[at : at + space.block])
                suffix = suffix[: int(np.searchsorted(keys_of(suffix), first, "right"))]
                if not len(suffix):
                    return
                lcp, now = None if seed_lcp is None else np.array(seed_lcp[at : at + len(suffix)]), True
                at += len(suffix)
            if lcp is not None:
                prior = np.concatenate([[before if before >= 0 else suffix[0]], suffix[:-1]])
                joint = lcp < 0
                joint[0] |= now and not seeded
                lcp = np.where(joint, np.minimum(run[suffix], run[prior]), lcp).astype(np.int32)
                if before < 0:
                    lcp[0] = 0
            before, seeded = int(suffix[-1]), now
            if not now:
                emit(suffix, lcp)
            able, to = induced(suffix)
            push(np.flatnonzero(able), to, suffix, lcp, group)

    while True:
        head = queue.head()
        first = min(int(head["key"][0]) if len(head) else FAR, key_at(at))
        if first == FAR:
            break
        until = queue.limit() if len(head) else FAR
        if len(head) > cap:
            until = min(until, int(head["key"][cap]))
        if at + cap < len(seeds):
            until = min(until, key_at(at + cap))
        if until <= first:
            alone(first)
            continue
        nq = int(np.searchsorted(head["key"], until, "left"))
        ahead = np.array(seeds[at : at + cap])
        keys = keys_of(ahead)
        ns = int(np.searchsorted(keys, until, "left"))
        q = head[:nq]
        key = np.concatenate([q["key"], keys[:ns]])
        order = _order(key)
        key = key[order]
        suffix = np.concatenate([q["suffix"], ahead[:ns]])[order]
        seeded = (np.arange(len(order)) >= nq)[order]
        able, to = induced(suffix)
        bad = np.flatnonzero(np.minimum.accumulate(to) <= key)
        cut = int(np.searchsorted(key, key[bad[0]], "left")) if len(bad) else len(key)
        cap = min(space.block // 2, 2 * cap) if cut == len(key) else max(64, 2 * cut)
        if cut == 0:
            alone(first)
            continue
        lcp = None
        if seed_lcp is not None:
            lcp = np.concatenate([q["lcp"], seed_lcp[at : at + ns]])[order[:cut]]
        key, suffix, seeded, to, able = (x[:cut] for x in (key, suffix, seeded, to, able))
        taken_q = int(np.count_nonzero(~seeded))
        if lcp is not None:
            same = np.concatenate([[False], key[1:] == key[:-1]])
            short = np.minimum(run[suffix], run[np.concatenate([suffix[:1], suffix[:-1]])])
            joint = same & ((lcp < 0) | (seeded & ~np.concatenate([[True], seeded[:-1]])))
            lcp = np.where(joint, short, np.where(same, lcp, 0)).astype(np.int32)
        queue.take(taken_q)
        at += cut - taken_q
        emit(suffix[~seeded], None if lcp is None else lcp[~seeded])
        push(np.flatnonzero(able), to, suffix, lcp)
    assert done == total
    if group is not None:
        space.free(group.block, group.least)
    return out_s, out_l


def _doubled(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes in memory, by ranks of prefixes of 1, 2, 4 ... symbols; the symbols are 0, 1, 2 ... without a gap."""
    n = len(t)
    ranks = [t]
    while ranks[-1].max() < n - 1:
        step = 1 << (len(ranks) - 1)
        key = ranks[-1] * (n + 1)
        key[:-step] += ranks[-1][step:] + 1
        order = _order(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        ranks.append(rank)
    sa = np.empty(n, np.int64)
    sa[ranks[-1]] = np.arange(n)
    a, b = sa[1:].copy(), sa[:-1].copy()
    lcp = np.zeros(n, np.int32)
    for k in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero(ranks[k][a] == ranks[k][b])
        for x in (a, b):
            x[same] += 1 << k
        lcp[1:][same] += 1 << k
    return sa, lcp


def _kinds(t: np.ndarray, space: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S (the end is), and the length of the run of its first symbol; from the end, in blocks."""
    n = len(t)
    is_s, run = space.array(n, bool), space.array(n, np.int32)
    is_s[n - 1], run[n - 1] = True, 1
    for b in range(n - 1, 0, -space.block):
        a = max(0, b - space.block)
        here = np.array(t[a : b + 1])
        ends = np.where(here[:-1] != here[1:], np.arange(b - a), b - a)
        last = np.minimum.accumulate(ends[::-1])[::-1]  # of the run, b - a if it goes on in the next block
        on = last == b - a
        run[a:b] = np.where(on, b - a + run[b] - np.arange(b - a), last - np.arange(b - a) + 1)
        is_s[a:b] = np.where(on, is_s[b], here[last] < here[np.minimum(last + 1, b - a)])
    return is_s, run


def _filled(total: int, dtype, parts: Iterator[np.ndarray], space: Workspace) -> np.ndarray:
    out, done = space.array(total, dtype), 0
    for p in parts:
        out[done : done + len(p)] = p
        done += len(p)
    assert done == total
    return out


def _by_symbol(t: np.ndarray, places: np.ndarray, space: Workspace) -> np.ndarray:
    """``places`` in order of their symbols, through the queue."""
    queue = MonotoneQueue(_sample(t, len(places), lambda k: t[places[k]].astype(np.int64), space), len(places), space)
    for a, b in space.blocks(len(places)):
        entries = np.empty(b - a, _ENTRY)
        entries["suffix"], entries["lcp"] = places[a:b], 0
        entries["key"] = t[entries["suffix"]]
        queue.push(entries.take(_order(entries["key"])))

    def drained() -> Iterator[np.ndarray]:
        while len(head := queue.head()):
            yield head["suffix"]
            queue.take(len(head))

    return _filled(len(places), np.int64, drained(), space)


def _both(t: np.ndarray, symbols: int, run: np.ndarray, is_s: np.ndarray, n_s: int, lms: np.ndarray, lcp: np.ndarray | None, space: Workspace):
    """L suffixes in order, then S suffixes in order (the end first), each with common prefixes, from sorted LMS suffixes.
    Without common prefixes of these there are none."""
    large, large_lcp = _induce(t, symbols, run, is_s, False, len(t) - n_s, lms, lcp, space)
    m = len(large)
    # from the largest on, a suffix has in common with the one before it what that has with it
    back = None if lcp is None else _filled(m, np.int32, (np.concatenate([[0] * (a == 0), large_lcp[m - b + 1 : m - max(a, 1) + 1][::-1]]) for a, b in space.blocks(m)), space)
    down, down_lcp = _induce(t, symbols, run, is_s, True, n_s - 1, large[::-1], back, space)
    space.free(back)
    k = n_s - 1
    up = _filled(n_s, np.int64, (np.concatenate([[len(t) - 1] * (a == 0), down[k - b + 1 : k - max(a, 1) + 1][::-1]]) for a, b in space.blocks(n_s)), space)
    up_lcp = None if lcp is None else _filled(n_s, np.int32, (np.concatenate([[0, 0][: (a == 0) * min(2, b)], down_lcp[k - b + 2 : k - max(a, 2) + 2][::-1]]) for a, b in space.blocks(n_s)), space)
    space.free(down, down_lcp)
    return large, large_lcp, up, up_lcp


def _named(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray, space: Workspace) -> tuple[np.ndarray, int]:
    """The string of the names of the strings from one LMS place to the next, which are ``ordered``; and the last name."""
    n = len(lms)
    reduced = space.array(n, np.int64)
    name, prior = -1, None
    for a, b in space.blocks(n):
        here = np.array(ordered[a:b])
        index = np.searchsorted(lms, here)
        size = np.where(index + 1 < n, lms[np.minimum(index + 1, n - 1)] - here + 1, 1)
        x = np.concatenate([here[:1] if prior is None else prior[0], here])
        sizes = np.concatenate([[0] if prior is None else prior[1], size])
        prior = here[-1:], size[-1:]
        differ = sizes[:-1] != sizes[1:]
        live, step = np.flatnonzero(~differ), 0
        while len(live):
            unequal = t[x[live] + step] != t[x[live + 1] + step]
            differ[live[unequal]] = True
            live, step = live[~unequal], step + 1
            live = live[size[live] > step]
        names = name + np.cumsum(differ)
        reduced[index], name = names, int(names[-1])
    return reduced, name


def sort_suffixes(t: np.ndarray, space: Workspace, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``t`` and common prefixes of neighbours; ``t`` ends with its only 0, its least symbol."""
    n = len(t)
    space.deepest = max(space.deepest, depth)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32)
    if depth and n <= space.base:
        return _doubled(np.array(t))
    symbols = 1 + max(int(t[a:b].max()) for a, b in space.blocks(n))
    is_s, run = _kinds(t, space)
    starts = lambda a, b: a + np.flatnonzero(is_s[a:b] & ~is_s[a - 1 : b - 1])
    n_s = n_lms = 0
    for a, b in space.blocks(n):
        n_s, n_lms = n_s + int(np.count_nonzero(is_s[a:b])), n_lms + len(starts(max(a, 1), b))
    lms = _filled(n_lms, np.int64, (starts(a, b) for a, b in space.blocks(n, 1)), space)
    if n_lms == 1:
        order, lcp = lms, np.zeros(1, np.int32)
    else:
        # names of the strings from one LMS place to the next, sorted by inducing from unsorted places
        rough = _by_symbol(t, lms, space)
        large, _, up, _ = _both(t, symbols, run, is_s, n_s, rough, None, space)
        space.free(rough, large)

        def only_lms() -> Iterator[np.ndarray]:
            for a, b in space.blocks(n_s):
                x = np.array(up[a:b])
                yield x[(x > 0) & ~is_s[x - 1]]

        ordered = _filled(n_lms, np.int64, only_lms(), space)
        space.free(up)
        reduced, last = _named(t, lms, ordered, space)
        if last == n_lms - 1:
            order = ordered
            lcp = _filled(n_lms, np.int32, (np.concatenate([[0] * (a == 0), _common(t, np.array(order[max(a, 1) : b]), np.array(order[max(a, 1) - 1 : b - 1]))]) for a, b in space.blocks(n_lms)), space)
        else:
            space.free(ordered)
            sa, shared = sort_suffixes(reduced, space, depth + 1)
            order = _filled(n_lms, np.int64, (lms[sa[a:b]] for a, b in space.blocks(n_lms)), space)

            def in_symbols() -> Iterator[np.ndarray]:
                for a, b in space.blocks(n_lms):
                    c = max(a, 1)
                    x, y = lms[sa[c:b] + shared[c:b]], lms[sa[c - 1 : b - 1] + shared[c:b]]
                    yield np.concatenate([[0] * (a == 0), x - order[c:b] + _common(t, x, y)])

            lcp = _filled(n_lms, np.int32, in_symbols(), space)
            space.free(sa, shared)
        space.free(reduced)
    large, large_lcp, up, up_lcp = _both(t, symbols, run, is_s, n_s, order, lcp, space)
    space.free(order, lcp)
    suffix, common = space.array(n, np.int64), space.array(n, np.int32)
    keys = [_filled(len(x), np.int64, (t[x[a:b]] for a, b in space.blocks(len(x))), space) for x in (large, up)]
    for own, own_lcp, key, other, side in ((large, large_lcp, keys[0], keys[1], "left"), (up, up_lcp, keys[1], keys[0], "right")):
        for a, b in space.blocks(len(own)):  # L before S of the same symbol
            place = np.arange(a, b) + np.searchsorted(other, key[a:b], side)
            suffix[place], common[place] = own[a:b], own_lcp[a:b]
    space.free(large, large_lcp, up, up_lcp, *keys)
    for a, b in space.blocks(n, 1):
        x = np.array(suffix[a - 1 : b])
        border = np.flatnonzero(is_s[x[1:]] & ~is_s[x[:-1]] & (t[x[1:]] == t[x[:-1]]))
        common[a + border] = np.minimum(run[x[border + 1]], run[x[border]])
    space.free(is_s, run)
    return suffix, common

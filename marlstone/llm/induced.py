"""External recursive induced sorting of suffixes with their common prefixes.

Suffixes are S (less than the next one) or L. The leftmost S suffix of each run of S begins a substring that ends with the
next one's first symbol. These substrings are named in their order; where names repeat, the string of names, a
third as long or less, is sorted in the same way, level by level, until all names differ. The order of the leftmost S suffixes
then induces that of all others: served in ascending order, a suffix puts the L suffix before it into the queue of that
one's first symbol; served in descending order, the S suffix before it.

The text itself is sorted with queues on disk: within a queue the order of arrival is the right one, so the priority queue is
a FIFO for each byte, served byte by byte. Its entries are tuples (place, common prefix with the entry before); a
new entry's prefix is one more than the least that was seen since the last entry of its queue. Queues hold at most
`limit` entries in memory; beyond that the longest ones go to files and come back in order. Served suffixes are needed once
more, backward or for the result: beyond `limit` they are in files too, read a chunk at a time. Prefixes beyond CAP bytes aren't told apart.
In memory stay the text with four bytes more for each of its own, and the reduced strings, which are sorted in arrays: their symbols are too many
for a queue each, so symbols are served by ranges, each as long as nothing in it induces into it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np

CAP = 56
_BIG = np.uint8(255)


class Queues:
    """A FIFO of (places, prefixes) for each symbol. save(chunk) -> load() keeps a chunk out of memory."""

    def __init__(self, save: Callable[[np.ndarray, np.ndarray], Callable[[], tuple[np.ndarray, np.ndarray]]] | None = None, limit: int = 20_000_000):
        self.save, self.limit, self.held = save, limit, 0
        self.memory: dict[int, list] = defaultdict(list)
        self.files: dict[int, list] = defaultdict(list)
        self.spilled = 0

    def push(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.memory[symbol].append((places, prefixes))
        self.held += len(places)
        if self.held > self.limit and self.save:
            worst = max(self.memory, key=lambda s: sum(len(p) for p, _ in self.memory[s]))
            chunk = [np.concatenate(x) for x in zip(*self.memory.pop(worst), strict=True)]
            self.held -= len(chunk[0])
            self.files[worst].append(self.save(*chunk))
            self.spilled += 1

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        if self.files.get(symbol):
            return self.files[symbol].pop(0)()
        if not self.memory.get(symbol):
            return None
        chunk = [np.concatenate(x) for x in zip(*self.memory.pop(symbol), strict=True)]
        self.held -= len(chunk[0])
        return chunk[0], chunk[1]


def _types(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes are S, and how long the run of one byte is that each begins with (at most 255)."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    end = np.repeat(change, np.diff(np.concatenate([[-1], change])))
    s = np.ones(n, bool)
    s[: n - 1] = t[end + 1] > t[end]
    run = np.ones(n, np.uint8)
    run[: n - 1] = np.minimum(end - np.arange(n - 1) + 1, 255)
    return s, run


def _leftmost(s: np.ndarray) -> np.ndarray:
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _refined(rank: np.ndarray, rows: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Ranks told apart further by keys (the first counts most) of rows, which hold all or none of the equal ranks."""
    order = np.lexsort([*keys[::-1], rank[rows]])
    r = rank[rows][order]
    same = np.concatenate([[False], r[1:] == r[:-1]])
    differs = np.zeros(len(r), bool)
    for k in keys:
        differs[1:] |= k[order[1:]] != k[order[:-1]]
    step = np.cumsum(same & differs)
    begin = np.flatnonzero(~same)
    within = step - np.repeat(step[begin], np.diff(np.append(begin, len(r))))
    extra = np.zeros(int(rank.max()) + 2, np.int64)
    last = np.append(begin[1:], len(r)) - 1
    extra[r[begin] + 1] = within[last]
    out = rank + np.cumsum(extra)[rank]
    out[rows[order]] += within
    return out


def _byte_names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the substrings from each place of lms to the next, in order. At its end a substring is larger than any that goes on: 255."""
    size = np.append(lms[1:], lms[-1]) - lms + 1
    longest = int(size.max())
    view = np.ndarray((len(t) + longest + 8,), ">u8", np.concatenate([t, np.zeros(longest + 15, np.uint8)]), strides=(1,))

    def word(rows: np.ndarray, k: int) -> np.ndarray:
        w, left = view[lms[rows] + 8 * k].astype(np.uint64), size[rows] - 8 * k
        short = np.flatnonzero(left < 8)
        n = np.maximum(left[short], 0).astype(np.uint64) * np.uint64(8)
        w[short] = np.where(left[short] < 0, 0, (w[short] & ~(np.uint64(2**64 - 1) >> n)) | (np.uint64(255) << (np.uint64(56) - n)))
        return w

    rank = np.unique(word(np.arange(len(lms)), 0), return_inverse=True)[1].astype(np.int64)
    rows = np.flatnonzero(size >= 8)
    return _refined(rank, rows, [word(rows, k) for k in range(1, longest // 8 + 1)]) if len(rows) else rank


def _names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """As _byte_names, of a string of numbers."""
    size = np.append(lms[1:], lms[-1]) - lms + 1
    end = int(t.max()) + 1
    rank = np.unique(t[lms], return_inverse=True)[1].astype(np.int64)
    for k in range(1, int(size.max()) + 1):
        rows = np.flatnonzero(size >= k)
        rank = _refined(rank, rows, [np.where(size[rows] > k, t[np.minimum(lms[rows] + k, len(t) - 1)], end)])
    return rank


def _ordered(t: np.ndarray, lms: np.ndarray, names: np.ndarray) -> np.ndarray:
    """lms in the order of their suffixes."""
    return lms[np.argsort(names)] if int(names.max()) + 1 == len(names) else lms[suffix_order(names)]


def suffix_order(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of numbers from 0 that ends in its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = _types(t)[0]
    lms = _leftmost(s)
    seeds = _ordered(t, lms, _names(t, lms))
    start = np.concatenate([[0], np.cumsum(np.bincount(t))])
    top = len(start) - 1
    sa = np.full(n, -1)
    c = t[seeds]
    many = np.bincount(c, minlength=top)
    sa[start[c + 1] - many[c] + np.arange(len(c)) - (np.cumsum(many) - many)[c]] = seeds

    def induce(served: np.ndarray, kind: np.ndarray, free: np.ndarray, step: int) -> None:
        before = served - 1
        before = before[(before >= 0) & kind[before]]
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(symbol) else np.zeros(0, np.int64)
        size = np.diff(np.append(cut, len(symbol)))
        nth = np.arange(len(symbol)) - np.repeat(cut, size)
        sa[free[symbol] + step * nth] = before
        free[symbol[cut]] += step * size

    def clashing(served: np.ndarray, kind: np.ndarray) -> np.ndarray:
        before = served - 1
        return t[before[(before >= 0) & kind[before]]]

    large, head, a, width = ~s, start[:-1].copy(), 0, 64
    while a < top:
        b = min(top, a + width)
        part = sa[start[a] : start[b]]
        part = part[part >= 0]
        met = clashing(part, large)
        met = met[met < b]
        first = int(met.min()) if len(met) else b
        if first > a:
            induce(part[t[part] < first] if first < b else part, large, head, 1)
            width = width * 2 if first == b else max(16, 2 * (first - a))
            a = first
            continue
        at = start[a]
        while at < head[a]:
            part, at = sa[at : head[a]], head[a]
            induce(part, large, head, 1)
        part = sa[at : start[a + 1]]
        induce(part[part >= 0], large, head, 1)
        a += 1
    sa[sa >= 0] = np.where(s[sa[sa >= 0]], -1, sa[sa >= 0])
    tail, b, width = start[1:] - 1, top, 64
    while b > 0:
        a = max(0, b - width)
        part = sa[start[a] : start[b]][::-1]
        part = part[part >= 0]
        met = clashing(part, s)
        met = met[met >= a]
        last = int(met.max()) + 1 if len(met) else a
        if last < b:
            induce(part[t[part] >= last] if last > a else part, s, tail, -1)
            width = width * 2 if last == a else max(16, 2 * (b - last))
            b = last
            continue
        at = start[b]
        while at > tail[b - 1] + 1:
            part, at = sa[tail[b - 1] + 1 : at][::-1], tail[b - 1] + 1
            induce(part, s, tail, -1)
        part = sa[start[b - 1] : at][::-1]
        induce(part[part >= 0], s, tail, -1)
        b -= 1
    sa[0] = n - 1
    return sa


def _prefixes(t: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Common prefix of each place's suffix with that of the place before, up to CAP bytes; 0 for the first."""
    view = np.ndarray((len(t) + CAP,), ">u8", np.concatenate([t, np.zeros(CAP + 8, np.uint8)]), strides=(1,))
    prefix = np.full(len(places), CAP, np.uint8)
    prefix[:1] = 0
    open_ = np.arange(1, len(places))
    for j in range(CAP // 8):
        x = (view[places[open_] + 8 * j] ^ view[places[open_ - 1] + 8 * j]).astype(np.uint64)
        k = np.flatnonzero(x)
        prefix[open_[k]] = 8 * j + sum((x[k] < np.uint64(1 << (64 - 8 * b))).astype(np.uint8) for b in range(1, 8))
        open_ = open_[x == 0]
    return prefix


class _Serving:
    """Passes served suffixes on to their queues."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, queues: Queues):
        self.t, self.wanted, self.queues = t, wanted, queues
        self.since = np.zeros(256, np.uint8)  # least prefix since the last entry of each queue

    def serve(self, places: np.ndarray, prefixes: np.ndarray) -> None:
        before = places - 1
        take = np.flatnonzero((before >= 0) & self.wanted[before])
        rest = prefixes.min()
        kept = self.since.copy()
        self.since = np.minimum(self.since, rest)
        if not len(take):
            return
        symbol = self.t[before[take]]
        order = np.argsort(symbol, kind="stable")
        take, symbol = take[order], symbol[order]
        cut = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])).tolist() + [len(take)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at, c = take[a:b], int(symbol[a])
            bounds = np.concatenate([[0], at + 1])
            if bounds[-1] == len(prefixes):
                least, after = np.minimum.reduceat(prefixes, bounds[:-1]), _BIG
            else:
                both = np.minimum.reduceat(prefixes, bounds)
                least, after = both[:-1], both[-1]
            least[0] = min(least[0], kept[c])
            self.since[c] = after
            self.queues.push(c, before[at], np.minimum(least + np.uint8(1), np.uint8(CAP)))


class _Served:
    """Chunks by symbol in the order they were served. Beyond the queues' limit they stay in files, each written once."""

    def __init__(self, queues: Queues):
        self.queues, self.held = queues, 0
        self.chunks: dict[int, list] = defaultdict(list)
        self.last: dict[int, int] = {}

    def keep(self, symbol: int, places: np.ndarray, prefixes: np.ndarray) -> None:
        self.last[symbol] = int(places[-1])
        self.held += len(places)
        if self.held > self.queues.limit and self.queues.save:
            self.held -= len(places)
            self.chunks[symbol].append([None, self.queues.save(places, prefixes)])
        else:
            self.chunks[symbol].append([(places, prefixes), None])

    def _get(self, chunk: list, again: bool) -> tuple[np.ndarray, np.ndarray]:
        if chunk[0] is not None:
            return chunk[0]
        return (getattr(chunk[1], "again", chunk[1]) if again else chunk[1])()

    def forward(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for chunk in self.chunks.get(symbol, []):
            yield self._get(chunk, again=False)

    def backward(self, symbol: int, first: int, again: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The last one first; first: the common prefix with what comes before it then."""
        for chunk in reversed(self.chunks.get(symbol, [])):
            places, prefixes = self._get(chunk, again)
            yield places[::-1], np.concatenate([np.array([first], np.uint8), prefixes[:0:-1]])
            first = prefixes[0]


def sorted_suffixes(t: np.ndarray, queues: Callable[[], Queues] = Queues) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of the suffix array of t (uint8 below 255, ending in its only 0) with common prefixes up to CAP, in ascending order."""
    n = len(t)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    s, run = _types(t)
    lms = _leftmost(s)
    lms = _ordered(t, lms, _byte_names(t, lms)).astype(np.int32 if n < 2**31 else np.int64)
    at = np.searchsorted(t[lms], np.arange(257)).tolist()
    q = queues()
    ascending = _Served(q)
    up = _Serving(t, ~s, q)
    for c in range(256):
        started = False
        while (chunk := q.pop(c)) is not None:
            if not started:
                chunk[1][0] = 0
            started = True
            up.serve(*chunk)
            ascending.keep(c, *chunk)
        if at[c] < at[c + 1]:
            places = lms[at[c] : at[c + 1]].astype(np.int64)
            prefixes = _prefixes(t, places)
            prefixes[0] = min(run[ascending.last[c]], run[places[0]], CAP) if c in ascending.last else 0
            up.serve(places, prefixes)
    del lms
    q = queues()
    descending = _Served(q)
    down = _Serving(t, s, q)
    for c in range(255, -1, -1):
        started = False
        while (chunk := q.pop(c)) is not None:
            if not started:
                chunk[1][0] = 0
            started = True
            down.serve(*chunk)
            descending.keep(c, *chunk)
        if c in ascending.last:
            first = min(run[descending.last[c]], run[ascending.last[c]], CAP) if c in descending.last else 0
            for places, prefixes in ascending.backward(c, first, again=True):
                down.serve(places, prefixes)
    yield np.array([n - 1]), np.zeros(1, np.uint8)
    for c in range(1, 256):
        yield from ascending.forward(c)
        if c in descending.last:
            yield from descending.backward(c, min(run[ascending.last[c]], run[descending.last[c]], CAP) if c in ascending.last else 0)

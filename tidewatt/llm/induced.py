"""Suffix arrays by induced sorting, worked bucket by bucket on numpy arrays.

Suffixes are L-type (greater than the next suffix) or S-type. The leftmost S-type ones
are sorted first: by one induction for their substrings, which are then named, and by
ranking the string of names where names repeat. A second induction carries that order to
all suffixes. The queue of a bucket receives suffixes in their final order, as a monotone
priority queue does, and is emptied a whole front at a time.
"""

from __future__ import annotations

import numpy as np


def _spread(queues: list[list[np.ndarray]], found: np.ndarray, symbols: np.ndarray) -> None:
    """Puts each suffix at the end of its symbol's queue, in order."""
    if not len(found):
        return
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for s, part in zip(symbols[np.append(0, cuts)], np.split(found, cuts), strict=True):
        queues[s].append(part)


def _fronts(queue: list[np.ndarray], t: np.ndarray, c: int, wanted: np.ndarray, queues: list[list[np.ndarray]]) -> np.ndarray:
    """Empties the queue of symbol c: suffixes before its own that are `wanted` join their queues, this one's at once."""
    done, front = [], np.concatenate(queue) if queue else np.empty(0, np.int64)
    while len(front):
        done.append(front)
        before = front[front > 0] - 1
        before = before[wanted[before]]
        symbols = t[before]
        same = symbols == c
        _spread(queues, before[~same], symbols[~same])
        front = before[same]
    return np.concatenate(done) if done else np.empty(0, np.int64)


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: list[np.ndarray], symbols: int) -> np.ndarray:
    """The order of all suffixes from that of the seeds, given for each symbol."""
    l_type = ~s_type
    up: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    down: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    large = []
    for c in range(symbols):
        large.append(_fronts(up[c], t, c, l_type, up))
        before = seeds[c][seeds[c] > 0] - 1
        _spread(up, before, t[before])
    out = []
    for c in range(symbols - 1, -1, -1):
        small = _fronts(down[c], t, c, s_type, down)
        if c == 0:
            small = np.array([len(t) - 1])
        back = large[c][::-1]
        before = back[back > 0] - 1
        before = before[s_type[before]]
        _spread(down, before, t[before])
        out.append(np.concatenate([large[c], small[::-1]]))
    return np.concatenate(out[::-1])


def _rank(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, whose last is its least: ranks of pairs, doubled in length each time."""
    rank, step = names, 1
    while True:
        ahead = np.zeros(len(rank), dtype=np.int64)
        ahead[:-step] = rank[step:] + 1
        key = rank * np.int64(len(rank) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, np.diff(key[order]) != 0))
        rank = np.empty_like(new)
        rank[order] = new
        step *= 2
        if new[-1] == len(rank) - 1 or step >= len(rank):
            return order


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of `text` (small non-negative integers) in the order of its suffixes; an end counts as less than anything."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = np.empty(n + 1, dtype=np.int16)
    t[:n] = text
    t[:n] += 1
    t[n] = 0
    symbols = int(t.max()) + 1
    rise = np.diff(t)
    turns = np.flatnonzero(rise)
    s_type = np.empty(n + 1, dtype=bool)
    s_type[:n] = np.repeat(rise[turns] > 0, np.diff(turns, prepend=-1))
    s_type[n] = True
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1

    def seeded(order: np.ndarray) -> list[np.ndarray]:
        queues: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        _spread(queues, order, t[order])
        return [np.concatenate(q) if q else np.empty(0, np.int64) for q in queues]

    order = _induce(t, s_type, seeded(lms), symbols)
    is_lms = np.zeros(n + 1, dtype=bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    end = np.full(n + 1, n, dtype=np.int64)  # of the substring from one leftmost S-type suffix to the next
    end[lms[:-1]] = lms[1:]
    length = end[order] - order + 1
    differs = np.append(True, length[1:] != length[:-1])
    open_, at = np.flatnonzero(~differs), 0
    while len(open_):
        a, b = order[open_] + at, order[open_ - 1] + at
        unlike = t[a] != t[b]
        differs[open_[unlike]] = True
        open_ = open_[~unlike]
        at += 1
        open_ = open_[length[open_] > at]
    name = np.empty(n + 1, dtype=np.int64)
    name[order] = np.cumsum(differs) - 1
    if not differs.all():
        order = lms[_rank(name[lms])]
    return _induce(t, s_type, seeded(order), symbols)[1:]


def common_prefix_at_least(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the bytes from a[i] and from b[i] agree over `length` bytes, a multiple of 8, which both have."""
    blocks = np.ndarray((len(data) - 7,), dtype=np.uint64, buffer=data.tobytes(), strides=(1,))
    out = np.zeros(len(a), dtype=bool)
    open_ = np.arange(len(a))
    for at in range(0, length, 8):
        open_ = open_[blocks[a[open_] + at] == blocks[b[open_] + at]]
    out[open_] = True
    return out

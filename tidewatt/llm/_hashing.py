"""64-bit hashes of bytes, words and shingles, on numpy arrays."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
SEGMENT = (1 << 18) - 1
_INVERSE = pow(BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for key, base in (("p", BASE), ("q", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.multiply.accumulate(table)
    return _powers["p"], _powers["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space) of a byte array."""
    word = np.empty(len(raw) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    np.logical_not(_IS_SPACE[raw], out=word[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(word))
    return edges[0::2], edges[1::2]


def hashed_words(data: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word of some bytes, A-Z lower-cased if `lower`; the bytes so changed; starts and ends of the words.

    Words are hashed in stretches of about SEGMENT bytes, so that little more than the bytes is held in memory."""
    raw = np.frombuffer(data, dtype=np.uint8)
    raw = _LOWER[raw] if lower else raw
    starts, ends = word_spans(raw)
    out, at = np.empty(len(starts), dtype=np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        s, e, part = starts[at:to] - starts[at], ends[at:to] - starts[at], raw[starts[at] : ends[to - 1]]
        if len(part) <= SEGMENT:
            p, q = _power_table(len(part) + 1)
            prefix = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=prefix[1:])
            sums = (prefix[e] - prefix[s]) * q[s]
        else:  # one very long word
            sums = np.array([_sum_of(part)], dtype=np.uint64)
        out[at:to] = mix(sums + (e - s).astype(np.uint64))
        at = to
    return out, raw, starts, ends


def _sum_of(word: np.ndarray) -> int:
    p, total = _power_table(SEGMENT)[0], 0
    for at in range(0, len(word), SEGMENT):
        part = word[at : at + SEGMENT].astype(np.uint64) + np.uint64(1)
        total += int((part * p[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each run words[start:end] of word hashes; another for each seed."""
    words = mix(words ^ np.uint64(seed)) if seed else words
    p, q = _power_table(len(words) + 1)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * p[: len(words)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of `text`, A-Z lower-cased."""
    return hashed_words((text or "").encode("utf-8", "surrogatepass"))[0]


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; the whole sequence as one where there are fewer words."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + w[i : len(w) - k + 1 + i]
    return np.unique(mix(out))

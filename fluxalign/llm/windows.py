"""Super-windows: the shared first step of the two exact substring operators.

Both substring dedup (words) and suffix-array dedup (bytes) ask which windows of W symbols
occur more than once in the corpus. Sending every window through a shuffle would move the
corpus many times over, so windows are grouped first: the minimizer of a window is the least
hash of its k-grams, the leftmost where several are equal, and consecutive windows with the
minimizer at the same place form one *run*. Equal windows have equal minimizers, hence all
places of a window meet under one key, while a run costs one small row for about (W-k+2)/2
windows. No window is twice in a run: its minimizer would stand at two distances from its start.

Everything here is numpy on the symbols of a few documents at a time; memory is bounded by
CHUNK symbols (or the longest single document).
"""

from __future__ import annotations

import numpy as np

#: Symbols handled at once; one longer document forms its own chunk.
CHUNK = 1 << 20
#: Multiplier of the rolling hashes; odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Low bits that hold a k-gram's place while minima are sought; the high ones order k-grams.
PLACE = np.uint64((1 << 28) - 1)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits, so that the order of hashes is unrelated to the text."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(sym: np.ndarray, m: int) -> np.ndarray:
    """Polynomial hash of every m symbols, by doubling: O(len * log m) vector work."""
    out, size, have, done = None, 1, sym, 0
    while True:
        if m & size:
            if out is None:
                out, done = have, size
            else:  # the part already joined stands left of the next power of two
                n = len(sym) - done - size + 1
                out = out[:n] * BASE ** np.uint64(size) + have[done : done + n]
                done += size
        if size * 2 > m:
            return out
        n = len(have) - size
        have = have[:n] * BASE ** np.uint64(size) + have[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def chunks(sizes: list[int]):
    """Ranges of consecutive documents with about CHUNK symbols together."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def window_runs(sym: np.ndarray, lens: np.ndarray, w: int, k: int, longest: int, hot: np.ndarray | None = None):
    """Runs of windows of several documents laid end to end.

    Returns (document index, start in document, windows, key, content hash), one entry a run.
    A run has at most ``longest`` windows. Runs whose key is in ``hot`` (sorted) are cut into
    single windows under a key of their whole content.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(sym) < w:
        return none
    ends = np.cumsum(lens)
    begin = np.arange(len(sym) - w + 1)
    ok = np.repeat(ends, lens)[: len(begin)] >= begin + w
    at = begin[ok]
    if not len(at):
        return none
    gram = mix(rolling(sym, k))
    place = np.arange(len(gram), dtype=np.uint64)
    least = sliding_min((gram & ~PLACE) | place, w - k + 1)[at] & PLACE
    key = gram[least.astype(np.int64)]
    whole = mix(rolling(sym, w))[at]
    single = np.zeros(len(at), bool) if hot is None or not len(hot) else hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    key = np.where(single, mix(whole + np.uint64(77)), key)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1]) | single[1:]
    first = np.flatnonzero(fresh)
    off = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    fresh |= off % longest == 0
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(at)))
    off = off % longest
    content = mix(np.add.reduceat(whole * powers(longest)[off], first) + n.astype(np.uint64))
    doc = np.searchsorted(ends, at[first], side="right")
    return doc, at[first] - (ends - lens)[doc], n, key[first], content


def covered(starts: np.ndarray, w: int, size: int) -> np.ndarray:
    """Which of ``size`` symbols lie in a window that starts at one of ``starts``."""
    step = np.zeros(size + 1, np.int64)
    starts = starts[(starts >= 0) & (starts < size)]
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + w, size), -1)
    return np.cumsum(step[:size]) > 0

"""Window hashes of whole batches of texts, and the choice among them that no long common span escapes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters of a hashed window, and the span that two texts must share to be found.
GRAM, SPAN = 64, 200


def longest_period(gram: int) -> int:
    """A gram that repeats itself within this distance lies in a periodic run."""
    return gram // 2


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _char_noise() -> np.ndarray:
    return np.random.default_rng(977).integers(1, 2**63, 0x110000, dtype=np.uint64)


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def gram_hashes(cp: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` characters, by its first; empty where there are fewer."""
    n = len(cp)
    if n < size:
        return np.zeros(0, np.uint64)
    room = 1 << max(20, int(n).bit_length())
    up, down = _powers(_BASE, room), _powers(_INVERSE, room)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_char_noise()[cp] * up[:n], dtype=np.uint64)])
    return mix((total[size:] - total[: n - size + 1]) * down[: n - size + 1])


def _window_min(a: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(a)
    pad = -n % w
    blocks = np.concatenate([a, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _periodic(cp: np.ndarray, h: np.ndarray, at: np.ndarray, first: np.ndarray, end: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits chosen places into those outside periodic runs and, for each such run, the first and last grams of one period."""
    period = np.zeros(len(at), np.int64)
    for p in range(1, longest_period(gram) + 1):
        ahead = (at + p + gram <= end) & (h[np.minimum(at + p, len(h) - 1)] == h[at])
        behind = (at - p >= first) & (h[np.maximum(at - p, 0)] == h[at])
        period[(period == 0) & (ahead | behind)] = p
    odd = np.flatnonzero(period)
    if not len(odd):
        return at, np.zeros(0, np.int64)
    more, done = [], {}
    for i in odd.tolist():
        x, p, a, b = int(at[i]), int(period[i]), int(first[i]), int(end[i])
        if done.get((p, a), -1) >= x:
            continue
        left, right = x, x + gram
        step = 256
        while left > a:  # how far the period reaches to either side
            lo = max(a, left - step)
            same = cp[lo:left] == cp[lo + p : left + p]
            bad = np.flatnonzero(~same)
            left = lo if not len(bad) else lo + int(bad[-1]) + 1
            if len(bad):
                break
        while right < b:
            hi = min(b, right + step)
            bad = np.flatnonzero(cp[right:hi] != cp[right - p : hi - p])
            right = hi if not len(bad) else right + int(bad[0])
            if len(bad):
                break
        done[p, a] = right - gram
        more += [*range(left, min(left + p, right - gram + 1)), *range(max(left, right - gram - p + 1), right - gram + 1)]
    return at[period == 0], np.array(more, np.int64)


def periodic_runs(cp: np.ndarray, places: list[int], gram: int) -> list[tuple[int, int]]:
    """First and last gram of each periodic run that holds one of ``places``; ``choose`` takes only those at its ends."""
    out: list[tuple[int, int]] = []
    for x in places:
        if out and out[-1][0] <= x <= out[-1][1]:
            continue
        for p in range(1, longest_period(gram) + 1):
            if p < gram and (cp[x + p : x + gram] == cp[x : x + gram - p]).all():
                off = np.flatnonzero(cp[p:] != cp[:-p])  # i: character i + p breaks the period
                k = int(np.searchsorted(off, x))
                left = int(off[k - 1]) + 1 if k else 0
                right = int(off[k]) + p if k < len(off) else len(cp)
                out.append((left, right - gram))
                break
    return out


def side_hashes(cp: np.ndarray, lengths: np.ndarray, owner: np.ndarray, place: np.ndarray, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of grams of texts that lie one behind the other: the hash of each with half of what it lacks to a span on its left, the same on its right, and where there are so many characters.

    A span that two texts share reaches that far to one side at least of every gram in it, so grams that neither hash meets elsewhere lie in none.
    """
    half = (span - gram + 1) // 2
    begin = (np.cumsum(lengths) - lengths)[owner]
    at = begin + place
    h = gram_hashes(cp, gram + half)
    left, right = place >= half, place + gram + half <= lengths[owner]
    none = np.zeros(len(at), np.uint64)
    if not len(h):
        return none, none, np.zeros(len(at), bool), np.zeros(len(at), bool)
    last = len(h) - 1
    return h[np.clip(at - half, 0, last)], h[np.clip(at, 0, last)], left, right


def choose(cp: np.ndarray, lengths: np.ndarray, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one behind the other in ``cp``: the text, the place in it and the hash of each chosen gram.

    The least hash of every span - gram + 1 neighbours is chosen, so any ``span`` characters that two texts share hold a gram chosen in both at the
    same place of the span.  In a periodic run, where that would choose everywhere, the grams at its ends stand for all.
    """
    w = span - gram + 1
    ends = np.cumsum(lengths)
    begins = ends - lengths
    h = gram_hashes(cp, gram)
    none = np.zeros(0, np.int64)
    if len(h) < w:
        return none, none, np.zeros(0, np.uint64)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    least = _window_min(key, w)
    start = np.arange(len(least))
    owner = np.searchsorted(ends, start, "right")
    good = start + span <= ends[owner]
    start, least = start[good], least[good]
    if not len(start):
        return none, none, np.zeros(0, np.uint64)
    at = start + (((least & low).astype(np.int64) - start) & ((1 << 24) - 1))
    at = np.unique(at)
    owner = np.searchsorted(ends, at, "right")
    plain, ends_of_runs = _periodic(cp, h, at, begins[owner], ends[owner], gram)
    at = np.unique(np.concatenate([plain, ends_of_runs]))
    owner = np.searchsorted(ends, at, "right")
    return owner, at - begins[owner], h[at]

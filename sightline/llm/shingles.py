"""Word shingles as sorted arrays of 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; numpy wraps as wanted."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(([_U(1)], np.full(max(n - 1, 0), base, _U))))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start byte) of each run of bytes that are neither a space nor 9 to 13."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    if not word.any():
        return np.zeros(0, _U), np.zeros(0, np.int64)
    edge = np.diff(word.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    ends = np.append(ends, len(raw)) if len(ends) < len(starts) else ends
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(length.sum()) - np.repeat(first, length)
    summed = np.add.reduceat((raw[word].astype(_U) + _U(1)) * powers(_BASE, int(length.max()))[place], first)
    return mix(summed + mix(length.astype(_U))), starts


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Per text its set of shingles of `words` words, A-Z lower-cased; fewer words count as one shingle; none: empty."""
    raws = [(t or "").encode().lower() for t in texts]
    sizes = np.array([len(r) + 1 for r in raws])
    hashes, starts = word_hashes(np.frombuffer(b" ".join(raws) + b" ", np.uint8))
    bounds = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))
    n = len(hashes)
    whole = np.zeros(max(n - words + 1, 0), _U)
    for k in range(words):
        whole = whole * _U(_STEP) + hashes[k:k + len(whole)]
    whole, out = mix(whole), []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a:b - words + 1]))
        elif b > a:
            h = _U(b - a)
            with np.errstate(over="ignore"):
                for x in hashes[a:b]:
                    h = h * _U(_STEP) + x
            out.append(mix(np.array([h])))
        else:
            out.append(np.zeros(0, _U))
    return out

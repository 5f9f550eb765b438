"""Words of many texts as hashes, in numpy: letters and digits in lower case, everything else between words."""

from __future__ import annotations

import numpy as np

_random = np.random.Generator(np.random.PCG64(29))
_VALUE = _random.integers(0, 1 << 64, 256, np.uint64)
_WORD = np.zeros(256, bool)
_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
_WORD[128:] = True
_POWER = np.full(256, 0xD1342543DE82EF95, np.uint64)
_POWER[0] = 1
np.multiply.accumulate(_POWER, out=_POWER)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


#: Bytes hashed at once; longer texts are taken slice by slice, between words.
SLICE = 1 << 22


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of some bytes."""
    edge = np.diff(_WORD[data].astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.empty(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(np.append(0, start), np.diff(np.concatenate([[0], start, [len(data)]])))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _POWER[place & 255], out=sums[1:])
    return start, mixed(sums[end] - sums[start])


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts in order, and the number of words of each text."""
    raw = [(t or "").lower().encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data):
        stop = min(at + SLICE, len(data))
        while stop < len(data) and _WORD[data[stop - 1]]:  # a slice ends after a byte between words
            stop += 1
        start, code = _hashed(data[at:stop])
        starts.append(start + at)
        hashes.append(code)
        at = stop
    start = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64), np.diff(np.searchsorted(start, bounds))

"""What the lines of texts look like, in numpy: counts by kind of byte and repeated words."""

from __future__ import annotations

import numpy as np

NAMES = [
    "bias", "size", "words", "word_size", "upper", "digits", "marks", "symbols", "bars", "high", "same_word",
    "same_pair", "same_four", "new_words", "empty",
]

_KIND = np.full(256, 6, np.int64)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[list(b" \t\r\n\x0b\x0c")] = 3
_KIND[list(b".,;:!?'\"()-")] = 4
_KIND[list(b"|")] = 5
_KIND[128:] = 7
_random = np.random.Generator(np.random.PCG64(7))
_VALUE = _random.integers(0, 1 << 64, 256, np.uint64)
_POWER = np.full(64, 0x9E3779B97F4A7C15, np.uint64)
_POWER[0] = 1
np.multiply.accumulate(_POWER, out=_POWER)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word; words are stretches without ASCII white space."""
    inside = _KIND[data] != 3
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    # the place in its word, modulo the table, weighs each byte
    offset = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))[: len(data)] if start[0] == 0 else None
    if offset is None:
        offset = np.arange(len(data))
        offset[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
    np.cumsum(_VALUE[data] * _POWER[offset & 63], out=sums[1:])
    return start, end, sums[end] - sums[start]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, each line's size in bytes, and the number of lines of each text.

    Lines end at line feeds; null and empty texts have one empty line.
    """
    raw = [(t or "").encode() for t in texts]
    counts = np.array([t.count(b"\n") + 1 for t in raw])
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    n = int(counts.sum())
    breaks = np.flatnonzero(data == 10)
    line = np.zeros(len(data), np.int64)
    line[breaks] = 1
    line = np.cumsum(line) - line
    kinds = np.bincount(line * 8 + _KIND[data], minlength=8 * n).reshape(n, 8).astype(float)
    size = np.diff(np.concatenate([[-1], breaks, [len(data)]])) - 1.0
    start, end, code = words_of(data)
    of = line[start] if len(start) else np.empty(0, np.int64)
    words = np.bincount(of, minlength=n).astype(float)
    doc = np.repeat(np.arange(len(texts)), counts)

    def share(flag: np.ndarray) -> np.ndarray:
        return np.bincount(of, flag, n) / np.maximum(words, 1)

    def back(k: int) -> np.ndarray:
        same = np.zeros(len(code))
        if len(code) > k:
            same[k:] = (code[k:] == code[:-k]) & (doc[of[k:]] == doc[of[:-k]])
        return share(same)

    first = np.ones(len(code))
    if len(code):
        key = code ^ (doc[of].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first[:] = 0
        first[np.unique(key, return_index=True)[1]] = 1
    full = np.maximum(size, 1)
    again = np.zeros(len(code))
    if len(code) > 4:
        key = doc[of].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        four = key[:-3] + code[:-3] + code[1:-2] * _POWER[1] + code[2:-1] * _POWER[2] + code[3:] * _POWER[3]
        again[:-3] = 1
        again[np.unique(four, return_index=True)[1]] = 0
    table = np.column_stack(
        [
            np.ones(n), np.log1p(size), np.log1p(words), size / np.maximum(words, 1) / 10, kinds[:, 1] / full,
            kinds[:, 2] / full, kinds[:, 4] / full, kinds[:, 6] / full, kinds[:, 5] / full, kinds[:, 7] / full,
            back(1), back(2), share(again), share(first), size == 0,
        ]
    )
    return table, size, counts

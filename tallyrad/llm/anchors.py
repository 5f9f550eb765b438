"""Places that equal strings of bytes pick alike: window minimisers and rolling hashes in numpy.

Every string of LENGTH bytes contains WIDTH grams of GRAM bytes. The gram with the smallest hash, leftmost
among equals, is the string's anchor. Which one that is depends on the string alone, so equal strings anywhere
have the same anchor at the same offset. Neighbouring strings mostly share theirs: a text has about one anchor
for every 85 bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LENGTH = 200
GRAM = 32
WIDTH = LENGTH - GRAM + 1

#: Bytes handled at once. Longer documents are cut into parts that overlap by LENGTH - 1 bytes.
PART = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)

_random = np.random.Generator(np.random.PCG64(20_240_601))
_VALUE = _random.integers(0, 1 << 64, 256, np.uint64)
#: Two digests of 64 bits, each with values of bytes and a base of its own; together they name a content.
_VALUES = [_VALUE, _random.integers(0, 1 << 64, 256, np.uint64)]
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
_powers: list[list[np.ndarray]] = []


def _power_tables(which: int = 0) -> list[np.ndarray]:
    """Powers of a digest's base and of its inverse modulo 2**64."""
    if not _powers:
        size = PART + LENGTH + 1
        for odd in _BASES:
            _powers.append([])
            for base in (odd, pow(odd, -1, 1 << 64)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                np.multiply.accumulate(table, out=table)
                _powers[-1].append(table)
    return _powers[which]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Rolling:
    """Hashes of any stretch of one part of bytes, each in constant time."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _power_tables(which)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = _VALUES[which][data]
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        found = self.sums[size:] - self.sums[:-size]
        found *= self.down[: len(found)]
        return mixed(found)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass
class Anchors:
    """Parallel arrays. The strings that start at first..last of a row share the anchor at place. whole and
    again are two digests of their bytes and of where these lie around the anchor."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    whole: np.ndarray
    again: np.ndarray

    @staticmethod
    def join(parts: list[Anchors]) -> Anchors:
        names = ("row", "first", "last", "place", "gram", "whole", "again")
        kinds = (np.int64,) * 4 + (np.uint64,) * 3
        return Anchors(
            *[np.concatenate([getattr(p, n) for p in parts]) if parts else np.empty(0, k) for n, k in zip(names, kinds)]
        )


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of `width` values, from running minima of blocks in both directions."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def parts(texts: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Texts packed into parts: the bytes, and for each piece its row, offset in the row, start and end in
    the part. Texts shorter than LENGTH have no string and are left out."""
    found, pieces, held, size = [], [], [], 0

    def close():
        nonlocal pieces, held, size
        if held:
            found.append((np.frombuffer(b"".join(held), np.uint8), pieces))
        pieces, held, size = [], [], 0

    for row, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - LENGTH + 1), PART - LENGTH + 1):
            piece = text[offset : offset + PART]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > PART:
                close()
            pieces.append((row, offset, size, size + len(piece)))
            held.append(piece)
            size += len(piece)
    close()
    return found


def anchors_of(data: np.ndarray, pieces: list[tuple[int, int, int, int]]) -> Anchors:
    """Anchors of one part, with first, last and place counted in the row."""
    rolling = Rolling(data)
    grams = rolling.every(GRAM)
    # 40 bits of the hash, then the place: the least of these is the leftmost of the smallest
    keyed = grams & ~_PLACE
    keyed |= np.arange(len(grams), dtype=np.uint64)
    minima = (window_minima(keyed, WIDTH) & _PLACE).astype(np.int64)
    change = np.empty(len(minima), bool)
    change[0] = True
    np.not_equal(minima[1:], minima[:-1], out=change[1:])
    row, offset, start, end = np.array(pieces, np.int64).T
    stop = end - LENGTH + 1  # strings start before this place
    change[start] = True
    firsts = np.flatnonzero(change)
    of = np.searchsorted(start, firsts, "right") - 1
    lasts = np.minimum(np.append(firsts[1:], len(minima)) - 1, stop[of] - 1)
    good = firsts < stop[of]
    firsts, lasts, of = firsts[good], lasts[good], of[good]
    place = minima[firsts]
    shape = ((place - firsts) << 32 | (lasts - firsts)).astype(np.uint64)
    whole = mixed(rolling.at(firsts, lasts + LENGTH) ^ mixed(shape))
    gram = grams[place]
    del rolling, grams, keyed, minima, change
    again = mixed(Rolling(data, 1).at(firsts, lasts + LENGTH) ^ mixed(~shape))
    shift = start[of] - offset[of]
    return Anchors(row[of], firsts - shift, lasts - shift, place - shift, gram, whole, again)


def find(texts: list[bytes]) -> Anchors:
    return Anchors.join([anchors_of(data, pieces) for data, pieces in parts(texts)])

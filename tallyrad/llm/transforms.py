"""Merging of shard transforms by interleave refinement, for the suffixes that anchors leave undecided.

A shard's transform is the list of its undecided suffixes that begin at anchors, each with the bytes that stand
before it; as in a Burrows-Wheeler transform, what precedes a suffix leads from it to the suffixes that start
earlier. The rows of all shards begin as one interleave whose blocks hold one gram each. Every round splits the
blocks by the next word of the suffixes and leaves alone the rows whose block has become their own, so no
suffix is sorted anew from its start. The round that parts two neighbours gives the length of their common
prefix. The class of a suffix at any depth is then a stretch of the order without a shorter common prefix, and a
step back over d bytes splits these classes by what precedes them: strings of 200 bytes that begin d bytes
before the anchor are equal if both their classes are.
"""

from __future__ import annotations

import numpy as np

from .anchors import GRAM, LENGTH

#: A string starts at most so many bytes before its anchor.
BEFORE = LENGTH - GRAM
WORD = 8


def laid_out(contexts: list[bytes], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from the anchor on (rows, LENGTH) and bytes before it, nearest first (rows, BEFORE); zeros beyond
    the ends of a context. before: how many bytes of each context precede its anchor."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    table = np.zeros((len(contexts), BEFORE + LENGTH), np.uint8)
    at = np.repeat(np.arange(len(contexts)) * table.shape[1] + BEFORE - before - (np.cumsum(sizes) - sizes), sizes)
    table.ravel()[at + np.arange(sizes.sum())] = np.frombuffer(b"".join(contexts), np.uint8)
    return table[:, BEFORE:], table[:, :BEFORE][:, ::-1]


def interleaved(block: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of rows, and the length of each one's common prefix with the row before it (-1 where
    the block of the beginning changes). block: where each row begins; symbols: (rows, bytes), full words."""
    words = np.ascontiguousarray(symbols).view(">u8").astype(np.uint64)
    order = np.argsort(block, kind="stable")
    common = np.full(len(order), symbols.shape[1], np.int64)
    fresh = np.ones(len(order), bool)
    fresh[1:] = block[order[1:]] != block[order[:-1]]
    common[fresh] = -1
    for k in range(words.shape[1]):
        open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
        if not len(open_):
            break
        rows, own = order[open_], np.cumsum(fresh)[open_]
        word = words[rows, k]
        refined = np.lexsort((word, own))
        order[open_], word = rows[refined], word[refined]
        parted = np.flatnonzero((own[1:] == own[:-1]) & (word[1:] != word[:-1])) + 1
        differ = word[parted] ^ word[parted - 1]
        shared = np.zeros(len(parted), np.int64)
        for n in range(1, WORD):
            shared += differ < np.uint64(1 << 8 * (WORD - n))
        fresh[open_[parted]] = True
        common[open_[parted]] = WORD * k + shared
    return order, common


def repeated_strings(block: np.ndarray, contexts: list[bytes], low: np.ndarray, high: np.ndarray, place: np.ndarray):
    """Stretches (row, low, high) of places where strings start that another row of the block has as well.

    Each row's strings start at low..high of its own text and hold the gram at place, which is in all strings
    of a block; its context is text[low : high + LENGTH]. Rows of a block are never the same string of one
    text. Bytes decide; that the grams of a block are equal isn't presumed.
    """
    n = len(contexts)
    ahead, behind = laid_out(contexts, place - low)
    (order, common), (back, before) = interleaved(block, ahead), interleaved(block, behind)
    at, at_back = np.empty(n, np.int64), np.empty(n, np.int64)
    at[order], at_back[back] = np.arange(n), np.arange(n)
    nearest, farthest = place - high, place - low
    found = np.zeros((n, BEFORE + 3), bool)  # a column of False on either side
    for d in range(int(nearest.min(initial=0)), int(farthest.max(initial=-1)) + 1):
        rows = np.flatnonzero((nearest <= d) & (d <= farthest))
        if len(rows) < 2:
            continue
        right = np.cumsum(common < LENGTH - d)[at[rows]]
        left = np.cumsum(before < d)[at_back[rows]]
        key = right * (n + 1) + left
        by = np.argsort(key)
        same = key[by[1:]] == key[by[:-1]]
        found[rows[by[1:][same]], d + 1] = True
        found[rows[by[:-1][same]], d + 1] = True
    edge = found[:, 1:].astype(np.int8) - found[:, :-1]
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    return row, place[row] - end + 1, place[row] - start

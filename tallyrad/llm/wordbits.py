"""Words of a text as bits, foretold by hashed contexts that cross words and mixed online along the text.

Frequent words, and one mark for all others, are the leaves of a binary tree: Huffman's, of the words that are most at
home in one domain, and then of the domains. A word is so a few bits, each at a node of the tree. Every predictor
hashes a node with what came before it in the text (the homes of the two words before; the word before; both words
before) into a slot, which holds how often 0 and 1 came there. Their predictions, as log odds, are added up by a mixer
whose weights a gate chooses, by how much the long contexts have seen.

Weights are learnt online along the texts to learn from, bit by bit in steps, each occurrence judged by what the others
say. Every text then begins with these weights and goes on learning: what a step of it cost moves its own weights for
the steps that follow, so a bit is foretold by all that came before it in its text and by nothing that comes after.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTORS = 3
#: The two predictors that a gate asks how much they have seen: by the word before, and by both.
LONG = (1, 2)
#: Weight sets of the mixer, one for each class of what the two long contexts have seen.
GATES = 64
FIRST_WEIGHT = 0.4
#: Words of texts that are coded at once, and bits that the learnt weights move after.
TOKENS, PIECE, STEP = 25_000, 8192, 1 << 14
#: The size of steps when weights are learnt and when it halves; the same within a text, and what each weight set is
#: taken to have seen before the text began.
PACE, HALVED = 0.4, 50
OWN_PACE, HELD = 0.3, 30.0
#: A text's first steps have so many words; later ones an eighth of what came before, up to the last number.
FIRST_STEP, LAST_STEP = 8, 4096
#: Words in one task that fills slots.
FILLED = 1 << 24

_random = np.random.Generator(np.random.PCG64(17))
_ODD = (_random.integers(1, 1 << 32, 8, np.uint32) | 1).astype(np.uint32)
_OWN = _random.integers(1, 1 << 32, PREDICTORS, np.uint32)
_SPREAD = np.uint32(0x9E3779B1)


class Code:
    """The bits of each symbol: symbol s has `size[s]` of them from `first[s]` on in `steps`, each a node's number and
    the bit."""

    def __init__(self, counts: np.ndarray, homes: np.ndarray):
        n = len(counts)
        parent, side, own = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), n

        def joined(heap: list[tuple[int, int]]) -> tuple[int, int]:
            nonlocal own
            heapq.heapify(heap)
            while len(heap) > 1:
                (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
                parent[x] = parent[y] = own
                side[y] = 1
                heapq.heappush(heap, (a + b, own))
                own += 1
            return heap[0]

        of = lambda home: [(int(counts[s]), int(s)) for s in np.flatnonzero(homes == home)]
        _, root = joined([joined(of(home)) for home in np.unique(homes)])
        at, leaf, found = np.arange(n), np.arange(n), []
        while (up := at != root).any():
            at, leaf = at[up], leaf[up]
            found.append((leaf, parent[at], side[at]))
            at = parent[at]
        leaf, node, bit = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        order = np.argsort(leaf, kind="stable")
        self.homes = homes.astype(np.uint32)
        self.size = np.bincount(leaf, minlength=n)
        self.first = np.cumsum(self.size) - self.size
        self.steps = (node[order] - n << 1 | bit[order]).astype(np.uint32)

    @property
    def node(self) -> np.ndarray:
        return (self.steps >> np.uint32(1)) * _ODD[0]

    @property
    def bit(self) -> np.ndarray:
        return (self.steps & np.uint32(1)).astype(np.uint8)


def contexts(code: Code, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The hash of each predictor's context before every word. at: symbols of some texts; sizes: how many each has."""
    start, mark = np.cumsum(sizes) - sizes, np.uint32(len(code.size))
    place = np.arange(len(at)) - np.repeat(start, sizes)

    def back(values: np.ndarray, n: int, none: np.uint32) -> np.ndarray:
        moved = np.full(len(at), none, np.uint32)
        moved[n:] = values[: max(0, len(at) - n)]
        moved[place < n] = none
        return moved

    home = code.homes[at] + np.uint32(1)
    one, two = back(at.astype(np.uint32), 1, mark), back(at.astype(np.uint32), 2, mark)
    homes = back(home, 1, np.uint32(0)) * _ODD[1] + back(home, 2, np.uint32(0)) * _ODD[2]
    plain = [homes, one * _ODD[3], one * _ODD[4] + two * _ODD[5]]
    return [(x ^ (x >> np.uint32(15))) * _SPREAD + own for x, own in zip(plain, _OWN)]


class Bits:
    """Bits of some words: the word's number, the bit, and slots. hashes: the words' contexts."""

    def __init__(self, code: Code, at: np.ndarray, hashes: list[np.ndarray], slot_bits: int):
        size = code.size[at]
        self.word = np.repeat(np.arange(len(at)), size)
        step = code.steps.take(np.arange(len(self.word)) + np.repeat(code.first[at] - (np.cumsum(size) - size), size))
        self.bit, node = (step & np.uint32(1)).astype(np.uint8), (step >> np.uint32(1)) * _ODD[0]
        self.slots = []
        for x in hashes:
            x = np.repeat(x, size)
            x ^= node
            x *= _SPREAD
            x ^= x >> np.uint32(13)
            x *= _SPREAD
            x >>= np.uint32(32 - slot_bits)
            self.slots.append(x.astype(np.intp))


class Given:
    """The predictors' log odds of the bits that came, and the weight set that the gate chooses."""

    def __init__(self, code: Code, at: np.ndarray, hashes: list[np.ndarray], tables: np.ndarray, by: np.ndarray, seen: np.ndarray):
        bits = Bits(code, at, hashes, int(tables.shape[1]).bit_length() - 1)
        self.word, came = bits.word, bits.bit.astype(np.intp) << 16
        states = [t.take(s, mode="clip") for t, s in zip(tables, bits.slots)]
        self.odds = np.empty((PREDICTORS, len(came)), np.float32)
        for p, state in enumerate(states):
            by.take(came | state, out=self.odds[p], mode="clip")
        self.gate = seen.take(states[LONG[0]]).astype(np.intp) << 3 | seen.take(states[LONG[1]])


def first_weights() -> np.ndarray:
    return np.full((PREDICTORS, GATES), FIRST_WEIGHT, np.float32)


def _log_odds(weights: np.ndarray, at: np.ndarray, odds: np.ndarray) -> np.ndarray:
    z = weights[0].take(at, mode="clip") * odds[0]
    for w, x in zip(weights[1:], odds[1:]):
        z += w.take(at, mode="clip") * x
    return z


def learn_online(given: Given, weights: np.ndarray, step: int) -> int:
    """Moves the weights along the bits of some texts, whose slots had counted them; returns the next step's number."""
    for a in range(0, given.odds.shape[1], STEP):
        odds, at, pace = given.odds[:, a : a + STEP], given.gate[a : a + STEP], PACE / (1 + step / HALVED)
        wrong = 1 / (1 + np.exp(np.minimum(_log_odds(weights, at, odds), 80)))
        slope = wrong * (1 - wrong)
        for w, x in zip(weights, odds):
            up, down = np.bincount(at, wrong * x, GATES), np.bincount(at, slope * x * x, GATES)
            w += np.clip(pace * up / (down + 5), -0.2, 0.2).astype(np.float32)
        step += 1
    return step


def steps_of(place: np.ndarray) -> np.ndarray:
    """The step of its text that each word belongs to, by its place there."""
    ends, n, most = [], 0, int(place.max(initial=0))
    while n <= most:
        n += min(LAST_STEP, max(FIRST_STEP, n // 8))
        ends.append(n)
    return np.searchsorted(np.array(ends), place, "right")


def refined(code: Code, at: np.ndarray, sizes: np.ndarray, tables: np.ndarray, by: np.ndarray, seen: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Natural logarithm of each text's probability. Each text begins with the learnt weights; a step of it is judged by
    the weights as they are before it, and moves them."""
    n, hashes = len(sizes), contexts(code, at, sizes)
    text = np.repeat(np.arange(n), sizes)
    step = steps_of(np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    order = np.argsort(step, kind="stable")
    at, text, step, hashes = at[order], text[order], step[order], [x[order] for x in hashes]
    total, now, held = np.zeros(n), np.tile(weights, n), np.full(n * GATES, HELD)
    ends = np.cumsum(np.bincount(step))
    start = 0
    while start < len(at):  # whole steps of about TOKENS words
        stop = int(ends[np.searchsorted(ends, min(start + TOKENS, len(at)))])
        part = slice(start, stop)
        given = Given(code, at[part], [x[part] for x in hashes], tables, by, seen)
        own, of = text[part][given.word], step[part][given.word] - step[start]
        bounds = np.append(0, np.cumsum(np.bincount(of)))
        places = own * GATES + given.gate
        for a, b in zip(bounds, bounds[1:]):
            place, odds = places[a:b], given.odds[:, a:b]
            wrong = np.exp(-np.clip(_log_odds(now, place, odds), -80, 80))
            every = 1 + wrong
            total -= np.bincount(own[a:b], np.log(every), n)
            wrong /= every
            _move(now, held, place, odds, wrong)
        start = stop
    return total


def _move(weights: np.ndarray, held: np.ndarray, place: np.ndarray, odds: np.ndarray, wrong: np.ndarray) -> None:
    """Moves the texts' own weight sets by what a step of them cost; those that it didn't meet stay."""
    n = len(held)
    slope = np.bincount(place, wrong * (1 - wrong), n)
    met = np.flatnonzero(slope)
    held[met] += 4 * slope[met]
    for w, x in zip(weights, odds):
        w[met] += np.clip(OWN_PACE * np.bincount(place, wrong * x, n)[met] / held[met], -0.2, 0.2).astype(np.float32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows without their symbols, these and their numbers, of texts with about TOKENS words together, like lengths
    together."""
    for batch in batches:
        symbols = [np.frombuffer(x, "<i4") for x in batch.column("symbols").to_pylist()]
        sizes = np.array([len(x) for x in symbols], np.int64)
        others = batch.select([c for c in batch.schema.names if c != "symbols"])
        order = np.argsort(sizes, kind="stable")
        group = np.cumsum(sizes[order]) // TOKENS
        for own in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else ():
            yield others.take(pa.array(own)), np.concatenate([symbols[k] for k in own]), sizes[own]


def _pieces(code: Code, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Symbols and the hashes of their contexts, PIECE at most."""
    for _, at, sizes in _texts(batches):
        hashes = contexts(code, at, sizes)
        for a in range(0, len(at), PIECE):
            yield at[a : a + PIECE], [x[a : a + PIECE] for x in hashes]


def fill(texts: DataFrame, shared, tokens: int, slot_bits: int, blocks, joined) -> np.ndarray:
    """The predictors' slots from the texts to learn from. shared: the code's broadcast; tokens: how many these have;
    blocks, joined: how a task hands its slots on, and how these become tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PREDICTORS, 2 << slot_bits), np.float32)
        for at, hashes in _pieces(shared.value, batches):
            bits = Bits(shared.value, at, hashes, slot_bits)
            for p, slot in enumerate(bits.slots):
                np.add.at(n[p], slot << np.uint32(1) | bits.bit, np.float32(1))
        yield from blocks(n, slot_bits)

    found = texts.select("symbols").coalesce(1 + tokens // FILLED).mapInArrow(run, "block long, at binary, n binary")
    return joined(found, PREDICTORS, slot_bits)


def learn(texts: DataFrame, shared) -> np.ndarray:
    """The mixer's weights: each task learns online along its texts, and the tasks' weights are averaged. shared: the
    broadcast of the code, the tables, their log odds when weights are learnt and when texts are scored, and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, by, _, seen = shared.value
        weights, step = first_weights(), 0
        for at, hashes in _pieces(code, batches):
            step = learn_online(Given(code, at, hashes, tables, by, seen), weights, step)
        if step:
            flat = weights.reshape(-1).astype(np.float64)
            columns = [np.arange(len(flat)), flat * step, np.full(len(flat), float(step))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "weight", "steps"])

    found = texts.select("symbols").mapInArrow(run, "place long, weight double, steps double")
    flat = first_weights().reshape(-1)
    for row in found.groupBy("place").agg((F.sum("weight") / F.sum("steps")).alias("weight")).collect():  # one a weight
        flat[row.place] = row.weight
    return flat.reshape(PREDICTORS, GATES)


def score(texts: DataFrame, shared, weights: np.ndarray) -> DataFrame:
    """`texts` with s_text, the natural logarithm of its symbols' probability, instead of these. shared: as for `learn`."""
    schema = texts.drop("symbols").schema.add("s_text", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, _, by, seen = shared.value
        for rows, at, sizes in _texts(batches):
            found = refined(code, at, sizes, tables, by, seen, weights)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], schema.names)

    return texts.mapInArrow(run, schema)

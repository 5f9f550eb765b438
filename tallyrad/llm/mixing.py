"""Scores texts by a language model that mixes bit predictors (online logistic context mixing).

A text is its words in lower case, each followed by a space, and an end mark that no text holds. Bytes are coded bit
by bit. Several predictors say what the next bit is: each hashes a context (the last 1, 2, 3 or 5 bytes of the word,
or all of it so far) and the bits of the byte so far into a slot, which holds how often 0 and 1 came there. Their
predictions, as log odds, are added up by two mixers whose weights are chosen by a gate: one by the bits of the byte
so far, one by how much the long contexts have seen. Weights are learnt online, bit costs falling step by step along
streams of the vocabulary, each occurrence judged by what the others say.

Domains (languages, say) have a model each: frequent words by their counts there, and the rest of the probability by
bits. Within a text, frequent words are also foretold by how often they came in it before, which counts more or less.
All these models, the one by bits alone, and that of wordbits.py, whose contexts cross words and whose mixer is learnt
online along the texts and refined within each, are weighed by how well each coded the text so far; this last gate is
refined word by word within every text, whose domain is not asked for.

Slots and weights of spelt words depend on how often words occur, so their bits are the same wherever they stand. Each
distinct word is spelt once, by Spark, whatever the number of its occurrences; texts then add up what their words cost.
Frequent words, a fixed number, go to the tasks that read texts; the others are looked up by a join, so no text is
ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordbits
from .common import byte_parts, stored

#: Bytes of the contexts besides the whole word so far, and slots of each predictor as a power of two.
ORDERS = (1, 2, 3, 5)
SLOT_BITS = 21
#: Longer words are coded piece by piece, each as if it began a word.
PIECE = 4096
#: Bytes coded at once when weights are learnt and when words are scored.
STEP, CHUNK = 1 << 14, 1 << 15
#: What each side of a slot counts before anything was seen; weights at first; the size of steps and when it halves.
PRIOR, FIRST_WEIGHT, PACE, HALVED = 0.1, 0.3, 0.4, 50
#: Words that go to the tasks that read texts, and bytes of the longest such word.
FREQUENT, FREQUENT_BYTES = 1 << 16, 64
#: What the text so far may count for, at most, and after how many frequent words it counts half of that.
RECENT, WARM = (0.0, 0.1, 0.3), 20
#: Bytes of texts whose words are counted at once, and of those that are scored at once.
COUNTED, SCORED_AT_ONCE = 1 << 22, 1 << 20
#: Domains that have a model of their own, the largest; all others share one.
DOMAINS = 15
#: Bytes of words in one task that fills slots.
FILLED = 1 << 25
#: Frequencies are told apart by so many classes for each power of two when frequent words are looked for.
CLASSES = 8

END = b"\xff"
PREDICTORS = len(ORDERS) + 1
_PAD, _BLOCK = max(ORDERS), 13
_LOWER = bytes(range(256)).lower()
_BIAS = np.float32(0.4)
_random = np.random.Generator(np.random.PCG64(13))
_VALUE = _random.integers(1, 1 << 32, 256, np.uint32)
_POWER = (_random.integers(1, 1 << 32, PIECE + 2, np.uint32) | 1).astype(np.uint32)
_STEP_BY_ORDER = (_random.integers(1, 1 << 32, _PAD + 1, np.uint32) | 1).astype(np.uint32)
_OWN = _random.integers(1, 1 << 32, PREDICTORS, np.uint32)
_BITS = (_random.integers(1, 1 << 32, 256, np.uint32) | 1).astype(np.uint32)
_SPREAD = np.uint32(0x9E3779B1)


def tokens_of(text: str | None) -> list[bytes]:
    """Words of a text (null: empty) with A-Z in lower case, and the end mark."""
    return [*(text or "").encode().translate(_LOWER).split(), END]


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """`tokens_of` all of some texts, one after the other, and how many each has."""
    marked = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.binary()), b""), pa.scalar(END), pa.scalar(b" "))
    offsets = np.frombuffer(marked.buffers()[1], np.int32, len(marked) + 1, 4 * marked.offset)
    data = np.frombuffer(marked.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]].translate(_LOWER), np.uint8)
    offsets = offsets - offsets[0]
    space = (data == 32) | (data - np.uint8(9) < 5)
    word = ~space
    begins, ends = word.copy(), word.copy()
    begins[1:] &= space[:-1]
    ends[:-1] &= space[1:]
    begins[offsets[:-1]], ends[offsets[1:] - 1] = word[offsets[:-1]], True
    begins = np.flatnonzero(begins)
    places = np.append(0, np.cumsum(np.flatnonzero(ends) + 1 - begins)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(places), pa.py_buffer(data[word])])
    return words, np.diff(np.searchsorted(begins, offsets))


def units(words: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """What is coded of each word, in pieces, and the word's number."""
    for k, word in enumerate(words):
        if len(word) < PIECE:
            yield word + b" ", k
        else:
            whole = word + b" "
            for i in range(0, len(whole), PIECE):
                yield whole[i : i + PIECE], k


def chunks(words: list[bytes], size: int) -> Iterator[tuple[list[bytes], list[int]]]:
    own, of, n = [], [], 0
    for unit, k in units(words):
        own.append(unit)
        of.append(k)
        n += len(unit)
        if n >= size:
            yield own, of
            own, of, n = [], [], 0
    if own:
        yield own, of


def contexts(own: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Bytes of some units, the hash of each predictor's context before every byte, and where units begin."""
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    data = np.frombuffer(b"\0" * _PAD + (b"\0" * _PAD).join(own), np.uint8)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    at = np.repeat(starts + _PAD * np.arange(1, len(own) + 1), sizes) + place
    value, found, h = _VALUE[data], [], np.zeros(len(at), np.uint32)
    for order in range(1, _PAD + 1):
        h = h + value[at - order] * _STEP_BY_ORDER[order]
        if order in ORDERS:
            found.append(h)
    term = value[at] * _POWER[place]
    before = np.cumsum(term, dtype=np.uint32) - term
    found.append((before - np.repeat(before[starts], sizes)) * _SPREAD + place.astype(np.uint32))
    found = [(x ^ (x >> np.uint32(15))) * _SPREAD + own for x, own in zip(found, _OWN)]
    return data[at], found, starts


def bits(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each of the eight bits: the bits of the byte before it, with a leading one, and the bit."""
    for j in range(8):
        yield (data >> (8 - j) | 1 << j) if j else np.ones_like(data), data >> (7 - j) & 1


def slot(context: np.ndarray, so_far: np.ndarray, slot_bits: int) -> np.ndarray:
    return hashed(context, _BITS[so_far], slot_bits)


def hashed(context: np.ndarray, own: np.ndarray, slot_bits: int) -> np.ndarray:
    """The slot of a context and the hash of the bits of the byte so far."""
    x = (context ^ own) * _SPREAD
    return ((x ^ (x >> np.uint32(13))) * _SPREAD) >> np.uint32(32 - slot_bits)


def levels(n: np.ndarray) -> np.ndarray:
    """Counts as 256 levels, finer where they are small; 1 is told from 0 and 2 exactly."""
    return np.minimum(255, np.rint(16 * np.log2(1 + n))).astype(np.uint8)


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Both counts of a slot in 16 bits. Large counts keep their ratio."""
    over = np.maximum(1, np.maximum(n0, n1) / 60_000)
    return levels(n0 / over).astype(np.uint16) << np.uint16(8) | levels(n1 / over)


def odds(apart: float) -> np.ndarray:
    """Log odds that a slot gives to the bit that came, by that bit and the slot's state; `apart` is taken from
    that bit's count first, 1 where the slots had counted it."""
    count = np.exp2(np.arange(256) / 16) - 1
    n0, n1 = np.repeat(count, 256), np.tile(count, 256)
    less = lambda n: np.log(np.maximum(n - apart, 0) + PRIOR)
    return np.concatenate([less(n0) - np.log(n1 + PRIOR), less(n1) - np.log(n0 + PRIOR)]).astype(np.float32)


def _seen() -> np.ndarray:
    """Eight classes of how much a slot has seen."""
    count = np.exp2(np.arange(256) / 16) - 1
    total = np.add.outer(count, count).reshape(-1)
    return np.minimum(7, np.log2(1 + total) / 2 + 0.5).astype(np.uint8)


SCORED, LEARNT, SEEN = odds(0), odds(1), _seen()
#: Weight sets of the two mixers: one for each bit of a byte, and one for each class of what long contexts have seen.
GATES = (8, 64)


class Inputs:
    """What the predictors say of the bits of some units, bytes in the order of their gates."""

    def __init__(self, own: list[bytes], tables: np.ndarray, by: np.ndarray):
        data, found, starts = contexts(own)
        self.sizes = np.diff(np.append(starts, len(data)))
        self.tables, self.by, self.slot_bits = tables, by, int(tables.shape[1]).bit_length() - 1
        first = [SEEN[tables[p][slot(found[p], np.ones_like(data), self.slot_bits)]] for p in (-1, -2)]
        gate = first[0] << 3 | first[1]
        self.order = np.argsort(gate, kind="stable")
        self.counts = np.bincount(gate, minlength=GATES[1])
        self.gates = np.flatnonzero(self.counts)
        self.begins = (np.cumsum(self.counts) - self.counts)[self.gates]
        self.data, self.found = data[self.order], [x[self.order] for x in found]
        self.given = np.empty((PREDICTORS + 1, len(data)), np.float32)

    def __iter__(self) -> Iterator[np.ndarray]:
        """For each of the eight bits the predictors' log odds of the bit that came."""
        given = self.given
        for so_far, bit in bits(self.data):
            came, own = bit.astype(np.uint32) << np.uint32(16), _BITS[so_far]
            for p, x in enumerate(self.found):
                given[p] = self.by[came | self.tables[p][hashed(x, own, self.slot_bits)]]
            given[PREDICTORS] = np.where(bit == 1, _BIAS, -_BIAS)
            yield given

    def mixed(self, weights: list[np.ndarray], j: int) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the bit that came, from both mixers."""
        other = np.zeros(len(self.data), np.float32)
        for w, x in zip(weights[1], self.given):
            other += np.repeat(w, self.counts) * x
        return weights[0][:, j] @ self.given, other


def costs(words: list[bytes], tables: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of each word's probability: the mean of what the two mixers give."""
    total = np.zeros((len(GATES), len(words)))
    for own, of in chunks(words, CHUNK):
        now = Inputs(own, tables, SCORED)
        byte = np.zeros((len(GATES), len(now.data)), np.float32)
        for j, _ in enumerate(now):
            for k, z in enumerate(now.mixed(weights, j)):
                byte[k] -= np.log(1 + np.exp(np.minimum(-z, 80)))
        word = np.repeat(of, now.sizes)[now.order]
        for k in range(len(GATES)):
            total[k] += np.bincount(word, byte[k], len(words))
    return np.logaddexp(*total) - math.log(2)


def first_weights() -> list[np.ndarray]:
    return [np.full((PREDICTORS + 1, n), FIRST_WEIGHT, np.float32) for n in GATES]


def learn_online(words: list[bytes], often: np.ndarray, tables: np.ndarray, weights: list[np.ndarray], step: int) -> int:
    """Moves the weights along some words, whose slots had counted them; returns the next step's number."""
    for own, of in chunks(words, STEP):
        now = Inputs(own, tables, LEARNT)
        worth = np.repeat(1 + np.log2(often[of]), now.sizes).astype(np.float32)[now.order]
        up, down = [np.zeros(w.shape) for w in weights], [np.zeros(w.shape) for w in weights]
        for j, given in enumerate(now):
            wrong = [1 / (1 + np.exp(np.minimum(z, 80))) for z in now.mixed(weights, j)]
            a, b = [worth * x for x in wrong], [worth * x * (1 - x) for x in wrong]
            square = given * given
            up[0][:, j], down[0][:, j] = given @ a[0], square @ b[0]
            for gate, begin in zip(now.gates, now.begins):
                own = slice(begin, begin + now.counts[gate])
                up[1][:, gate] += given[:, own] @ a[1][own]
                down[1][:, gate] += square[:, own] @ b[1][own]
        pace = PACE / (1 + step / HALVED)
        for w, u, d in zip(weights, up, down):
            w += np.clip(pace * u / (d + 5), -0.2, 0.2).astype(np.float32)
        step += 1
    return step


def vocabulary(docs: DataFrame, part: Column, parts: int) -> DataFrame:
    """word, c (its tokens in texts to learn from) and c0, c1, ... (by part), of the words of all documents.

    part: the number of a document's part, null if it isn't learnt from.
    """

    names = [f"c{k}" for k in range(parts)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in byte_parts(batch, 0, COUNTED):
                words, each = tokenised(own.column(0))
                coded = words.dictionary_encode()
                at = coded.indices.to_numpy() + np.repeat(own.column(1).to_numpy() * len(coded.dictionary), each)
                n = np.bincount(at, minlength=(parts + 1) * len(coded.dictionary)).reshape(parts + 1, -1)
                yield pa.RecordBatch.from_arrays([coded.dictionary, *map(pa.array, n[:parts])], ["word", *names])

    numbered = docs.select("text", F.coalesce(part, F.lit(parts)).cast("long").alias("part"))
    counted = numbered.mapInArrow(count, "word binary, " + ", ".join(f"{c} long" for c in names))
    summed = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in names])
    return summed.select("word", sum((F.col(c) for c in names[1:]), F.col(names[0])).alias("c"), *names)


def _blocks(n: np.ndarray, slot_bits: int) -> Iterator[pa.RecordBatch]:
    """A task's slots by blocks: places of those that aren't empty and what they hold, small numbers in a byte each."""
    width = 2 << _BLOCK
    for p in range(len(n)):
        for b in range(0, 2 << slot_bits, width):
            own = n[p, b : b + width]
            for at, kind in ((np.flatnonzero((own > 0) & (own < 256)), np.uint8), (np.flatnonzero(own >= 256), np.float32)):
                if len(at):
                    row = [p * (1 << slot_bits - _BLOCK) + b // width, at.astype("<u2").tobytes(), own[at].astype(kind).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["block", "at", "n"])


def _joined(blocks: DataFrame, predictors: int, slot_bits: int) -> np.ndarray:
    """Tables of the slots' states from all tasks' blocks."""

    def join(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << _BLOCK, np.float64)
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist()):
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8 if 2 * len(n) == len(at) else np.float32)
        state = states(total[0::2], total[1::2]).astype("<u2").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([state], pa.binary())], ["block", "state"])

    tables = np.zeros(predictors << slot_bits, np.uint16)
    found = blocks.groupBy("block").applyInArrow(join, "block long, state binary").toArrow()
    for block, state in zip(found["block"].to_pylist(), found["state"]):
        tables[block << _BLOCK : block + 1 << _BLOCK] = np.frombuffer(state.as_buffer(), "<u2")
    return tables.reshape(predictors, -1)


def fill_slots(vocabulary: DataFrame, size: int, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """The predictors' slots from all words to learn from. size: bytes of these words. What comes to the driver are
    two bytes a slot, whatever the corpus; each task sums its own slots before they are shuffled by blocks."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PREDICTORS, 2 << slot_bits), np.float32)
        for batch in batches:
            often = batch.column(1).to_numpy()
            for own, of in chunks(batch.column(0).to_pylist(), CHUNK):
                data, found, starts = contexts(own)
                c = np.repeat(often[of], np.diff(np.append(starts, len(data)))).astype(np.float32)
                for so_far, bit in bits(data):
                    before = _BITS[so_far]
                    for p, x in enumerate(found):
                        np.add.at(n[p], hashed(x, before, slot_bits) << np.uint32(1) | bit, c)
        yield from _blocks(n, slot_bits)

    words = vocabulary.where("c > 0").select("word", "c").coalesce(1 + size // FILLED)
    return _joined(words.mapInArrow(fill, "block long, at binary, n binary"), PREDICTORS, slot_bits)


def mix(vocabulary: DataFrame, shared) -> list[np.ndarray]:
    """The mixers' weights: each task learns online along its words, and the tasks' weights are averaged. shared: the
    tables' broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, step = first_weights(), 0
        for batch in batches:
            step = learn_online(batch.column(0).to_pylist(), batch.column(1).to_numpy(), shared.value, weights, step)
        if step:
            flat = np.concatenate([w.reshape(-1) for w in weights]).astype(np.float64)
            columns = [np.arange(len(flat)), flat * step, np.full(len(flat), float(step))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "weight", "steps"])

    found = vocabulary.where("c > 0").select("word", "c").mapInArrow(run, "place long, weight double, steps double")
    rows = found.groupBy("place").agg((F.sum("weight") / F.sum("steps")).alias("weight")).collect()  # one a weight
    flat = np.concatenate([w.reshape(-1) for w in first_weights()])
    for row in rows:
        flat[row.place] = row.weight
    bounds = np.cumsum([0, *((PREDICTORS + 1) * n for n in GATES)])
    return [flat[a:b].reshape(PREDICTORS + 1, -1) for a, b in zip(bounds, bounds[1:])]


def score_words(vocabulary: DataFrame, shared, weights: list[np.ndarray]) -> DataFrame:
    """The vocabulary with e, the natural logarithm of each word's probability. shared: the tables' broadcast."""
    schema = vocabulary.select("*").schema.add("e", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = costs(batch.column(0).to_pylist(), shared.value, weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], schema.names)

    return vocabulary.mapInArrow(run, schema)


def frequent_words(scored: DataFrame) -> pa.Table:
    """The FREQUENT words that come most often in texts to learn from, of bounded size, ties in the words' order.

    Counts of frequencies, in classes, tell first how often such a word comes at least, so that only words that come
    as often are sorted, by executors; what comes to the driver is a fixed number of words.
    """
    able = scored.where((F.octet_length("word") <= FREQUENT_BYTES) & (F.col("c") > 0))
    kind = F.floor(F.log2("c") * CLASSES).cast("int").alias("kind")
    n, least = 0, 0
    for row in sorted(able.groupBy(kind).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True):
        n, least = n + row.n, row.least
        if n >= FREQUENT:
            break
    return stored(able.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(FREQUENT)).orderBy(F.desc("c"), "word").toArrow()


def _gated(frequent: dict[str, np.ndarray], totals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each frequent word's probability by bits alone and in every domain, what frequent words have together, and
    the logarithm of a factor for the others.

    A domain gives frequent words the share of its tokens that they have, less their singletons, which stand for
    words not yet seen (Good and Turing); among them its counts decide, and to a lesser part the bits. What it leaves
    goes to other words as the bits would have it.
    """
    bits = np.exp(frequent["e"])
    here = min(bits.sum(), 0.999)
    all_c = frequent["c"].astype(np.float64)
    values, together, left = [bits], [here], [0.0]
    for k, total in enumerate(totals):
        c = frequent[f"c{k}"].astype(np.float64)
        once = c == 1
        other = (total - c.sum() + (once & (all_c == 1)).sum() + 1) / (total + 2) if len(c) else 1.0
        prior = (once & (all_c > 1)).sum() + 1
        values.append((1 - other) * (c + prior * bits / max(here, 1e-300)) / (c.sum() + prior))
        together.append(1 - other)
        left.append(math.log(other / (1 - here)))
    return np.array(values), np.array(together), np.array(left)


def _log(x: np.ndarray) -> np.ndarray:
    """Logarithms in single precision, also of what only double precision holds."""
    with np.errstate(divide="ignore", over="ignore"):
        found = np.log(x.astype(np.float32))
    far = np.flatnonzero((x < 1e-30) | (x > 1e30))
    found[far] = np.log(x[far])
    return found


def _experts(at: np.ndarray, sizes: list[int], values: np.ndarray, together: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Logarithm of what each expert gives to the tokens of some texts, a row a text. at: a frequent word's number or
    the number of frequent words, for another word, whose own probability is left to be added."""
    none, n = values.shape[1], len(sizes)
    text = np.repeat(np.arange(n), sizes)
    hit = np.flatnonzero(at < none)
    own, at = text[hit], at[hit]
    others = np.asarray(sizes) - np.bincount(own, minlength=n)
    order = np.argsort(own * (none + 1) + at, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = (own[order][1:] != own[order][:-1]) | (at[order][1:] != at[order][:-1])
    run = np.arange(len(order))
    before = np.empty(len(order))
    before[order] = run - np.maximum.accumulate(np.where(new, run, 0))
    place = run - np.searchsorted(own, np.arange(n))[own]
    came, counts = before / np.maximum(1, place), place / (place + WARM)
    texts, starts = np.unique(own, return_index=True)

    def summed(each: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        if len(own):
            total[texts] = np.add.reduceat(each, starts, dtype=np.float64)
        return total

    # words that came before are foretold by more than their own probability; the others lose the same in all models
    again = np.flatnonzero(before)
    again_at, again_text, less, gains = at[again], own[again], [], []
    for most in RECENT:
        q = most * counts
        less.append(summed(np.log1p(-q)))
        gains.append((q * came / (1 - q))[again])
    found = []
    for value, mass, rest in zip(values, together, left):
        value = np.maximum(value, 1e-300)
        plain, more = others * rest + summed(_log(value)[at]), (mass / value)[again_at]
        for most, lost, gain in zip(RECENT, less, gains):
            found.append(plain + lost + np.bincount(again_text, _log(1 + gain * more), n) if most else plain)
    return np.array(found).T


def _code(frequent: dict[str, np.ndarray], totals: list[int], n: int) -> wordbits.Code:
    """Bits of frequent words, each at home in the domain that it takes the largest share of, and of all other words."""
    c = np.append(frequent["c"], max(1, n - frequent["c"].sum()))
    shares = np.array([frequent[f"c{k}"] / max(1, total) for k, total in enumerate(totals)])
    return wordbits.Code(c, np.append(shares.argmax(axis=0), len(totals)))


def _known_sums(docs: DataFrame, shared) -> DataFrame:
    """Of every document what its frequent words add up to, its other words with their counts, and the numbers of its
    frequent words in the order of the text, others as one number more. shared: the broadcast of the frequent words,
    what each adds (to known tokens, to the base) and what `_gated` gives."""
    own = docs.select("text", "doc_id", "learnt")
    schema = own.drop("text").schema.add("n_tokens", "long").add("n_bytes", "long").add("s_known", "double").add("s_base", "double")
    kind = schema.simpleString()[len("struct<") : -1] + ",s_gate array<double>,others array<struct<word: binary, n: long>>,symbols binary"

    def lists(values: pa.Array, bounds: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)

    def rows(own: pa.RecordBatch) -> pa.RecordBatch:
        frequent, plain, gated = shared.value
        words, each = tokenised(own.column(0))
        coded = words.dictionary_encode()
        code, distinct, none = coded.indices.to_numpy(), coded.dictionary, len(frequent)
        at = pc.fill_null(pc.index_in(distinct, value_set=frequent), none).to_numpy().astype(np.int64)[code]
        bounds = np.append(0, np.cumsum(each))
        first, text = bounds[:-1], np.repeat(np.arange(len(each)), each)
        n_bytes = each + np.add.reduceat(pc.binary_length(distinct).to_numpy()[code], first, dtype=np.int64)
        known, base = (np.add.reduceat(x[at], first) for x in plain)
        gate = _experts(at, each, *gated)
        rare = np.flatnonzero(at == none)
        key, n = np.unique(text[rare] * len(distinct) + code[rare], return_counts=True)
        of, word = np.divmod(key, len(distinct))
        others = pa.StructArray.from_arrays([distinct.take(pa.array(word)), pa.array(n)], ["word", "n"])
        symbols = [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(at.astype("<i4"))]
        columns = [own.column(1), own.column(2), *map(pa.array, (each, n_bytes, known, base))]
        columns.append(lists(pa.array(gate.reshape(-1)), gate.shape[1] * np.arange(len(each) + 1)))
        columns.append(lists(others, np.searchsorted(of, np.arange(len(each) + 1))))
        columns.append(pa.Array.from_buffers(pa.binary(), len(each), symbols))
        return pa.RecordBatch.from_arrays(columns, [*schema.names, "s_gate", "others", "symbols"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(rows, byte_parts(batch, 0, SCORED_AT_ONCE))

    return own.mapInArrow(run, kind)


def score(docs: DataFrame, learn: Column, domain: Column | None = None, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The model's and the base's log10 probability of every document.

    docs: doc_id, text; learn: which documents are learnt from (null: not); domain: what texts to learn from belong
    to (null is a domain, none given: one). Returns doc_id, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes and bits_per_byte. Null and empty texts are their end mark alone. Texts and words of any length count
    whole. Repeated rows are counted and scored one by one; there are no ties. Where nothing can be learnt from, all
    bits are even and texts are scored all the same; an empty table gives no rows. Other columns are neither read nor
    returned, but for those that `learn` and `domain` ask for.
    """
    learn = F.coalesce(learn, F.lit(False))
    domain = F.lit("") if domain is None else F.coalesce(domain.cast("string"), F.lit(""))
    own = docs.select("doc_id", "text", learn.alias("learnt"), domain.alias("domain"))
    largest = own.where("learnt").groupBy("domain").count().orderBy(F.desc("count"), "domain").limit(DOMAINS).collect()
    part = F.lit(len(largest))
    for k, r in enumerate(largest):
        part = F.when(F.col("domain") == r.domain, k).otherwise(part)
    parts = len(largest) + 1
    words = stored(vocabulary(own, F.when(F.col("learnt"), part), parts))
    size = F.octet_length("word")
    sums = {"n": F.sum("c"), "v": F.count_if(F.col("c") > 0), "size": F.sum(F.when(F.col("c") > 0, size))} | {f"c{k}": F.sum(f"c{k}") for k in range(parts)}
    total = words.agg(*[F.coalesce(s, F.lit(0)).alias(k) for k, s in sums.items()]).first()
    context = docs.sparkSession.sparkContext
    tables = context.broadcast(fill_slots(words, total.size, slot_bits))
    scored = stored(score_words(words, tables, mix(words, tables)))
    tables.destroy()
    below = total.n + 0.5 * (total.v + 1)
    found = frequent_words(scored)
    frequent = {k: found[k].to_numpy() for k in found.column_names if k != "word"}
    totals = [total[f"c{k}"] for k in range(parts)]
    # of a frequent word, and of one that isn't, which adds nothing here
    plain = np.array([np.append(frequent["c"] > 0, 0), np.append(np.log10((frequent["c"] + 0.5) / below), 0)])
    tables = context.broadcast((found["word"].combine_chunks(), plain, _gated(frequent, totals)))
    known = stored(_known_sums(own, tables).withColumn("row", F.monotonically_increasing_id()))
    tables.destroy()
    other = known.select("row", F.explode("others").alias("o")).select("row", "o.word", F.col("o.n").alias("times"))
    met = other.join(scored.select("word", "c", "e"), "word")
    code = _code(frequent, totals, total.n)
    texts = known.where("learnt").select("symbols")
    shared = context.broadcast(code)
    slots = wordbits.fill(texts, shared, total.n, slot_bits, _blocks, _joined)
    shared.destroy()
    shared = context.broadcast((code, slots, LEARNT, SCORED, SEEN))
    coded = wordbits.score(known.drop("others", "learnt"), shared, wordbits.learn(texts, shared))
    add = lambda value, name: F.sum(value * F.col("times")).alias(name)
    more = met.groupBy("row").agg(F.sum("times").alias("rare"), add((F.col("c") > 0).cast("double"), "known"), add(F.log10((F.col("c") + 0.5) / F.lit(below)), "base"), add(F.col("e"), "e"))
    every = coded.join(more, "row", "left")
    more = lambda c: F.coalesce(c, F.lit(0.0))
    # bits spell words that aren't frequent, as which none of the frequent ones comes
    unspelt = -math.log(1 - min(np.exp(frequent["e"]).sum(), 0.999))
    every = every.withColumn("experts", F.concat("s_gate", F.array(F.col("s_text") + more("rare") * unspelt)))
    best = F.array_max("experts")
    mean = best + F.log(F.aggregate("experts", F.lit(0.0), lambda a, x: a + F.exp(x - best)) / F.size("experts"))
    found = every.withColumn("score", (mean + more("e")) / math.log(10))
    return found.select(
        "doc_id", "n_tokens", (F.col("s_known") + more("known")).cast("long").alias("n_known"), F.lit(total.n).cast("long").alias("train_tokens"),
        (F.col("s_base") + more("base")).alias("base_score"), "score", "n_bytes",
        (F.col("score") * -math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )

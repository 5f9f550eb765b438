"""Toxicity by a support vector machine over a subsequence string kernel, with Nystroem landmarks.

Texts are looked at through windows of at most eight letters; marks between letters don't count, and digits that
look like letters do as letters. A window runs over one word, or over neighbouring words of up to three characters,
whatever white space parts them, so that an insult in pieces is read as one. Two windows are alike by the
subsequences of three letters they share; a subsequence counts less the wider it is spread, and inserted letters
only widen it, so gapped or padded spellings stay close to the plain one. Landmarks are windows from labelled
documents. A window's kernel values with them, whitened, are its features (Nystroem), and a linear machine on these
is trained with each toxic document represented by its worst windows. As the kernel is a sum over subsequences, the
trained machine is one table of weights by subsequence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_parts
from .quality import sample_of

#: Labelled documents that the machine is trained on, on average; chosen by a hash of the id.
SAMPLE = 2400
WINDOW = 8
#: Places between the first and the last letter of a subsequence: two letters may be inserted in each gap.
SPREAD = 6
DECAY = 0.6
LANDMARKS = 240
ROUNDS = 4
#: What a round trains on: clean windows drawn at random, the clean ones nearest to toxic so far, and at most so many
#: words of each toxic document.
USUAL, HARD, WORST = 6000, 1500, 4
#: A document is judged by the values of so many of its different words; values below the floor count as the floor.
TOP, FLOOR = 2, 0.0

TRIPLES = [
    (i, j, k, DECAY ** (k - i - 2))
    for i in range(WINDOW)
    for j in range(i + 1, WINDOW)
    for k in range(j + 1, WINDOW)
    if k - i <= SPREAD
]

#: Neighbouring words of at most three characters, and of one, which are read as one word besides.
_PIECES = re.compile(r"(?<!\S)(?:\S{1,3}\s+)+\S{1,3}(?!\S)")
_SINGLE = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")

#: Characters that stand for letters they look like.
LOOKS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

#: Number of a letter, 0 for other characters: a to z have their own, with or without accents; letters of all other
#: scripts share the rest of BITS bits.
BITS = 7
#: The number that stands before and after the letters of a word.
EDGE = 2**BITS - 1
_CLASS = np.zeros(0x32400, np.int64)
_LETTER = np.zeros(len(_CLASS), bool)
for _c in range(len(_CLASS)):
    if chr(_c).isalpha():
        _low = ord(unicodedata.normalize("NFKD", chr(_c).lower())[0])
        _CLASS[_c] = _low - 96 if 97 <= _low <= 122 else 27 + _low % (EDGE - 27)
        _LETTER[_c] = True
for _mark, _like in LOOKS.items():
    _CLASS[ord(_mark)] = ord(_like) - 96


def words_of(text: str | None) -> set[str]:
    lowered = (text or "").lower()
    found = set(lowered.split())
    for run in _PIECES.findall(lowered):
        found.add("".join(run.split()))
        found.update("".join(m.split()) for m in _SINGLE.findall(run))
    return found


def letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words in a row, with an edge before and after each word, and how many numbers each
    word has. A word without a real letter has none."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    codes = np.frombuffer(f"\n{'\n\n'.join(words)}\n".encode("utf-32-le", "surrogatepass"), "<u4") if words else np.empty(0, "<u4")
    codes = np.where(codes < len(_CLASS), codes, 0)
    of = np.repeat(np.arange(len(words)), sizes)
    classes = _CLASS[codes]
    classes[np.cumsum(sizes) - sizes] = classes[np.cumsum(sizes) - 1] = EDGE
    classes *= (np.bincount(of, _LETTER[codes], len(words)) > 0)[of]
    return classes[classes > 0], np.bincount(of[classes > 0], minlength=len(words))


def windows(classes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all windows of all words (windows, WINDOW), and the number of windows of each word."""
    classes = np.append(classes, np.zeros(WINDOW, np.int64)).astype(np.int64)
    counts = np.maximum(sizes - WINDOW + 1, 1)
    starts = np.cumsum(sizes) - sizes
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    table = classes[at[:, None] + np.arange(WINDOW)]
    table[np.arange(WINDOW) >= np.repeat(np.minimum(sizes, WINDOW), counts)[:, None]] = 0
    return table, counts


def spelt(words: set[str]) -> list[bytes]:
    """Distinct words in order, each as the bytes of its letter numbers; those without a letter are left out."""
    every = sorted(words)
    classes, sizes = letters_of(every)
    text, ends = classes.astype(np.uint8).tobytes(), np.cumsum(sizes)
    return sorted({text[end - n : end] for end, n in zip(ends.tolist(), sizes.tolist()) if n})


def subsequences(table: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Each way to take three places: the subsequence's number in every window (0 if one isn't a letter)."""
    used = table > 0
    for i, j, k, weight in TRIPLES:
        code = table[:, i] << 2 * BITS | table[:, j] << BITS | table[:, k]
        code[~(used[:, i] & used[:, j] & used[:, k])] = 0
        yield code, weight


def decision(table: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The machine's value for every window."""
    value, norm = np.zeros(len(table)), np.full(len(table), 1e-9)
    for code, weight in subsequences(table):
        value += weight * weights[code]
        norm += weight * weight * (code > 0)
    return value / np.sqrt(norm) + bias


def _sparse(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers and normalised weights: (windows, ways)."""
    codes, weights = map(list, zip(*subsequences(table)))
    codes = np.column_stack(codes)
    values = np.where(codes > 0, np.array(weights), 0.0)
    return codes, values / np.sqrt((values**2).sum(axis=1, keepdims=True) + 1e-9)


class Nystroem:
    def __init__(self, landmarks: np.ndarray):
        codes, values = _sparse(landmarks)
        self.known = np.unique(codes)
        self.values = np.zeros((len(self.known), len(landmarks)))
        np.add.at(self.values, (np.searchsorted(self.known, codes), np.arange(len(landmarks))[:, None]), values)
        self.values[self.known == 0] = 0
        spread, vectors = np.linalg.eigh(self.kernel(landmarks))
        good = spread > 1e-3
        self.whiten = vectors[:, good] / np.sqrt(spread[good])

    def kernel(self, table: np.ndarray) -> np.ndarray:
        codes, values = _sparse(table)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        values = np.where(self.known[at] == codes, values, 0)
        found = np.zeros((len(table), self.values.shape[1]))
        for way in range(codes.shape[1]):
            found += values[:, way, None] * self.values[at[:, way]]
        return found

    def features(self, table: np.ndarray) -> np.ndarray:
        return self.kernel(table) @ self.whiten

    def weights(self, w: np.ndarray) -> np.ndarray:
        """A linear machine on the features as a weight for every subsequence."""
        found = np.zeros(1 << 3 * BITS)
        found[self.known] = self.values @ (self.whiten @ w)
        found[0] = 0
        return found


def machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = 30.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; y is -1 or 1. Rows weigh as `times` says, and both
    sides alike."""
    x = np.column_stack([x, np.ones(len(x))])
    weigh = times * np.where(y > 0, 1 / max(1, times[y > 0].sum()), 1 / max(1, times[y < 0].sum())) * cost
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(12):
        margin = 1 - y * (x @ w)
        inside = margin > 0
        xi, ci = x[inside], weigh[inside]
        gradient = ridge * w - 2 * xi.T @ (ci * y[inside] * margin[inside])
        w = w - np.linalg.solve(np.diag(ridge) + 2 * (xi.T * ci) @ xi, gradient)
    return w[:-1], w[-1]


def _first_guess(docs: list[list[bytes]], labels: np.ndarray) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """For each word, and for each stretch of four letters, the logarithm of how much oftener it is in toxic
    documents than in others, times that of how many toxic ones have it."""
    ratio, found = (len(labels) - labels.sum() + 1) / (labels.sum() + 1), []
    for parts in (lambda words: words, lambda words: {w[i : i + 4] for w in words for i in range(max(1, len(w) - 3))}):
        seen = (Counter(), Counter())
        for words, label in zip(docs, labels):
            seen[label].update(parts(words))
        found.append({g: math.log((n + 0.1) * ratio / (seen[0][g] + 0.5)) * math.log1p(n) for g, n in seen[1].items()})
    return found[0], found[1]


def fit(texts: list[str | None], labels: list[int]) -> dict | None:
    """Weights by subsequence, bias, and the line that turns a document's highest values into a probability.

    None without both labels, or if no word is oftener in toxic documents than in others.
    """
    y = np.array(labels, np.int64)
    docs = [spelt(words_of(t)) for t in texts]
    if y.all() or not y.any():
        return None
    words_guess, guess = _first_guess(docs, y)
    every = sorted({w for words in docs for w in words})
    table, counts = windows(np.frombuffer(b"".join(every), np.uint8), np.array([len(w) for w in every], np.int64))
    number = {w: k for k, w in enumerate(every)}
    first = np.cumsum(counts) - counts
    bags = [np.array([number[w] for w in words], np.int64) for words in docs]
    rank = lambda w: max(guess.get(w[i : i + 4], -9.0) for i in range(max(1, len(w) - 3)))
    value = np.array([max(words_guess.get(w, -9.0), 0.5 * rank(w)) for w in every])
    suspect = np.array([words_guess.get(w, -9.0) > 0 for w in every])  # others don't stand for toxic documents
    window = first.copy()  # of each word, the window that counts
    for k, w in enumerate(every):
        if counts[k] > 1 and value[k] > 0:
            best = max(range(len(w) - 3), key=lambda i: guess.get(w[i : i + 4], -9.0))
            window[k] += min(best, counts[k] - 1)
    if not suspect.any():
        return None
    pick = np.random.Generator(np.random.PCG64(11))
    others = np.concatenate([b for b, label in zip(bags, y) if not label])
    clean = np.unique(others)
    #: of each window, the root of how many clean documents have its word
    common = np.repeat(np.sqrt(np.bincount(others, minlength=len(every))), counts)
    usual = first[pick.permutation(clean)[:USUAL]]
    hard = np.empty(0, np.int64)
    for step in range(ROUNDS):
        worst = [_worst(b, value[b], step) for b in (b[suspect[b]] for b, label in zip(bags, y) if label) if len(b)]
        positive = window[np.concatenate(worst)]
        far = clean[np.argsort(-value[clean], kind="stable")[:HARD]]
        hard = np.unique(np.concatenate([hard, window[far]]))
        negative = np.unique(np.concatenate([usual, hard]))
        unique, times = np.unique(table[positive], axis=0, return_counts=True)
        marks = unique[np.argsort(-times, kind="stable")[: LANDMARKS * 2 // 3]]
        marks = np.vstack([marks, table[pick.permutation(negative)[: LANDMARKS - len(marks)]]])
        space = Nystroem(marks)
        x = space.features(table[np.concatenate([positive, negative])])
        times = np.append(np.ones(len(positive)), common[negative])
        w, bias = machine(x, np.repeat([1.0, -1.0], [len(positive), len(negative)]), times)
        weights = space.weights(w)
        found = np.concatenate([decision(table[i : i + 100_000], weights, bias) for i in range(0, len(table), 100_000)])
        value = np.maximum.reduceat(found, first)
        for k in np.flatnonzero(counts > 1):
            window[k] = first[k] + found[first[k] : first[k] + counts[k]].argmax()
    top = np.array([_top(value[b][value[b] > FLOOR].tolist()) for b in bags])
    return {"weights": weights.astype(np.float32), "bias": bias, "line": _line(top, y)}


def _worst(bag: np.ndarray, value: np.ndarray, step: int) -> np.ndarray:
    """Words that stand for a toxic document: the worst one, and up to WORST - 1 more that are bad as well."""
    order = np.argsort(-value, kind="stable")[:WORST]
    least = 0.0 if step else 0.5 * value[order[0]]
    return bag[order[np.append(True, value[order[1:]] > max(least, 0.0))]]


def _top(values: list[float]) -> list[float]:
    """The TOP highest of the values of a document's different words, FLOOR where there are no more."""
    return sorted(values, reverse=True)[:TOP] + [FLOOR] * (TOP - len(values))


def _line(value: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on some values, a little regularised; both labels weigh alike."""
    weigh = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    x, p = np.column_stack([value, np.ones(len(value))]), np.zeros(value.shape[1] + 1)
    ridge = np.append(np.full(value.shape[1], 0.5), 1e-3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        p -= np.linalg.solve((x.T * (weigh * q * (1 - q))) @ x + np.diag(ridge), x.T @ (weigh * (q - y)) + ridge * p)
    return p


def toxicity(texts: list[str | None], model: dict | None) -> np.ndarray:
    """Probability of being toxic of each text, from its worst windows."""
    if model is None:
        return np.zeros(len(texts))
    bags = [words_of(t) for t in texts]
    every, worst = list(set().union(*bags)), {}
    if every:
        classes, sizes = letters_of(every)
        table, counts = windows(classes, sizes)
        found = np.concatenate(
            [decision(table[i : i + 50_000], model["weights"], model["bias"]) for i in range(0, len(table), 50_000)]
        )
        value = np.maximum.reduceat(found, np.cumsum(counts) - counts)
        text, ends = classes.astype(np.uint8).tobytes(), np.cumsum(sizes)
        for k in np.flatnonzero(value > FLOOR):
            worst[every[k]] = (text[ends[k] - sizes[k] : ends[k]], float(value[k]))
    top = np.array([_top(list(dict(worst[w] for w in worst.keys() & bag).values())) for bag in bags]).reshape(-1, TOP)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([top, np.ones(len(top))]) @ model["line"], -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A machine fitted on about `sample` of the documents that labels (doc_id, toxic) name; none without both
    labels, 0 and 1."""
    rows = sample_of(docs, labels, "toxic", sample).orderBy("doc_id").toPandas()
    return fit(rows["text"].tolist(), rows["toxic"].astype(int).tolist())


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score, from 0 (harmless) to 1 (toxic), for every row.

    Null texts and texts without a word score as texts whose worst window lies on the harmless margin.
    Without a model every score is 0. Texts of any length are scored whole; repeated rows stay and score alike, so
    there are no ties to break; an empty table gives none. Columns besides doc_id and text aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, 1):
                found = toxicity(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")

"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of variable order, up to ORDER bytes deep: below the first two levels a
context is kept only if it was seen at least SEEN times, so common contexts are long and rare ones short. A byte
costs the bits of its share in the longest kept context before it; where that context never saw the byte, the bits
of an escape are paid and the next shorter context is asked, down to a uniform code over all 256 bytes. Escapes
follow method C: a context gives as many counts to the escape as it has different successors. Counts are learnt
once and then frozen, so a text's exact code length is a sum over its bytes, and the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts

#: Documents of each language that the trees are learnt from, on average, chosen by a hash of the id; longer ones
#: than LONGEST bytes aren't learnt from. Together these bound what comes to the driver.
SAMPLE = 300
LONGEST = 100_000
#: Bytes of the deepest contexts, and how often a context of three bytes or more must have been seen.
ORDER = 4
SEEN = 3
#: Bytes scored at once; longer texts go piece by piece, each with the context before it.
PART = 1 << 19
#: What stands before the first byte of a text.
START = b" " * ORDER

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_models: dict[str, list] = {}


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct stretches of ORDER + 1 bytes of all texts, as integers, and how often each occurs."""
    found = []
    for text in texts:
        data = _LOWER[np.frombuffer(START + text.encode(), np.uint8)].astype(np.int64)
        if len(data) > ORDER:
            found.append(sum(data[k : len(data) - ORDER + k] << 8 * (ORDER - k) for k in range(ORDER + 1)))
    return np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)


def learn(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """Counts of stretches of ORDER + 1 bytes for each language: languages, lang, gram and n.

    labelled: doc_id, text, lang. The sample holds about `sample` whole documents of each language; rows without a
    doc_id, text or language aren't learnt from.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", "text", "lang").where(F.octet_length("text") <= LONGEST)
    sizes = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.join(F.broadcast(sizes), "lang").where(place < F.col("share")).select("lang", "text")

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                gram, n = grams_of(texts.tolist())
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    counts = (
        chosen.mapInPandas(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ).toPandas()
    languages = sorted(counts["lang"].unique())
    return {
        "key": uuid.uuid4().hex,
        "languages": languages,
        "lang": np.searchsorted(languages, counts["lang"]) if len(counts) else np.empty(0, np.int64),
        "gram": counts["gram"].to_numpy(np.int64),
        "n": counts["n"].to_numpy(np.int64),
    }


class Lookup:
    """Values by integer key: slots by a multiplicative hash say where in the keys to look; keys whose slot is taken
    are searched for in order."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        slot = self.slots(keys)
        self.slot = np.full(1 << self.bits, len(keys), np.int32)
        self.slot[slot] = np.arange(len(keys))
        self.key, self.value = np.append(keys, -1), np.append(values, 0).astype(np.float32)
        taken = self.slot[slot] != np.arange(len(keys))
        order = np.argsort(keys[taken])
        self.more, self.more_values = keys[taken][order], self.value[:-1][taken][order]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none), and whether each key is there."""
        at = self.slot[self.slots(keys)]
        there = self.key[at] == keys
        value = np.where(there, self.value[at], np.float32(0))
        if len(self.more):
            left = np.flatnonzero(~there & (at < len(self.key) - 1))
            at = np.minimum(np.searchsorted(self.more, keys[left]), len(self.more) - 1)
            found = self.more[at] == keys[left]
            there[left[found]], value[left[found]] = True, self.more_values[at[found]]
        return value, there


class Tree:
    """One language's contexts: for each order, the bits of every byte seen in each kept context, and of escapes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.costs, self.escapes = [], []
        for order in range(ORDER + 1):
            own, at = np.unique(gram & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            count = np.bincount(at, n, len(own)) if len(own) else np.empty(0)
            context, of = np.unique(own >> 8, return_inverse=True)
            total = np.bincount(of, count, len(context)) if len(own) else np.empty(0)
            different = np.bincount(of, minlength=len(context))
            kept = total >= (SEEN if order > 2 else 1)
            whole = total + different
            seen = kept[of] if len(own) else np.empty(0, bool)
            self.costs.append(Lookup(own[seen], np.log2(whole[of][seen] / count[seen])))
            self.escapes.append(Lookup(context[kept], np.log2(whole[kept] / different[kept])))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each stretch of ORDER + 1 bytes, given those before it."""
        total, left = np.zeros(len(gram), np.float32), np.arange(len(gram))
        for order in range(ORDER, -1, -1):
            key = gram[left] & (1 << 8 * (order + 1)) - 1
            cost, there = self.costs[order].get(key)
            total[left] += cost
            left, key = left[~there], key[~there]
            if not len(left):
                return total
            total[left] += self.escapes[order].get(key >> 8)[0]
        total[left] += 8
        return total


def trees(model: dict) -> list[Tree]:
    return [Tree(model["gram"][own], model["n"][own]) for own in (model["lang"] == k for k in range(len(model["languages"])))]


def code_lengths(texts: list[bytes], known: list[Tree]) -> np.ndarray:
    """Bits of each text under each language: (texts, languages)."""
    bits = np.zeros((len(texts), len(known)))

    def add(pieces: list[tuple[int, bytes]]) -> None:
        """Each piece has ORDER bytes of context at its front."""
        sizes = np.array([len(p) - ORDER for _, p in pieces])
        data = _LOWER[np.frombuffer(b"".join(p for _, p in pieces), np.uint8)].astype(np.int64)
        gram = sum(data[k : len(data) - ORDER + k] << 8 * (ORDER - k) for k in range(ORDER + 1))
        starts = np.cumsum(sizes + ORDER) - sizes - ORDER
        own = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        gram, which = np.unique(gram[own], return_inverse=True)
        row = np.repeat([r for r, _ in pieces], sizes)
        for k, tree in enumerate(known):
            bits[:, k] += np.bincount(row, tree.bits(gram)[which], len(texts))

    held, size = [], 0
    for row, text in enumerate(texts):
        padded = START + text
        for at in range(0, len(text), PART):
            held.append((row, padded[at : at + PART + ORDER]))
            size += len(held[-1][1])
            if size >= PART:
                add(held)
                held, size = [], 0
    if held:
        add(held)
    return bits


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred and score for every row. score is the winner's probability if all languages are
    equally likely before: 2 to the minus code length, divided by the sum over languages.

    Null texts and texts without a letter are `und` with score 0, and so are all if nothing was learnt. Equal
    lengths go to the name that sorts first. Texts of any length are scored whole; repeated rows stay, and rows
    without a doc_id; an empty table gives none. Columns besides doc_id and text, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key = shared.value["languages"], shared.value["key"]
        if key not in _models:
            _models.clear()
            _models[key] = trees(shared.value)
        for batch in batches:
            for part in byte_parts(batch, 1):
                texts = part.column(1).to_pylist()
                good = [k for k, t in enumerate(texts) if names and t and has_letter(t)]
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
                if good:
                    bits = code_lengths([texts[k].encode() for k in good], _models[key])
                    best = bits.argmin(axis=1)
                    pred[good] = np.array(names, object)[best]
                    score[good] = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)

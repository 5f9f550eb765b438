"""Benchmark passages in training documents, found by spaced seeds and verified word by word.

A seed is four or five words out of a few in a row; its mask ignores the others. The masks find every stretch of
13 words or more, and every shorter item, of which at most a fifth was substituted. Seeds of benchmark items and
of documents are joined by their hashes, both sides dealt out by Spark; a bit table of the benchmark's seeds, of
bounded size, keeps most other seeds of documents out of the shuffle and decides nothing. Around each hit the item
is laid over the document without gaps, and of the stretches that are long and alike enough the best is taken: a
match counts 1, a substitution costs 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, stored
from .tokens import hashed_words, mixed

MASKS = [(0, 1, 3, 6, 7), (0, 1, 4, 6, 7), (0, 2, 3, 5, 8), (0, 1, 2, 4, 8)]
#: What items of so many words need besides.
SHORT_MASKS = {
    5: [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)], 6: [(0, 1, 2, 3), (0, 1, 3, 4)], 7: [(0, 1, 3, 4)],
    8: [(0, 1, 2, 3)], 10: [(0, 1, 2, 4, 5)], 11: [(0, 1, 2, 4, 5)],
}
EVERY_MASK = [*MASKS, *sorted({m for masks in SHORT_MASKS.values() for m in masks})]
#: Words that an overlap spans at least (or the whole item, if it is shorter), and the share that must match.
OVERLAP = 13
ALIKE = 0.8
#: Items of fewer words are never reported.
SHORTEST = 5
#: Bits of the table of seeds: a power of two, 32 for each seed, from the first of these to the second (32 MB).
TABLE_BITS = (20, 28)
PROBES = 3

_WEIGH = np.random.Generator(np.random.PCG64(31)).integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def seeds(words: np.ndarray, counts: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a mask at all places where it fits into one text, and those places."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    fits = np.flatnonzero(text[:n] == text[mask[-1] :])
    code = np.full(len(fits), np.uint64(len(mask) * 64 + mask[-1]))
    for k, offset in enumerate(mask):
        code += words[fits + offset] * _WEIGH[k]
    return mixed(code), fits


def item_seeds(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All seeds of items, with the further masks of short ones: hashes, places, numbers of the masks."""
    size, found = np.repeat(counts, counts), []
    for k, mask in enumerate(EVERY_MASK):
        code, at = seeds(words, counts, mask)
        if mask not in MASKS:
            own = np.isin(size[at], [n for n, masks in SHORT_MASKS.items() if mask in masks])
            code, at = code[own], at[own]
        found.append((code, at, np.full(len(at), k)))
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1, 2))


def stretch(same: np.ndarray, least: int) -> tuple[int, int] | None:
    """First word and end of the best stretch of at least `least` words of which ALIKE match; ties: first, shortest.

    The best of all stretches is taken if it is long and alike enough, else the best of those of less than twice
    the least length. A longer one that is alike enough holds one of these.
    """
    total = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    matches = np.concatenate([[0], np.cumsum(same)])
    lowest = np.minimum.accumulate(total)
    end = int((total - lowest).argmax())
    start = int(total[: end + 1].argmin())
    if end - start >= least and matches[end] - matches[start] >= ALIKE * (end - start):
        return start, end
    found = []
    for n in range(least, min(2 * least - 1, len(same)) + 1):
        own = matches[n:] - matches[:-n]
        start = int(own.argmax())
        if own[start] >= ALIKE * n:
            found.append((-int(total[start + n] - total[start]), start, start + n))
    return min(found)[1:] if found else None


def best_overlap(words: np.ndarray, item: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """(first word, words, matches) of the best overlap of a document with an item whose first word lies over
    the document's word `shift`, over all shifts; ties: the first word, then the longest."""
    best, size = None, len(item)
    for shift in shifts:
        a, b = max(0, -shift), min(size, len(words) - shift)
        same = words[shift + a : shift + b] == item[a:b]
        if place := stretch(same, max(SHORTEST, min(OVERLAP, size))):
            start, end = place
            found = (int(same[start:end].sum()), -(shift + a + start), end - start)
            best = max(best or found, found)
    return best and (-best[1], best[2], best[0])


def _probe(code: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The kth bit of each code in a table."""
    return (mixed(code + np.uint64(k)) if k else code) & np.uint64((1 << bits) - 1)


def seed_table(keys: DataFrame) -> np.ndarray:
    """The bit table of the seeds (column seed), bytes; its size is bounded by TABLE_BITS, and so is what comes
    to the driver: one row for each used word of 64 bits."""
    n = keys.count()
    bits = int(np.clip(int(32 * max(n, 1) - 1).bit_length(), *TABLE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).to_numpy().view(np.uint64)
            places = np.unique(np.concatenate([_probe(code, k, bits) for k in range(PROBES)]))
            word, start = np.unique(places >> np.uint64(6), return_index=True)
            own = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), start) if len(start) else places
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (word, own)], ["word", "own"])

    rows = keys.mapInArrow(run, "word long, own long").groupBy("word").agg(F.bit_or("own").alias("own")).toPandas()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["own"].to_numpy(np.int64).view(np.uint64)
    return table.view(np.uint8)


def known(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Places of the codes that the table may hold."""
    bits, left = (len(table) * 8 - 1).bit_length(), np.arange(len(code))
    for k in range(PROBES):
        place = _probe(code[left], k, bits)
        left = left[table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return left


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contaminated documents: doc_id, item_id, first_word, n_words, n_matches for each document and item.

    Words are letters and digits in lower case. Items of fewer than five words, and null or empty texts or item
    ids, on either side an empty table too, give nothing; an item that occurs often in a document is reported once,
    where most words match (ties: first). Repeated rows are each reported, of either side, and rows without a
    doc_id too. Texts of any length are read whole. Columns besides ids and texts, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    items = stored(
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
            F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").alias("item_text")
        )
    )

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, 1):
                words, counts = hashed_words(part.column(1).to_pylist())
                code, at, mask = item_seeds(words, counts)
                of = np.repeat(np.arange(len(counts)), counts)[at]
                place = at - (np.cumsum(counts) - counts)[of]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(code.view(np.int64)), part.column(0).take(pa.array(of)), pa.array(place), pa.array(mask)],
                    ["seed", "item", "place", "mask"],
                )

    keys = stored(items.select("item", "item_text").mapInArrow(of_items, "seed long, item long, place long, mask long"))
    masks = [EVERY_MASK[r.mask] for r in keys.select("mask").distinct().orderBy("mask").collect()]
    shared = spark.sparkContext.broadcast(seed_table(keys.select("seed")))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with a seed that the benchmark may have: doc_id, text, seeds."""
        table = shared.value
        for batch in batches:
            for part in byte_parts(batch, 1):
                words, counts = hashed_words(part.column(1).to_pylist())
                found = []
                for mask in masks:
                    code, at = seeds(words, counts, mask)
                    kept = known(table, code)
                    found.append((at[kept], code[kept]))
                at, code = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
                order = np.argsort(at, kind="stable")
                at, code = at[order], code[order]
                of = np.repeat(np.arange(len(counts)), counts)[at]
                hit, n = np.unique(of, return_counts=True)
                place = at - (np.cumsum(counts) - counts)[of]
                pairs = pa.StructArray.from_arrays([pa.array(code.view(np.int64)), pa.array(place)], ["seed", "word"])
                rows = part.take(pa.array(hit))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pairs)
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], ["doc_id", "text", "seeds"])

    schema = f"doc_id {doc_kind}, text string, seeds array<struct<seed:long,word:long>>"
    touched = stored(docs.select("doc_id", "text").mapInArrow(of_docs, schema).withColumn("doc", F.monotonically_increasing_id()))
    shifts = (
        touched.select("doc", F.explode("seeds").alias("s"))
        .select("doc", "s.seed", "s.word")
        .join(keys.select("seed", "item", "place"), "seed")
        .groupBy("doc", "item")
        .agg(F.array_sort(F.collect_set(F.col("word") - F.col("place"))).alias("shifts"))
    )
    laid = (
        shifts.join(touched.select("doc", "doc_id", "text"), "doc")
        .join(items, "item")
        .select("doc_id", "item_id", "text", "item_text", "shifts")
    )

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, 2):
                at, rows = [], []
                (mine, n), (theirs, m) = (hashed_words(part.column(k).to_pylist()) for k in (2, 3))
                first, start = np.cumsum(n) - n, np.cumsum(m) - m
                for k, own in enumerate(part.column(4).to_pylist()):
                    words, item = mine[first[k] : first[k] + n[k]], theirs[start[k] : start[k] + m[k]]
                    if row := best_overlap(words, item, own):
                        at.append(k)
                        rows.append(row)
                ids = part.take(pa.array(at, pa.int64()))
                columns = list(zip(*rows)) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [ids.column(0), ids.column(1), *(pa.array(c, pa.int64()) for c in columns)],
                    ["doc_id", "item_id", "first_word", "n_words", "n_matches"],
                )

    return laid.mapInArrow(
        verified, f"doc_id {doc_kind}, item_id {item_kind}, first_word long, n_words long, n_matches long"
    )

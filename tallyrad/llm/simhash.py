"""Near-duplicate detection by SimHash: 64-bit fingerprints, pigeonhole blocks, exact Hamming distances.

Fingerprints that differ in at most 3 bits agree in at least two of five blocks of bits. Every distinct
fingerprint is dealt out under each of the ten pairs of its blocks (about 26 bits a key), and distances are
computed only where such a key is shared. A shared key gives a spanning forest of its links, never all
pairs. Copies share one fingerprint and are dealt out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut

SEED = 42
BLOCKS = 5
#: Fingerprints compared with each other at once. Larger groups are cut into tiles that cover all their pairs.
TILE = 32_768

BITS = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS) for i in range(BLOCKS)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text's word shingles. No word: 0."""
    words = (text or "").encode().lower().split()  # both treat ASCII only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [join(words)]
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer, for every row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints: each one met searches what
    hasn't been met yet, so a group that is all alike is met at once."""
    rest, todo, ends = fps, [], ([], [])
    while len(rest):
        if not todo:
            todo.append(rest[0])
            rest = rest[1:]
        at = todo.pop()
        near = np.bitwise_count(rest ^ at) <= distance
        if near.any():
            met = rest[near]
            rest = rest[~near]
            todo.extend(met)
            ends[0].append(np.full(len(met), at))
            ends[1].append(met)
    if not ends[0]:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(ends[0]), np.concatenate(ends[1])


def links(fps: DataFrame, distance: int = 3, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) whose components are those of all links."""
    if distance > BLOCKS - 2:
        raise ValueError(f"{BLOCKS} blocks find distances up to {BLOCKS - 2}")
    value = F.col("fp")
    parts = [F.shiftrightunsigned(value, 64 - hi).bitwiseAND((1 << (hi - lo)) - 1) for lo, hi in BITS]
    keys = [
        F.lit(n).cast("long") * (1 << 40) + parts[i] * (1 << 16) + parts[j]
        for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
    ]
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").count().where(F.col("count") > tile)
    chunks = F.ceil(F.col("count") * 2 / tile)
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    tiles = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1),
        lambda other: F.least(own, other) * F.col("chunks") + F.greatest(own, other),
    )
    dealt = (
        dealt.join(large, "key", "left")
        .withColumn("chunks", F.when(F.col("count").isNotNull(), chunks).cast("long"))
        .select("fp", "key", F.explode(F.coalesce(tiles, F.array(F.lit(0).cast("long")))).alias("tile"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and tile; a group can go on in the next batch."""
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)]
            changes = np.flatnonzero((np.diff(rows[1]) != 0) | (np.diff(rows[2]) != 0)) + 1
            last = changes[-1] if len(changes) else 0
            held = [r[last:] for r in rows]
            if last:
                yield grouped(rows[0][:last], np.concatenate([[0], changes]))
        if len(held[0]):
            yield grouped(held[0], np.array([0, len(held[0])]))

    def grouped(values: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        """Edges within each stretch of values between two bounds."""
        values, sizes = values.view(np.uint64), np.diff(bounds)
        ends = []
        pairs = bounds[:-1][sizes == 2]
        near = np.bitwise_count(values[pairs] ^ values[pairs + 1]) <= distance if len(pairs) else []
        if len(pairs):
            ends.append((values[pairs][near], values[pairs + 1][near]))
        for k in np.flatnonzero(sizes > 2):
            ends.append(forest(values[bounds[k] : bounds[k + 1]], distance))
        a, b = (np.concatenate([e[i] for e in ends]) if ends else np.empty(0, np.uint64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return (
        dealt.select("fp", "key", "tile")
        .repartition("key", "tile")
        .sortWithinPartitions("key", "tile")
        .mapInArrow(run, "a long, b long")
    )


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row.

    Two rows are linked if their fingerprints differ in at most `distance` bits; component_id is the
    smallest doc_id reached over links, the row's own included. Null and empty texts have fingerprint zero
    and are linked like any others; shorter texts than a shingle give one shingle, and texts of any length are
    taken whole. Repeated rows stay. Rows without a doc_id take part and are never the smallest (all null: null).
    The smallest id leaves no ties; an empty table gives none. Columns besides doc_id and text aren't read.
    """
    fps = cut(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(distinct.select("fp"), distance))
    groups = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    lowest = groups.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(groups.select("fp", "root").join(lowest, "root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

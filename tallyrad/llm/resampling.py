"""Importance resampling towards a target distribution.

Features are runs of words, hashed into a fixed number of buckets. The share of every bucket in the raw corpus and in
the target gives its gain, a logarithm in thousandths; a document's weight is the sum of its features' gains. Adding
Gumbel noise to the weights and keeping the highest scores draws documents without replacement in proportion to
their importance. The noise comes from a hash of the id, so the draw can be repeated.

Texts are read as UTF-8 bytes: one table of 256 bytes lower-cases A-Z and turns all other ASCII but digits into
spaces, `split` gives the words, and the checksum of a run is that of the run before it carried on over a space and
the next word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import positions, stored

#: Parameters of the draw: words of the longest run, buckets, seed, percent drawn, and the words that a document needs.
LONGEST_RUN, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Gains of words that a task remembers, and bytes of the longest such word.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64

_TABLE = bytes(
    b if b >= 128 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isupper() else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: digits, letters in lower case, and all that isn't ASCII."""
    return (text or "").encode().translate(_TABLE).split()


def checksums(words: list[bytes], longest: int) -> Iterator[int]:
    """Checksum of every run of 1 to `longest` words, each carried on from the run that is a word shorter."""
    for i in range(len(words)):
        seed = 0
        for j in range(i, min(i + longest, len(words))):
            seed = crc32(words[j] if j == i else b" " + words[j], seed)
            yield seed


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """Features of all texts (column text) by bucket: bucket, n. Each task hands on a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                seen.update(words if longest == 1 else checksums(words, longest))
            for feature, n in seen.items():
                found[(crc32(feature) if longest == 1 else feature) % buckets] += n
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> list[int]:
    """Gain of every bucket, from all raw and all target texts. What comes to the driver are two numbers a bucket."""
    s, t = ({r.bucket: r.n for r in bucket_counts(df, longest, buckets).collect()} for df in (raw, target))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    share = lambda b: (t.get(b, 0) + 1.0) * (all_s + buckets) / ((s.get(b, 0) + 1.0) * (all_t + buckets))
    return [math.floor(1000 * math.log(share(b))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], longest: int = LONGEST_RUN, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document; with `keep` also those columns, in a struct `kept`."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket, whatever the corpus
    own = docs.select("text", "doc_id", *([F.struct(*keep).alias("kept")] if keep else []))
    schema = own.drop("text").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, known = shared.value, {}
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                if longest == 1:
                    total = 0
                    for word in words:
                        if (g := known.get(word)) is None:
                            g = gain[crc32(word) % buckets]
                            if len(known) < REMEMBERED and len(word) <= REMEMBERED_BYTES:
                                known[word] = g
                        total += g
                    n = len(words)
                else:
                    found = [gain[c % buckets] for c in checksums(words, longest)]
                    n, total = len(found), sum(found)
                n_words.append(len(words))
                n_features.append(n)
                weight.append(total)
            numbers = [pa.array(x, pa.int64()) for x in (n_words, n_features, weight)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *numbers], schema.names)

    return own.mapInArrow(weigh, schema)


def noise(seed: int) -> Column:
    """Gumbel noise in thousandths, from a hash of the id (null: as an empty id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS, percent: int = PERCENT,
    least_words: int = LEAST_WORDS, seed: int = SEED, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document with its weight and score, and its rank if it is drawn (null: it isn't).

    docs: doc_id, text; target: text. Returns doc_id, n_features, weight, score, rank, and `kept` (see weights).
    Null and empty texts have no features and weight 0; they and texts under `least_words` words are never drawn.
    Texts of any length count whole. Equal scores go by smaller doc_id (none: last), then by more features; repeated
    rows are drawn one by one. An empty corpus gives no rows; without target texts all gains follow the raw corpus
    alone. Other columns, whatever their names, are neither read nor returned.
    """
    known = gains(docs, target, longest, buckets)
    weighed = weights(docs, known, longest, keep)
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(seed)).withColumn("fit", F.col("n_words") >= least_words))
    draw = percent * scored.where("fit").count() // 100
    ordered = positions(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("n_features"))
    rank = F.when(F.col("position") < draw, F.col("position") + 1)
    return ordered.select("doc_id", "n_features", "weight", "score", rank.alias("rank"), *(["kept"] if keep else []))

"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's own features and those of the lines before and after it score its label,
and neighbouring labels score each other. Forward and backward sums give each line's probability of being
good; their mean, weighted by the lines' lengths, is the document's quality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import byte_parts
from .lines import features

#: Labelled documents that the field is fitted on, on average; chosen by a hash of the id.
SAMPLE = 2400
#: Bytes that a document of a sample has at most, so that what comes to the driver is bounded; longer ones are
#: scored like all others and only not learnt from.
LONGEST = 100_000
STEPS = 250
#: Documents of a sample whose lines are handled at once.
PART = 250


def with_neighbours(table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, and those of the line before and after it in the same document (none: zeros)."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(table), np.zeros_like(table)
    before[1:] = table[:-1]
    before[ends - counts] = 0
    after[:-1] = table[1:]
    after[ends - 1] = 0
    return np.hstack([table, before, after])


class Chains:
    """Chains of lines of several documents, worked on together: place by place, longest chains first."""

    def __init__(self, counts: np.ndarray):
        order = np.argsort(-counts, kind="stable")
        self.first = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        #: How many chains have a line at each place.
        self.active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right") if len(sizes) else []

    def marginals(self, unary: np.ndarray, pair: np.ndarray):
        """Each line's probability of each label, the sum of all pairs' probabilities, and log partition sums.

        unary: (lines, 2) scores; pair: (2, 2) scores of a label and the next line's label.
        """
        ahead, behind = unary.copy(), np.zeros_like(unary)
        for t in range(1, len(self.active)):
            at = self.first[: self.active[t]] + t
            ahead[at] += np.logaddexp(ahead[at - 1, :1] + pair[0], ahead[at - 1, 1:] + pair[1])
        for t in range(len(self.active) - 1, 0, -1):
            at = self.first[: self.active[t]] + t
            x = unary[at] + behind[at]
            behind[at - 1] = np.logaddexp(x[:, :1] + pair[:, 0], x[:, 1:] + pair[:, 1])
        both = ahead + behind
        total = np.logaddexp(both[:, 0], both[:, 1])
        expected = np.zeros((2, 2))
        later = np.ones(len(unary), bool)
        later[self.first] = False
        at = np.flatnonzero(later)
        for i in (0, 1):
            for j in (0, 1):
                p = ahead[at - 1, i] + pair[i, j] + unary[at, j] + behind[at, j] - total[at]
                expected[i, j] = np.exp(p).sum()
        return np.exp(both - total[:, None]), expected, total[self.first].sum()


def fit(texts: list[str | None], labels: list[int], steps: int = STEPS, ridge: float = 1e-3) -> dict:
    """The field that makes the labels of all lines (each its document's) likeliest, by gradient steps."""
    parts = [features(texts[i : i + PART]) for i in range(0, len(texts), PART)]
    table, counts = (np.concatenate([part[k] for part in parts]) for k in (0, 2))
    mean, scale = table.mean(axis=0), table.std(axis=0) + 1e-6
    mean[0], scale[0] = 0, 1
    x = with_neighbours((table - mean) / scale, counts)
    y = np.repeat(np.array(labels), counts)
    chains = Chains(counts)
    # documents count alike, however many lines they have
    observed = np.zeros((2, 2))
    later = np.ones(len(y), bool)
    later[chains.first] = False
    at = np.flatnonzero(later)
    np.add.at(observed, (y[at - 1], y[at]), 1)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, v1, m2, v2 = np.zeros_like(w), np.zeros_like(w), np.zeros_like(pair), np.zeros_like(pair)
    for step in range(1, steps + 1):
        score = x @ w
        unary = np.column_stack([np.zeros(len(score)), score])
        p, expected, _ = chains.marginals(unary, pair)
        g1 = x.T @ (p[:, 1] - y) / len(counts) + ridge * w
        g2 = (expected - observed) / len(counts) + ridge * pair
        rate = 0.1 * min(1.0, 4 * (1 - step / (steps + 1)))
        for value, g, m, v in ((w, g1, m1, v1), (pair, g2, m2, v2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w, "pair": pair}


def line_marginals(texts: list[str | None], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of being good of every line, its size, and the number of lines of each text."""
    table, size, counts = features(texts)
    score = with_neighbours((table - model["mean"]) / model["scale"], counts) @ model["w"]
    p, _, _ = Chains(counts).marginals(np.column_stack([np.zeros(len(score)), score]), model["pair"])
    return p[:, 1], size, counts


def quality(texts: list[str | None], model: dict) -> np.ndarray:
    p, size, counts = line_marginals(texts, model)
    weight, doc = size + 1, np.repeat(np.arange(len(texts)), counts)
    return np.bincount(doc, p * weight, len(texts)) / np.bincount(doc, weight, len(texts))


def sample_of(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """About `size` documents with a label, half of each label where there are enough: doc_id, text, label.

    The sample is drawn from the labels, by a hash of the id, before texts are read, so what is broadcast has
    about `size` rows whatever the corpus; of repeated labels of a document the highest counts, and of repeated
    ids of documents the greatest text. Documents over LONGEST bytes aren't taken.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    share = F.coalesce(*[F.when(F.col(label) == k, size / 2 / n) for k, n in counts.items()], F.lit(0.0))
    chosen = rows.where(place < share)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", label).agg(F.max("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A field fitted on about `sample` of the documents that labels (doc_id, quality) name; none if there are
    none. Both labels are 0 or 1."""
    rows = sample_of(docs, labels, "quality", sample).orderBy("doc_id").toPandas()
    return fit(rows["text"].tolist(), rows["quality"].astype(int).tolist()) if len(rows) else None


def classify(docs: DataFrame, model: dict | None, into: str = "score") -> DataFrame:
    """The rows of `docs` with a score, a double from 0 to 1, in a column named `into`; columns besides doc_id and
    text pass unread, and one that is named `into` is replaced.

    Null and empty texts are one empty line and get that line's score. Without a model every score is 0.5. Texts of
    any length are scored whole; repeated rows stay and score alike, so there are no ties to break; an empty table
    gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(into)
    place = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_parts(batch, place):
                texts = part.column(place).to_pylist()
                found = np.full(len(texts), 0.5) if shared.value is None else quality(texts, shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, into])

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add(into, DoubleType()))

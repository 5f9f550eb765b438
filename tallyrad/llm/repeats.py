"""Removal of byte strings that occur more than once anywhere in a corpus.

A byte goes if a string of 200 bytes that covers it also starts somewhere else. Only suffixes that begin at
anchors are looked at (see anchors.py): all strings that share an anchor are one interval of starts.

1. Intervals of the whole corpus meet by their anchor's gram. One whose gram is alone holds no repeat; one whose
   whole context occurs twice is all repeats, by two digests of 64 bits. The rest is undecided.
2. The undecided suffixes of each shard, with what precedes them, are its transform. Transforms are merged gram
   by gram by interleave refinement, which gives common prefixes and so the strings that repeat, by their bytes
   (see transforms.py).
3. A gram that very many undecided suffixes begin with isn't merged in one place: its strings are counted by
   their digests, which Spark sums before it shuffles.

A repeated interval that shares its gram with an undecided one goes on as well, once for each content, so that
the merge misses no partner. Texts are dealt out once, into buckets, and stay there; after that hashes travel, and
contexts of under 370 bytes of what is undecided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .anchors import LENGTH, PART, WIDTH, find, mixed
from .common import bucketed, stored
from .transforms import repeated_strings

REPEATED, OPEN, BOTH = 1, 2, 3
#: Undecided suffixes with one gram, up to which they are merged in one place.
HOT = 8192
#: Rows merged at once, and rows of one gram that step 1 holds.
MERGED, HELD = 16_384, 16_384
#: Anchors of which contexts are cut at once, and of which strings are digested at once: their contexts are one part.
CUT = 5_000
DIGESTED = PART // (LENGTH + WIDTH - 1)

CANDIDATE = "deal long, gram long, whole long, again long, row long, low int, high int, place int, state int"
DECIDED = "gram long, row long, low int, high int, place int, state int"
CONTEXT = "gram long, row long, low int, high int, place int, context binary"
START = "one long, two long, row long, low int"
REPEAT = "row long, low int, high int"

Columns = tuple[np.ndarray, ...]


def _batch(columns: Columns, schema: str) -> pa.RecordBatch:
    kinds = [(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.int32()) for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k.to_pandas_dtype(), copy=False), k)
            for c, (_, k) in zip(columns, kinds)
        ],
        [n for n, _ in kinds],
    )


def candidates(a: anchors.Anchors, row: np.ndarray) -> pa.RecordBatch:
    """Intervals of one batch. Of those that are equal in it two are compared with other batches; the others
    are repeats already, and are dealt out evenly rather than by their gram."""
    order = np.lexsort((a.again, a.whole, a.gram))
    same = np.zeros(len(order), bool)
    if len(order) > 2:
        same[2:] = True
        for x in (a.gram, a.whole, a.again):
            same[2:] &= x[order[2:]] == x[order[:-2]]
    state = np.zeros(len(order), np.int32)
    state[order[same]] = REPEATED
    deal = np.where(state == REPEATED, mixed(row.astype(np.uint64)), a.gram)
    return _batch((deal, a.gram, a.whole, a.again, row, a.first, a.last, a.place, state), CANDIDATE)


def judged(c: Columns, more: bool) -> pa.RecordBatch:
    """Repeated, open or both, of whole contents in order; what holds no repeat is dropped. c: gram, whole, again,
    row, low, high, place. more: the first gram has other contents besides."""
    gram, whole, again = c[:3]
    new_gram = np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= (whole[1:] != whole[:-1]) | (again[1:] != again[:-1])
    group, one = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    twice = np.bincount(one)[one] > 1
    contents = np.bincount(group, weights=new)
    contents[:1] += more
    several = contents[group] > 1
    state = np.where(twice, REPEATED, np.where(several, OPEN, 0))
    state[twice & new & several] = BOTH
    kept = state > 0
    return _batch(tuple(x[kept] for x in (gram, *c[3:], state)), DECIDED)


def streamed(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """States of rows that come sorted by gram and content. A gram's rows are let go content by content, so that
    about `most` of them are held at once."""
    held, more = None, False
    for batch in batches:
        c = tuple(x.to_numpy(zero_copy_only=False) for x in batch.columns[1:])
        known = c[-1] == REPEATED
        if known.any():
            yield _batch(tuple(x[known] for x in (c[0], *c[3:])), DECIDED)
        c = tuple(x[~known] for x in c[:-1])
        if held is not None:
            c = tuple(np.concatenate(pair) for pair in zip(held, c))
        if not len(c[0]):
            continue
        start = int(np.searchsorted(c[0], c[0][-1]))
        if start:
            yield judged(tuple(x[:start] for x in c), more)
            c, more = tuple(x[start:] for x in c), False
        if len(c[0]) > most:
            change = np.flatnonzero((c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            if len(change):
                yield judged(tuple(x[: change[-1]] for x in c), True)
                c, more = tuple(x[change[-1] :] for x in c), True
            # of one content two stay, and what they are comes out at its end
            yield _batch((c[0][2:], *(x[2:] for x in c[3:]), np.full(max(0, len(c[0]) - 2), REPEATED)), DECIDED)
            c = tuple(x[:2] for x in c)
        held = c
    if held is not None and len(held[0]):
        yield judged(held, more)


def decide(rows: DataFrame) -> DataFrame:
    """Step 1: the states of all intervals."""
    return rows.repartition("deal").sortWithinPartitions("gram", "whole", "again").mapInArrow(streamed, DECIDED)


def anchored(texts: DataFrame) -> DataFrame:
    """The intervals of all texts, decided as far as grams and whole contexts can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = find([(t or "").encode() for t in batch.column(1).to_pylist()])
            yield candidates(a, batch.column(0).to_numpy()[a.row])

    return decide(texts.select("row", "text").mapInArrow(run, CANDIDATE))


def _open_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[bytes], Columns]]:
    """For up to CUT open intervals at a time of a batch (row, text, open): row ids, contexts, and the columns
    gram, low, high, place."""
    lists = batch.column(2)
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    items, ids = lists.flatten(), batch.column(0).to_numpy()
    columns = tuple(items.field(k).to_numpy(zero_copy_only=False) for k in ("gram", "low", "high", "place"))
    data = [t.encode() for t in batch.column(1).to_pylist()]
    for at in range(0, len(of), CUT):
        part = tuple(c[at : at + CUT] for c in columns)
        own = of[at : at + CUT]
        yield ids[own], [data[k][a : b + LENGTH] for k, a, b in zip(own.tolist(), part[1].tolist(), part[2].tolist())], part


def transforms(rows: DataFrame) -> DataFrame:
    """Step 2, each shard: its undecided suffixes and what precedes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, contexts, (gram, low, high, place) in _open_of(batch):
                found = _batch((gram, row, low, high, place), CONTEXT.rsplit(", ", 1)[0])
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(contexts, pa.binary())], [*found.schema.names, "context"])

    return rows.mapInArrow(run, CONTEXT)


def merged(contexts: DataFrame) -> DataFrame:
    """Step 2, all shards: the strings that repeat. Grams here have at most HOT suffixes each."""

    def strings(batch: pa.Table) -> pa.RecordBatch:
        gram, row, low, high, place = (batch.column(k).to_numpy().astype(np.int64) for k in range(5))
        at, first, last = repeated_strings(gram, batch.column(5).to_pylist(), low, high, place)
        return _batch((row[at], first, last), REPEAT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; whole grams are merged, many together."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= MERGED:
                rows = pa.Table.from_batches(held)
                gram = rows.column(0).to_numpy()
                start = int(np.searchsorted(gram, gram[-1]))
                if start:
                    yield strings(rows.slice(0, start))
                held = rows.slice(start).combine_chunks().to_batches()
        if held:
            yield strings(pa.Table.from_batches(held))

    return contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, REPEAT)


def counted(rows: DataFrame) -> DataFrame:
    """Step 3: the strings of hot grams that occur twice, by two digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, contexts, (_, low, high, _) in _open_of(batch):
                for at in range(0, len(row), DIGESTED):
                    part = slice(at, at + DIGESTED)
                    n = (high[part] - low[part] + 1).astype(np.int64)
                    data = np.frombuffer(b"".join(contexts[part]), np.uint8)
                    sizes = n + LENGTH - 1
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    start = inner + np.repeat(np.cumsum(sizes) - sizes, n)
                    one, two = (anchors.Rolling(data, which).at(start, start + LENGTH) for which in (0, 1))
                    yield _batch((one, two, np.repeat(row[part], n), inner + np.repeat(low[part], n)), START)

    starts = rows.mapInArrow(run, START)
    twice = starts.groupBy("one", "two").count().where("count > 1").drop("count")
    return starts.join(twice, ["one", "two"]).select("row", "low", F.col("low").alias("high"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """For every row: doc_id, n_bytes, spans (array of start, end in bytes of the text in UTF-8, end
    exclusive, in order, apart) that are removed, kept (binary: the bytes that stay).

    Null and empty texts have no bytes, texts under 200 bytes keep all of theirs, and repeated rows are
    each other's repeats. Matches never cross rows. Strings are judged on the input, so there are no ties. Texts
    of any length are taken whole, in parts that overlap. An empty table gives none. Columns besides doc_id and
    text, whatever their names, aren't read.
    """
    texts = bucketed(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "row")
    ones = stored(anchored(texts))
    undecided = ones.where(F.col("state") >= OPEN)
    hot = undecided.groupBy("gram").count().where(F.col("count") > HOT).select("gram", F.lit(True).alias("hot"))
    marked = undecided.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))

    def with_texts(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("row").agg(F.collect_list(F.struct("gram", "low", "high", "place")).alias("open"))
        return texts.join(lists.hint("shuffle_hash"), "row").select("row", "text", "open")

    repeats = (
        ones.where(F.col("state").isin(REPEATED, BOTH))
        .select("row", "low", "high")
        .unionByName(merged(transforms(with_texts(marked.where(~F.col("hot"))))))
        .unionByName(counted(with_texts(marked.where("hot"))))
        .groupBy("row")
        .agg(F.collect_list(F.struct("low", "high")).alias("repeats"))
    )
    rows = texts.join(repeats.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "repeats")
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept = [], [], []
            lists = batch.column(2)
            offsets, items = lists.offsets.to_numpy(), lists.values
            low, high = (items.field(k).to_numpy(zero_copy_only=False) for k in ("low", "high"))
            for k, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                a, b = offsets[k], offsets[k + 1]
                found, rest = covered(low[a:b], high[a:b], data) if b > a else ([], data)
                sizes.append(len(data))
                spans.append(found)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return rows.mapInArrow(run, schema)


def covered(low: np.ndarray, high: np.ndarray, data: bytes) -> tuple[list[dict], bytes]:
    """Spans that strings starting at low..high cover, and the bytes of data outside of them."""
    order = np.argsort(low, kind="stable")
    start, end = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64) + LENGTH)
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    starts = start[fresh]
    ends = end[np.append(np.flatnonzero(fresh)[1:] - 1, len(end) - 1)]
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return [{"start": int(a), "end": int(b)} for a, b in zip(starts, ends)], b"".join(kept)

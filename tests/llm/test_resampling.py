"""Importance resampling against a plain version, on rows with odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tallyrad.llm import resampling

SCHEMA = "doc_id long, text string, weight string, rank string"


def plain(docs, target, longest, buckets, percent, least, seed):
    def features(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return words, [" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + longest, len(words)) + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append((len(words) >= least, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(found), weight))
    fit = sorted((r for r in rows if r[0]), key=lambda r: (-r[1], r[2] is None, r[2] or 0, -r[3]))
    drawn = fit[: percent * len(fit) // 100]
    out = [(r[2], r[3], r[4], r[1], k + 1) for k, r in enumerate(drawn)]
    rest = fit[len(drawn) :] + [r for r in rows if not r[0]]
    return sorted(out + [(r[2], r[3], r[4], r[1], None) for r in rest], key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_like_the_plain_version(spark, longest):
    r = random.Random(3)
    words = ["the", "THE", "of", "é", "ÀB", "x1", "日本", "a-b", "q\x7fr", "v\x00w"]
    texts = [None, "", "  ", "!?", "word " * 50_000, "Ä" * 3000] + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(None, "the of " * 20), (7, texts[7]), (7, texts[7]), (8, "the the the"), (-3, "of " * 30)]
    target = ["the x1 x1", None, "日本 " * 5]
    frame = spark.createDataFrame([(i, t, "clash", None) for i, t in docs], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(frame, goal, longest=longest, buckets=97, percent=30, seed=5)
    want = plain(docs, target, longest, 97, 30, resampling.LEAST_WORDS, 5)
    assert sorted((tuple(x) for x in got.collect()), key=str) == want


def test_drawn_rows_carry_what_is_kept(spark):
    docs = spark.createDataFrame([(i, "the of " * 12, "w", "r") for i in range(40)], SCHEMA)
    got = resampling.resample(docs, docs, keep=("text", "weight")).where("rank is not null").orderBy("rank").collect()
    assert [x["rank"] for x in got] == [1, 2, 3, 4] and {x.kept.text for x in got} == {"the of " * 12} and got[0].kept.weight == "w"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "the of " * 12, None, None)] * 10, SCHEMA)
    assert resampling.resample(none, some).count() == 0
    rows = resampling.resample(some, none).collect()
    assert len(rows) == 10 and sum(x["rank"] is not None for x in rows) == 1  # repeated rows are drawn one by one

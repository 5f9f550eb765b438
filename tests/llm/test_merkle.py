"""The Merkle manifest against a plain one, for trees of many sizes."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tallyrad.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root int, path string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def climb(nodes):
    """The root over nodes and the path of each."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, at in enumerate(own):
            run, place = runs[at // 16], at % 16
            paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
        nodes, own = [H(*run) for run in runs], [at // 16 for at in own]
    return nodes[0] if nodes else None, paths


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub, found = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = climb([leaf(r) for r in own])
        sub.append(root)
        found.append(list(zip(own, paths)))
    root, tops = climb(sub)
    return sorted(((r[0], r[1], leaf(r), sub[k], root, p + tops[k]) for k, rows in enumerate(found) for r, p in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("sizes", [[1], [3], [16], [17], [1, 16, 17, 256, 257, 700], [1] * 40 + [5000]])
def test_like_the_plain_manifest(spark, sizes):
    rows = [(i * 7 % 10007, f"s{k}é" if k else None, None if i % 3 else "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    got = merkle.manifest(frame(spark, rows)).collect()
    found = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path]) for r in got), key=str)
    assert found == plain(rows)


def test_odd_rows(spark):
    same = (4, "s", "en", 3, "abc")
    rows = [(None, "s", None, None, None), (None, None, "", 0, ""), same, same, (4, "s", "en", 3, "abd"), (5, "", "x", 1, "é" * 200_000), (-2, "s", "en", 1, "\x00-")]
    got = merkle.manifest(frame(spark, rows))
    found = sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path]) for r in got.collect()), key=str)
    assert found == plain(rows)
    folded = got.select(merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), "root", merkle.fold(F.lit("0" * 64), F.col("path")).alias("wrong")).collect()
    assert all(r.folded == r.root != r.wrong for r in folded)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_the_query_tells_what_was_tampered_with(spark, tmp_path):
    import zlib

    rows = [(i, f"s{i % 3}", "en", 5, "Abc" if i % 2 else "abc" if i % 4 else None) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {r[0]: r for r in plain(rows)}
    for r in queries.op11_merkle(spark, str(tmp_path)).collect():
        _, _, own, sub, root, path = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (own, sub, root, H(*[a + b for a, b in path]))
        row = rows[r.doc_id]
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and row[4]:
            own = leaf((*row[:4], re.sub("[A-Z]", lambda m: m.group().lower(), row[4])))
        for a, b in path:
            own = H(a, own, b)
        assert r.folded_root == own and r.verified == (own == root)

from collections import defaultdict

import numpy as np
import pytest

from tallyrad.llm import topk


def found(df, every):
    got = defaultdict(list)
    for x in topk.top_k(df, every=every).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    return got


@pytest.mark.parametrize("block", [600, 4000, topk.BLOCK_BYTES])
def test_like_brute_force(spark, monkeypatch, block):
    """Many small blocks and groups, some, and one; rows that take no part, other lengths, repeated vectors."""
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    r = np.random.default_rng(2)
    vectors = np.round(r.normal(size=(160, 6)) * (1 + r.integers(0, 3, (160, 1))), 2).astype(np.float32)
    vectors[50:60] = vectors[3]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(500, None, "x"), (600, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (700, [float("nan")] * 6, "x"), (None, [1.0] * 6, "x"), (800, [], "x"), (801, [], "x"), (900, [1.0, 2.0], "x")]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4), 20)
    whole = np.floor(vectors.astype(float) * 1024).astype(np.int64)
    for q in range(0, 160, 20):
        want = sorted((-s, i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        assert got[q] == [(i, -s) for s, i in want]
    assert got[800] == [(801, 0)] and set(got) == {*range(0, 160, 20), 800}


def test_one_dimension_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(i, [1.0]) for i in range(0, 5)] + [(0, [1.0])], "vec_id long, embedding array<float>")
    rows = topk.top_k(df).orderBy("rank", "vec_id").collect()
    assert len(rows) == 10 and {x.score for x in rows} == {1024 * 1024}


def test_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(few).count() == 0


def test_scores_beyond_doubles(spark):
    big = [[2.0**40, 3.0], [2.0**40 + 2**20, -1.0], [2.0**39, 5.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    # products beyond 64 bits are outside the contract; these fit
    small = df.selectExpr("vec_id", "transform(embedding, x -> x / 1048576) as embedding")
    whole = [[int(np.floor(1024 * c / 1048576)) for c in v] for v in big]
    got = found(small, 3)[0]
    assert got == sorted(((i, sum(a * b for a, b in zip(whole[0], whole[i]))) for i in (1, 2)), key=lambda p: (-p[1], p[0]))


def share_compared(x, queries, least=None, k=10):
    """The share of all pairs that the walk compares; what it finds is checked."""
    mine = topk.Part(queries, np.arange(len(queries)), np.arange(len(queries)) + (1 << 20), topk.QUERIES)
    found = topk.Search(mine, topk.Part(x, np.arange(len(x)), np.arange(len(x))), k, least).run()
    want = np.sort(queries @ x.T, axis=1)[:, ::-1][:, :k]
    assert (found.scores == want).all()
    return found.compared / (len(x) * len(queries))


def test_pruning_on_clusters_and_not_on_uniform_vectors():
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 16)) * 1000
    clusters = (centres[r.integers(0, 40, 6000)] + r.normal(size=(6000, 16)) * 20).astype(np.int64)
    uniform = r.normal(size=(6000, 64))
    uniform = (uniform / np.linalg.norm(uniform, axis=1, keepdims=True) * 1024).astype(np.int64)
    near, far = share_compared(clusters, clusters[::60].copy()), share_compared(uniform, uniform[::60].copy())
    print(f"compared: {near:.3f} of the pairs of clusters, {far:.3f} of uniform ones")
    assert near < 0.3 and far <= 1.0


def test_carried_scores_prune_more_and_lose_nothing():
    r = np.random.default_rng(5)
    centres = r.normal(size=(30, 8)) * 1000
    x = (centres[r.integers(0, 30, 4000)] + r.normal(size=(4000, 8)) * 20).astype(np.int64)
    queries = x[::40].copy()
    kth = np.sort(queries @ x.T, axis=1)[:, -10]
    assert share_compared(x, queries, kth) <= share_compared(x, queries) < 0.3


def test_tree_covers_its_points():
    r = np.random.default_rng(6)
    x = r.normal(size=(3000, 3))
    tree = topk.Tree.built(x, *topk.VECTORS)

    def under(node):
        points = tree.points_of(node) if tree.leaf(node) else np.concatenate([under(c) for c in tree.children(node)])
        assert np.linalg.norm(x[points] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-6
        return points

    assert sorted(under(0)) == list(range(3000)) and len(tree.centre) > 20

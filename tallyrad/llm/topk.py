"""Exact top-k search by inner product with two cover trees.

Vectors are dealt into blocks around pivots, and queries into groups; each gets a cover tree, built once. Every group
first meets the block nearest to it, which gives its queries a worst kth score. After that a group meets only blocks
that can do better by their centre and radius, with those scores carried along. Where a group and a block meet, both
trees are walked together. A pair of nodes can't do better than the product of their centres plus what their radii
allow; it is left out if that is less than the worst kth score among the node's queries.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of the vectors in a block, and of the queries in a group, on average.
BLOCK_BYTES = 16_000_000
#: Vectors of each length that blocks are dealt around, at most.
PIVOTS = 256
#: Points of a leaf, and for how many points of a node there may be one centre at the next level, in trees of vectors
#: and of queries. A node that would need more centres stays a leaf: where distances are all alike, as in many
#: dimensions, smaller balls hold one point each and prune nothing.
VECTORS, QUERIES = (48, 12), (8, 2)
#: Each level of a tree covers its points with balls this much smaller.
SHRINK = 0.8
NONE = np.iinfo(np.int64).min
NONE_LAST = NONE + 1

PACKED = "size int, part string, n long, centre array<double>, radius double, tree binary"
RESULT = "group string, row long, query_id long, vec_id long, score long"


class Tree:
    """A cover tree over the rows of x. Centres of one level under a node are farther apart than the level's radius
    and cover the node's points within it; a node's centre is also its first child's. Nodes are numbered: their
    centres, radii, children (first, end) and, of leaves, points (a stretch of `points`)."""

    NAMES = ("centre", "radius", "child", "child_end", "start", "end", "points")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for name in self.NAMES:
            setattr(self, name, arrays[name])

    @staticmethod
    def built(x: np.ndarray, leaf: int, crowd: int) -> Tree:
        squares = np.einsum("ij,ij->i", x, x)

        def distances(centre: int, points: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares[points] + squares[centre] - 2 * (x[points] @ x[centre]), 0))

        every = np.arange(len(x))
        near = distances(0, every)
        centre, radius, child, child_end, start, end = [0], [float(near.max())], [0], [0], [0], [0]
        order, held, todo = [], 0, [(0, every, near)]
        while todo:
            node, points, near = todo.pop()
            rest, found = points, []
            if len(points) > leaf and radius[node] > 0:
                within, at = radius[node] * SHRINK, centre[node]
                while len(rest) and len(found) <= len(points) // crowd:
                    inside = near <= within
                    found.append((at, float(near[inside].max(initial=0)), rest[inside], near[inside]))
                    rest = rest[~inside]
                    if len(rest):
                        at = int(rest[0])
                        near = distances(at, rest)
            if not found or len(rest):
                start[node], end[node] = held, held + len(points)
                order.append(points)
                held += len(points)
                continue
            child[node], child_end[node] = len(centre), len(centre) + len(found)
            for at, far, inside, near in found:
                todo.append((len(centre), inside, near))
                for values, value in zip((centre, radius, child, child_end, start, end), (at, far, 0, 0, 0, 0)):
                    values.append(value)
        columns = (centre, radius, child, child_end, start, end, np.concatenate(order))
        return Tree({name: np.array(values) for name, values in zip(Tree.NAMES, columns)})

    def leaf(self, node: int) -> bool:
        return self.child_end[node] == 0

    def children(self, node: int) -> np.ndarray:
        return np.arange(self.child[node], self.child_end[node])

    def points_of(self, node: int) -> np.ndarray:
        return self.points[self.start[node] : self.end[node]]


class Part:
    """Some vectors of whole numbers with their ids and rows, and their tree."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, tree: Tree | tuple[int, int] = VECTORS):
        self.whole, self.x, self.ids, self.rows = x, x.astype(np.float64), ids, rows
        self.tree = tree if isinstance(tree, Tree) else Tree.built(self.x, *tree)

    def packed(self) -> bytes:
        out, widest = io.BytesIO(), int(np.abs(self.whole).max(initial=0))
        x = self.whole.astype(np.int16) if widest < 1 << 15 else self.whole
        np.savez(out, x=x, ids=self.ids, rows=self.rows, **{n: getattr(self.tree, n) for n in Tree.NAMES})
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Part:
        with np.load(io.BytesIO(data)) as found:
            arrays = {n: found[n] for n in found.files}
        x = arrays["x"].astype(np.int64)
        return Part(x, arrays["ids"], arrays["rows"], Tree(arrays))


class Search:
    """The k best vectors for each query. least: scores that a query's kth is known to reach."""

    def __init__(self, queries: Part, vectors: Part, k: int, least: np.ndarray | None = None):
        self.q, self.v, self.k = queries, vectors, k
        widest = max(np.abs(queries.whole).max(initial=0), 1), max(np.abs(vectors.whole).max(initial=0), 1)
        #: Whole numbers in doubles stay exact below 2**53; larger ones are multiplied as Python's.
        self.exact = float(widest[0]) * float(widest[1]) * queries.x.shape[1] < 2.0**53
        self.scores = np.full((len(queries.x), k), NONE)
        self.found = np.zeros((len(queries.x), k), np.int64)
        self.least = np.full(len(queries.x), NONE) if least is None else least
        self.q_size, self.v_size = np.linalg.norm(queries.x, axis=1), np.linalg.norm(vectors.x, axis=1)
        self.slack = 1e-9 * float(self.q_size.max(initial=0)) * float(self.v_size.max(initial=0)) + 1e-6
        #: Of each query node, the worst kth score among its queries.
        self.worst = np.full(len(queries.tree.centre), NONE)
        self.compared = 0

    def most(self, a: int, others: np.ndarray) -> np.ndarray:
        """What the products of a's queries with the vectors under each of the others can't exceed."""
        q, v = self.q.tree, self.v.tree
        centres, radii = v.centre[others], v.radius[others]
        product = self.v.x[centres] @ self.q.x[q.centre[a]]
        return product + radii * (self.q_size[q.centre[a]] + q.radius[a]) + q.radius[a] * self.v_size[centres] + self.slack

    def run(self) -> Search:
        if len(self.q.x) and len(self.v.x):
            for node in range(len(self.worst) - 1, -1, -1):  # children have higher numbers
                own = self.least[self.q.tree.points_of(node)] if self.q.tree.leaf(node) else self.worst[self.q.tree.children(node)]
                self.worst[node] = own.min()
            if self.most(0, np.array([0]))[0] >= self.worst[0]:
                self.walk(0, 0)
        return self

    def walk(self, a: int, b: int) -> None:
        q, v = self.q.tree, self.v.tree
        if q.leaf(a) and v.leaf(b):
            self.compare(a, b)
        elif v.leaf(b) or (not q.leaf(a) and q.radius[a] > v.radius[b]):
            for child in q.children(a).tolist():
                if self.most(child, np.array([b]))[0] >= self.worst[child]:
                    self.walk(child, b)
            self.worst[a] = self.worst[q.children(a)].min()
        else:
            children = v.children(b)
            most = self.most(a, children)
            for i in np.argsort(-most, kind="stable"):
                if most[i] < self.worst[a]:
                    break
                self.walk(a, int(children[i]))

    def compare(self, a: int, b: int) -> None:
        mine, theirs = self.q.tree.points_of(a), self.v.tree.points_of(b)
        self.compared += len(mine) * len(theirs)
        if self.exact:
            scores = (self.q.x[mine] @ self.v.x[theirs].T).astype(np.int64)
        else:
            scores = self.q.whole[mine].astype(object).dot(self.v.whole[theirs].astype(object).T).astype(np.int64)
        scores[self.q.rows[mine][:, None] == self.v.rows[theirs]] = NONE
        n, ids = scores.shape[1], self.v.ids[theirs]
        least = np.partition(scores, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.full(len(scores), NONE)
        least = np.maximum(np.maximum(least, self.scores[mine, -1]), self.least[mine])
        for row, query in enumerate(mine):
            good = np.flatnonzero((scores[row] >= least[row]) & (scores[row] > NONE))
            if len(good):
                have, names = np.append(self.scores[query], scores[row, good]), np.append(self.found[query], ids[good])
                best = np.lexsort((names, np.where(have == NONE, -NONE_LAST, -have)))[: self.k]
                self.scores[query], self.found[query] = have[best], names[best]
        self.worst[a] = np.maximum(self.scores[mine, -1], self.least[mine]).min()


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """row, vec_id, x: each component as floor(scale * component). Rows without an id, and vectors that are
    null or hold null or non-finite components, are left out."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.size("embedding").alias("size"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale)).alias("x"),
    )


def _pivots(known: DataFrame, counts: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length, vectors drawn by a hash of the row, about one for each block and at most about PIVOTS; with
    one block there are none. So their bytes are bounded, or a small share of the vectors'."""
    wanted = {size: min(PIVOTS, n * size * 8 // BLOCK_BYTES) for size, n in counts.items()}
    shares = {size: want / counts[size] for size, want in wanted.items() if want > 1}
    if not shares:
        return {}
    place = F.pmod(F.xxhash64("row", F.lit("pivot")), F.lit(1 << 30)) / (1 << 30)
    share = F.coalesce(*[F.when(F.col("size") == size, s) for size, s in shares.items()], F.lit(0.0))
    rows = known.where(place < share).select("size", "x").toPandas()
    return {int(size): np.stack(x.to_numpy()).astype(np.float64) for size, x in rows.groupby("size")["x"]}


def packed(known: DataFrame, pivots: dict[int, np.ndarray], shape: tuple[int, int]) -> DataFrame:
    """One row for each block: size, part, centre, radius, tree (the vectors with their tree). Vectors go to their
    nearest pivot; what a pivot has beyond a block is dealt out by a hash of the row."""
    shared = known.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int32)
            for size, at in batch.groupby("size").indices.items():
                if size in shared.value:
                    p = shared.value[size]
                    x = np.stack(batch["x"].to_numpy()[at]).astype(np.float64)
                    cell[at] = (2 * x @ p.T - np.einsum("ij,ij->i", p, p)).argmax(axis=1)
            yield batch.assign(cell=cell)[["size", "cell", "row", "vec_id", "x"]]

    schema = "size int, cell int, row long, vec_id long, x array<long>"
    celled = stored(known.mapInPandas(nearest, schema)) if pivots else known.withColumn("cell", F.lit(0))
    parts = F.ceil(F.col("n") * F.greatest("size", F.lit(1)) * 8 / BLOCK_BYTES).cast("int")
    cells = celled.groupBy("size", "cell").agg(F.count("*").alias("n")).select("size", "cell", parts.alias("parts"))
    dealt = celled.join(cells, ["size", "cell"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(key[0])
        x = np.stack(rows["x"].to_numpy()).astype(np.int64) if size else np.zeros((len(rows), 0), np.int64)
        part = Part(x, rows["vec_id"].to_numpy(), rows["row"].to_numpy(), shape)
        columns = (size, ":".join(map(str, key)), len(x), part.x[part.tree.centre[0]], float(part.tree.radius[0]), part.packed())
        return pd.DataFrame({c.split()[0]: [value] for c, value in zip(PACKED.split(", "), columns)})

    return stored(dealt.groupBy("size", "cell", "salt").applyInPandas(block, PACKED))


def top_k(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest inner products.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all rows but the query's own, of
    the same length; vectors without components score 0 with each other. Ties go to the smaller vec_id. With fewer
    candidates than k all are returned. A repeated row is a candidate, and as a query it gets its own k rows. An
    empty table gives none. Columns besides vec_id and embedding, whatever their names, aren't read.
    """
    known = stored(whole_vectors(vectors.select("vec_id", "embedding")))
    asked = known.where(F.col("vec_id") % every == 0)
    n, m = ({r["size"]: r["count"] for r in df.groupBy("size").count().collect()} for df in (known, asked))
    pivots = _pivots(known, n)
    blocks = packed(known, pivots, VECTORS)
    # groups of queries are dealt around as many pivots as there are groups
    few = {size: p[: max(1, m.get(size, 0) * size * 8 // BLOCK_BYTES)] for size, p in pivots.items()}
    groups = packed(asked, few, QUERIES)

    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    product = F.aggregate(F.zip_with("q", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    most = product + F.col("radius") * (norm(F.col("q")) + F.col("reach")) + F.col("reach") * norm(F.col("centre"))
    outer = groups.select("size", F.col("part").alias("group"), F.col("centre").alias("q"), F.col("radius").alias("reach"))
    pairs = (
        blocks.select("size", "part", "centre", "radius")
        .join(outer, "size")
        .select("part", "group", (most + F.abs(most) * 1e-9 + 1).alias("most"), product.alias("near"))
    )
    first = pairs.groupBy("group").agg(F.max_by("part", F.struct("near", "part")).alias("part"))

    def searched(chosen: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """The best of each chosen (group, part), each side of a pair in one packed row. least: group and worst, pairs
        of a query's row and its kth score so far."""
        left = groups.select(F.col("part").alias("group"), "tree")
        if least is None:
            left = left.withColumn("worst", F.lit(None).cast("array<struct<row:long,score:long>>"))
        else:
            left = left.join(least.select("group", "worst"), "group", "left")
        left = chosen.join(left, "group").select("group", "part", "tree", "worst")
        right = chosen.join(blocks.select("part", F.col("tree").alias("block")), "part").select(
            F.col("group").alias("to"), F.col("part").alias("at"), "block"
        )

        def search(key: tuple, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            q, v = Part.unpacked(queries["tree"].iloc[0]), Part.unpacked(block["block"].iloc[0])
            worst, floor = queries["worst"].iloc[0], None
            if worst is not None:
                score = {w["row"]: w["score"] for w in worst}
                floor = np.array([score.get(row, NONE) for row in q.rows.tolist()], np.int64)
            found = Search(q, v, k, floor).run()
            at, rank = np.nonzero(found.scores != NONE)
            columns = (key[0], q.rows[at], q.ids[at], found.found[at, rank], found.scores[at, rank])
            return pd.DataFrame({c.split()[0]: value for c, value in zip(RESULT.split(", "), columns)})

        return left.groupBy("group", "part").cogroup(right.groupBy("to", "at")).applyInPandas(search, RESULT)

    near = stored(searched(first))
    kth = near.groupBy("group", "row").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    least = kth.groupBy("group").agg(
        F.collect_list(F.struct("row", "score")).alias("worst"), F.min("score").alias("low"), F.count("*").alias("known")
    )
    sizes = groups.select(F.col("part").alias("group"), F.col("n").alias("queries"))
    able = (F.col("known") == F.col("queries")) & (F.col("most") < F.col("low"))
    others = pairs.join(least.select("group", "low", "known"), "group", "left").join(sizes, "group")
    others = others.where(~F.coalesce(able, F.lit(False))).join(first, ["group", "part"], "left_anti").select("group", "part")
    best = near.unionByName(searched(others, least))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

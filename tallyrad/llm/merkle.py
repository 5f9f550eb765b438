"""Merkle manifest of a dataset: a digest of every row, trees over them, and a proof of membership for each row.

Rows of one group (a source) are ranked, and a rank's digits in base FAN say where its leaf hangs. Digit columns are
grouped away one after another, the last first, and each grouping nests the structs of its children; all of it
happens within blocks of FAN ** DIGITS ranks, so no nested struct outgrows a block and one shuffle serves all digits.
Where a tree has more than one block, the blocks' nodes are ranks of a further tier. Proofs need no join: the path
above a block meets the block's struct in a grouping, and transforms and an explode give every leaf its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import positions, stored

#: Children of a node, digits of a rank within one block, and what a leaf says of a row.
FAN, DIGITS = 16, 2
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ranks are told from the places of all rows by stretches of so many rows.
STRETCH = 4096
PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: tuple[str, ...] = COLUMNS, **other: Column) -> Column:
    """The digest of a row: of each column its size in bytes, a colon and its value, or `-` if it is null. `other`
    has what stands in the place of a column."""
    values = [other.get(c, F.col(c)).cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda node, p: digest(F.concat(p["left"], node, p["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _ranked(rows: DataFrame) -> DataFrame:
    """rows (tree, node, item, and `by` to order them) with their rank in their tree."""
    placed = positions(rows, "tree", F.asc_nulls_first("by"), "node").withColumn("stretch", F.expr(f"position div {STRETCH}"))
    # a tree's first place, of the first places in each stretch: one row for a tree and stretch, however large a tree
    firsts = placed.groupBy("stretch", "tree").agg(F.min("position").alias("first"))
    firsts = firsts.withColumn("first", F.min("first").over(Window.partitionBy("tree")))
    ranked = placed.join(firsts, ["stretch", "tree"])
    return ranked.select("tree", (F.col("position") - F.col("first")).alias("rank"), "node", "item")


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (tree, rank, node, item) rolled up: tree, block, and top, the struct of the block's node."""
    digits = [f"digit{k}" for k in range(DIGITS)]
    place = [F.expr(f"rank div {FAN**k} % {FAN}").cast("int").alias(d) for k, d in enumerate(digits)]
    now = rows.select("tree", F.expr(f"rank div {FAN**DIGITS}").alias("block"), *place, F.struct("node", "item").alias("top"))
    now = now.repartition("tree", "block")
    for k, digit in enumerate(digits):
        above = digits[k + 1 :]
        now = now.groupBy("tree", "block", *above).agg(F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), F.col("top").alias("kid")))).alias("kids"))
        nodes = F.transform("kids", lambda x: x["kid"]["node"])
        first = F.col("block") == 0
        for d in above:
            first = first & (F.col(d) == 0)
        alone = first & (F.size("kids") == 1)  # the tree has no other node on this level
        node = F.when(alone, nodes[0]).otherwise(digest(F.array_join(nodes, "")))
        now = now.select("tree", "block", *above, F.struct(node.alias("node"), alone.alias("alone"), "kids").alias("top"))
    return now


def _tiers(rows: DataFrame) -> list[DataFrame]:
    """Tables of blocks, each over the nodes of the one before; in the last every tree has one block."""
    tiers = []
    while True:
        tiers.append(stored(_blocks(rows)))
        if not tiers[-1].agg(F.max("block")).first()[0]:
            return tiers
        rows = tiers[-1].select("tree", F.col("block").alias("rank"), "top.node", F.lit(None).cast("string").alias("item"))


def _paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """What hangs in the blocks, with its path to the root: tree, rank, node, item, path, mark.

    above: tree, block, path and mark of the blocks' own nodes; they meet their blocks in a grouping.
    """
    one = lambda c: F.first(c, ignorenulls=True).alias(c)
    met = blocks.unionByName(above, allowMissingColumns=True).groupBy("tree", "block").agg(one("top"), one("path"), one("mark"))
    entries = F.array(F.struct(F.col("top").alias("kid"), F.col("block").alias("rank"), "path"))
    text = lambda kids: F.array_join(F.transform(kids, lambda y: y["kid"]["node"]), "")

    def spread(e: Column) -> Column:
        kids = e["kid"]["kids"]

        def step(x: Column, i: Column) -> Column:
            own = F.struct(text(F.slice(kids, 1, i)).alias("left"), text(F.slice(kids, i + 2, F.size(kids))).alias("right"))
            path = F.when(e["kid"]["alone"], e["path"]).otherwise(F.concat(F.array(own), e["path"]))
            return F.struct(x["kid"].alias("kid"), (e["rank"] * FAN + x["digit"]).alias("rank"), path.alias("path"))

        return F.transform(kids, step)

    for _ in range(DIGITS):
        entries = F.flatten(F.transform(entries, spread))
    return met.select("tree", "mark", F.explode(entries).alias("e")).select("tree", "e.rank", "e.kid.node", "e.kid.item", "e.path", "mark")


def _descended(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    for blocks in reversed(tiers):
        found = _paths(blocks, above)
        above = found.select("tree", F.col("rank").alias("block"), "path", "mark")
    return found


def manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "source", by: str = "doc_id", keep: dict[str, Column] | None = None
) -> DataFrame:
    """Every row's leaf, its group's root, the root of all, and the path from its leaf to that root.

    Returns `by` and `group` under their names, leaf, subroot, root, path (array of left and right siblings from the
    leaf upwards), and the columns of `keep`. Groups are ordered by their UTF-8 bytes, the null group first; rows of
    a group by `by` (null first), and rows that are equal in it by their leaves; repeated rows are leaves of their
    own. Null values are told from empty ones; texts count whole. A group of one row has its leaf as subroot, and one
    group's subroot is the root. An empty table gives no rows. Other columns are neither read nor returned.
    """
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    item = F.struct(F.col(by).alias("by"), F.col(group).alias("group"), *[c.alias(f"kept {k}") for k, c in (keep or {}).items()])
    rows = stored(docs.select(tree.alias("tree"), leaf(columns).alias("node"), F.col(by).alias("by"), item.alias("item")))
    tiers = _tiers(_ranked(rows))
    subroots = tiers[-1].select(F.lit("").alias("tree"), "top.node", F.col("tree").alias("by"), F.col("tree").alias("item"))
    tops = _tiers(_ranked(subroots))
    start = docs.sparkSession.range(1).select(
        F.lit("").alias("tree"), F.lit(0).cast("long").alias("block"), F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("mark")
    )
    top = tops[-1].select("top.node").first()  # one row: all subroots are one tree
    if top is None:
        above = start.where("false")
    else:
        groups = _descended(tops, start)
        above = groups.select(F.col("item").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("mark"))
    found = _descended(tiers, above)
    return found.select(
        F.col("item.by").alias(by), F.col("item.group").alias(group), F.col("node").alias("leaf"), F.col("mark").alias("subroot"),
        F.lit(top.node if top else None).cast("string").alias("root"), "path", *[F.col(f"item.`kept {k}`").alias(k) for k in keep or {}],
    )

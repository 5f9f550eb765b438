"""What several corpus operators share: input columns, the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table with just the named columns, so that the scan reads no others."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of an id written as text, modulo `modulus`; it says which rows are held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def byte_parts(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in parts whose texts in a column have about `most` bytes together, so that what numpy makes of a
    part is bounded; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes + 16), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; only a local session without one gets its own."""
    context = spark.sparkContext
    if context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir():
        return
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder: it survives lost executors, and its lineage ends here."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as rows (node, root), root the smallest node reached.

    Alternates the large-star and small-star steps until no edge changes. Each step takes a minimum for
    each node and joins it back, so no neighbourhood is ever gathered in one place. Nodes without an edge
    to another node have no row.
    """
    now = cut(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("u < v").distinct()
    )
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v"), F.col("m").alias("u")).where("u < v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(low, "v")
        small = (
            joined.select("v", F.col("m").alias("u"))
            .union(joined.select(F.col("u").alias("v"), F.col("m").alias("u")))
            .where("u < v")
            .distinct()
        )
        now = cut(small)
        # each star lowers the labels, so equal counts and sums mean that nothing moved
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root")).union(
                now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
            )
        before = tuple(state)


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder; nothing is there yet."""
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: like `cut`, but compressed and prunable."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` in the shared folder, bucketed by `key`, so that joins on the key leave these rows where they are.

    There are at least two buckets for each partition that `df` is read in, so buckets stay as small as those.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, key).write.option("path", shared_folder(spark)).bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def positions(df: DataFrame, *order: F.Column) -> DataFrame:
    """`df` with each row's place (position, from 0) in the order of all rows.

    Rows are sorted in ranges, never in one task. What comes to the driver is one count for each range.
    """
    spark = df.sparkSession
    ranged = cut(df.orderBy(*order).withColumn("position", F.monotonically_increasing_id()))
    part = F.shiftright("position", 33)
    counts = ranged.groupBy(part.alias("part")).count().orderBy("part").collect()
    before = np.cumsum([0, *(r["count"] for r in counts)])
    starts = spark.createDataFrame([(r["part"], int(n)) for r, n in zip(counts, before)], "part long, rows_before long")
    placed = ranged.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.withColumn("position", F.col("rows_before") + F.col("position").bitwiseAND((1 << 33) - 1)).drop("part", "rows_before")

"""Continuous ingestion: files as they come, batches that can be repeated, running totals, goal states."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.duplicates import with_fingerprint
from ..operators.tables import commit
from ..operators.totals import counted


def image_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New images of a folder into which whole files are moved. What was seen is remembered by the query's checkpoint,
    whole or not; where files are written in place, use `arrivals.settled_files`."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.{png,jpg,jpeg,PNG,JPG,JPEG}")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )


def log_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table in a folder, or none of its rows if nothing was written yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


#: What a log must have to be committed, and what it is called if it lacks it.
REQUIRED = {"id": "no id", "log_date": "no date", "exam_name_raw": "no title"}


def flawed() -> Column:
    """What is wrong with a log, or null."""
    return F.coalesce(*[F.when(F.col(c).isNull(), why) for c, why in REQUIRED.items()], F.when(F.trim("exam_name_raw") == "", "no title"))


def commit_batch(batch: DataFrame, number: int, table: str, review: str, failed: str) -> None:
    """Writes one batch: good logs to the table by day, each fingerprint once; logs under review and flawed ones to
    tables of their own, in a folder for the batch that a repeated batch writes again."""
    batch = batch.persist()
    marked = batch.withColumn("error", flawed())
    keyed = with_fingerprint(marked.where(F.col("error").isNull()).drop("error"))
    ready = commit(keyed.where(~F.col("needs_review")), stored(batch.sparkSession, table, keyed))
    ready.write.mode("append").partitionBy("log_date").parquet(table)
    keyed.where(F.col("needs_review")).write.mode("overwrite").parquet(f"{review}/batch={number}")
    marked.where(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{failed}/batch={number}")
    batch.unpersist()


def commit_stream(logs: DataFrame, table: str, review: str, failed: str, checkpoint: str, once: bool = True):
    """Appends a stream of study logs to a table by day, each fingerprint once; rows under review and flawed rows go to
    their own tables. A batch that comes again, after a lost driver or executor, adds nothing: what it appended is
    there by fingerprint, and its other rows are written over. An error that isn't a row's ends the batch, which Spark
    repeats from its checkpoint; no offset moves on."""

    def process(batch: DataFrame, number: int) -> None:
        commit_batch(batch, number, table, review, failed)

    writer = logs.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def activity(spark: SparkSession, table: str, review: str, failed: str, like: DataFrame, n: int = 200) -> DataFrame:
    """The newest n entries of what became of logs: id, study_datetime, outcome (committed, review or error)."""
    kinds = {"committed": table, "review": review, "error": failed}
    every = None
    for outcome, path in kinds.items():
        own = stored(spark, path, like).select("id", "study_datetime", F.lit(outcome).alias("outcome"))
        every = own if every is None else every.unionByName(own)
    return every.orderBy(F.desc("study_datetime"), F.desc("id")).limit(n)


def settled(images: DataFrame, as_of: Column, quiet_ms: int = 800) -> DataFrame:
    """Of a listing of images those that nobody has written to for some time and that have content. A listing is one
    look: the others are in the next one. A stream that holds files back by itself is `arrivals.settled_files`."""
    quiet = F.unix_millis("modificationTime") <= F.unix_millis(as_of) - quiet_ms
    return images.where(quiet & (F.col("length") > 0))


def running_totals(logs: DataFrame) -> DataFrame:
    """Counted work units, rows and rows under review by profile and day; write in complete or update mode."""
    return logs.groupBy("profile_id", "log_date").agg(
        F.sum(counted()).alias("wrvu"), F.count("*").alias("studies"), F.count_if(F.col("needs_review")).alias("under_review")
    )


def windowed_totals(logs: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Totals by windows of study time with a bound on lateness (an extension). Watermarks need instants."""
    timed = logs.withColumn("at", F.col("study_datetime").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "profile_id").agg(F.sum(counted()).alias("wrvu"), F.count("*").alias("studies"))


def goal_states(logs: DataFrame, goal: float) -> DataFrame:
    """Per profile and day: total so far, whether the goal is reached, and whether this batch reached it."""

    def update(key, batches, state: GroupState):
        total, reached = state.get if state.exists else (0.0, False)
        before = reached
        for batch in batches:
            total += float(batch["counted"].sum())
        reached = total >= goal
        state.update((total, reached))
        yield pd.DataFrame({"profile_id": [key[0]], "log_date": [key[1]], "wrvu": [total], "reached": [reached], "just_reached": [reached and not before]})

    ready = logs.select("profile_id", "log_date", counted().alias("counted"))
    return ready.groupBy("profile_id", "log_date").applyInPandasWithState(
        update,
        "profile_id long, log_date date, wrvu double, reached boolean, just_reached boolean",
        "total double, reached boolean",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str, then: Callable | None = None):
    """Runs a stream over what there is now into a memory table; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    done = query.trigger(availableNow=True).start()
    done.awaitTermination()
    return then(stream.sparkSession.table(name)) if then else stream.sparkSession.table(name)

"""Rows whose columns cost much: computed once, and by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column that is computed once a row. Conditions on a plain column are taken down to the rows it is
    made of, and all that it is made of is then written out in each of them; they stay above this one."""
    return df.withColumn(name, F.explode(F.array(value)))


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly to all tasks. Files give a task for each of their row groups, which may be few, however
    long each row takes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))

"""Tasks of bounded size: equi-joins whose many-side may hold a third of its rows under one key, and rows dealt before they are grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.session import materialise

#: Rows of one key that a task should meet.
ROWS_PER_TASK = 1_000_000


#: Rows are counted by hash buckets of their keys first, so that counting takes the same memory whatever the number of keys.
BUCKETS = 1 << 14


def hot_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, _salts) of the keys with more rows than that, at most rows / rows_per_task of them; written once, so its size is known.

    A key with so many rows fills its bucket, so only the keys of full buckets are counted one by one.
    """
    n = F.count(F.lit(1)).alias("_n")
    placed = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("_bucket"))
    full = materialise(placed.groupBy("_bucket").agg(n).filter(F.col("_n") > rows_per_task).select("_bucket"))
    counts = placed.join(F.broadcast(full), "_bucket", "left_semi").groupBy(*keys).agg(n).filter(F.col("_n") > rows_per_task)
    return materialise(counts.select(*keys, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")))


def dealt(df: DataFrame, keys: list[str], rows: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows dealt by key over as many tasks as ``rows`` of them need; what groups by these keys and others after it stays in its task.

    For groups that are about as many as the rows: an aggregate before the shuffle would only hold a whole split of a file in memory.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task)), *keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join on keys; rows of ``right`` under a hot key are dealt by ``spread`` over as many tasks as they need.

    ``left`` must be the smaller side: its rows under hot keys are repeated once per salt, so every match is
    still found exactly once.
    """
    salts = F.coalesce("_salts", F.lit(1))
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int")).drop("_salts")
    salted_left = left.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"]).drop("_salt")

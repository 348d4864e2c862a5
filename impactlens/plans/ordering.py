"""Positions, running sums and neighbours inside ordered groups of any size.

Rows are range-partitioned by (keys, order), each partition is numbered on its own, and small
per-partition totals shift the numbers. Only a caller whose groups are bounded by what they are, such as
the lines of one text, asks for a plain window, which keeps a group in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.session import materialise

def _join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on keys; the right side's copies are renamed first, as both come from one table."""
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_right_{k}" for k in keys])


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    amount: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Adds rn (1-based position), n (rows of the group) and, with an amount, running (sum so far)."""
    df = df.withColumn("_amount", amount if amount is not None else F.lit(0))
    if bounded:
        w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        upto = w.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        out = df.withColumn("rn", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn(
            "n", F.count(F.lit(1)).over(w)
        )
        if amount is not None:
            out = out.withColumn("running", F.sum("_amount").over(upto))
        return out.drop("_amount")

    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id())
    # Written once, so a lost executor cannot redraw the range borders between two reads.
    pinned = materialise(ranged)
    local = W.partitionBy(*keys, "_part").orderBy(*order)
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = pinned.withColumn("_rn", F.row_number().over(local)).withColumn("_sum", F.sum("_amount").over(upto))
    totals = pinned.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_count"), F.sum("_amount").alias("_total")
    )
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    before = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *keys,
        "_part",
        F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_skip"),
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"),
        F.sum("_count").over(group).alias("n"),
    )
    joined = _join_same(rows, shifts, [*keys, "_part"])
    out = joined.withColumn("rn", F.col("_rn") + F.col("_skip"))
    if amount is not None:
        out = out.withColumn("running", F.col("_sum") + F.col("_base"))
    return out.drop("_amount", "_part", "_rn", "_sum", "_skip", "_base")


def with_previous(
    df: DataFrame, keys: list[str], order: list[Column], columns: list[str], bounded: bool = False
) -> DataFrame:
    """Adds prev_<column> from the row before in the group's order."""
    if bounded:
        w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(*order)
        return df.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    pinned = materialise(numbered(df, keys, order, bounded=bounded))
    before = pinned.select(*keys, (F.col("rn") + 1).alias("rn"), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return _join_same(pinned, before, [*keys, "rn"], "left").select(*df.columns, *[f"prev_{c}" for c in columns])


def exact_median(df: DataFrame, keys: list[str], value: str, bounded: bool = False) -> DataFrame:
    """(keys, median): equal values are counted first, then the middle rank is located."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    placed = numbered(counts, keys, [F.col(value)], F.col("copies"), bounded)
    if keys:
        joined = _join_same(placed, counts.groupBy(*keys).agg(F.sum("copies").alias("_all")), keys)
    else:
        joined = placed.withColumn("_all", F.lit(counts.agg(F.sum("copies")).first()[0]))
    low, high = F.floor((F.col("_all") + 1) / 2), F.ceil((F.col("_all") + 1) / 2)
    first, last = F.col("running") - F.col("copies") + 1, F.col("running")
    parts = F.when((first <= low) & (low <= last), F.col(value)), F.when((first <= high) & (high <= last), F.col(value))
    return joined.groupBy(*keys).agg(((F.max(parts[0]) + F.max(parts[1])) / 2).alias("median"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark trims every partition to k before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def single_best(df: DataFrame, keys: list[str], order: list[Column], descending: bool = False) -> DataFrame:
    """The first (or last) row of each group by an aggregate, so hot groups shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if descending else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])

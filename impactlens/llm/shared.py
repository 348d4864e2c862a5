"""What the corpus operators share: reading, null-safe joins, positions and sums over ordered groups of any size, set components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.session import materialise


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def whole(column: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def boxed(docs: DataFrame, **named: Column) -> DataFrame:
    """Whole rows as one column ``_row`` beside the named ones, so that no column of the input can clash; ``unboxed`` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[c.alias(n) for n, c in named.items()])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the left side's columns and adds the right side's others."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    out = left.join(renamed, matches, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_r_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[Column], amount: str | None = None) -> DataFrame:
    """Adds ``rn`` (position from 1) and, with an amount, ``upto`` (sum so far, itself included) in each group's order.

    Rows are range-partitioned by keys and order, so a group of any size is spread over many tasks; each
    part is numbered on its own and shifted by the totals of the parts before it. The ranged rows are
    written first: a repeated task must not draw other range borders.
    """
    amounts = F.col(amount) if amount else F.lit(0)
    ranged = materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    by = [*keys, "_part"]
    local = W.partitionBy(*by).orderBy(*order)
    rows = ranged.withColumn("_rn", F.row_number().over(local).cast("long")).withColumn(
        "_upto", F.sum(amounts).over(local.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    before = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum(amounts).alias("_sum"))
    shifts = totals.select(
        *by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    out = same(rows, shifts, by, "inner").withColumn("rn", F.col("_rn") + F.col("_skip"))
    if amount:
        out = out.withColumn("upto", F.col("_upto") + F.col("_base"))
    return out.drop("_part", "_rn", "_upto", "_skip", "_base")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): root is the smallest node that can be reached.

    Large-star and small-star steps in turn; every step is two shuffles of the edges, hubs shrink by
    partial minima, and the edges are written after each pair of steps. Rounds grow with the logarithm
    of the longest chain.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return materialise(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def chunks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)

"""Runs of lines, shares of a budget and even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.plans.ordering import numbered
from impactlens.session import materialise


def line_runs(lines: DataFrame, keys: list[str], line: str = "line", bounded: bool = False) -> DataFrame:
    """(keys, first, last): maximal runs of consecutive numbers."""
    placed = numbered(lines.select(*keys, line).distinct(), keys, [F.col(line)], bounded=bounded)
    island = (F.col(line) - F.col("rn")).alias("_island")
    return placed.groupBy(*keys, island).agg(F.min(line).alias("first"), F.max(line).alias("last")).drop("_island")


def quotas(groups: DataFrame, keys: list[str], order: list[Column], cap: int | Column, bounded: bool = False) -> DataFrame:
    """Adds share: the cap split over the rows of each key, the first rows taking the remainder."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    placed = numbered(groups, keys, order, bounded=bounded)
    extra = F.when(F.col("rn") <= F.pmod(cap, F.col("n")), 1).otherwise(0)
    return placed.withColumn("share", F.floor(cap / F.col("n")) + extra).drop("rn", "n")


def even_sample(
    rows: DataFrame, keys: list[str], order: list[Column], k: int | Column, bounded: bool = False
) -> DataFrame:
    """At most k rows per group, spread evenly in order with both ends kept; k = 1 keeps the first.

    Sampling is what this operator is for; nothing else in the library drops rows.
    """
    k = F.lit(k) if isinstance(k, int) else k
    placed = numbered(rows, keys, order, bounded=bounded)
    at, last = F.col("rn") - 1, F.col("n") - 1
    spread = F.exists(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * last / F.greatest(k - 1, F.lit(1)), 0) == at)
    keep = F.when(k >= F.col("n"), True).when(k <= 0, False).when(k == 1, at == 0).otherwise(spread)
    return placed.filter(keep).drop("rn", "n")


def _spots(n: Column, k: Column) -> Column:
    """The 0-based places of an even sample of k out of n rows in order, as an array; all of them if k is no smaller."""
    some = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.bround(i * (n - 1) / F.greatest(k - 1, F.lit(1)), 0).cast("long"))
    return F.when(k >= n, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(some)


def sample_changed(changed: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """A fair sample of changed lines (keys, path, line): files share the cap, runs share a file's part.

    With more files than the cap an even sample of the files counts. Each run gives an even sample of at least one line, and what
    the runs of a file give is cut to the file's share by an even sample again. All three samples are places in an order, so they
    are computed from a file's number and its runs' lengths: files and runs are numbered once each, lines never, and files that
    are not drawn leave before their runs are numbered. A cap below one keeps nothing; null paths and lines count as no change.
    """
    lines = changed.select(*keys, "path", "line").filter(F.col("path").isNotNull() & F.col("line").isNotNull())
    if cap < 1:
        return lines.limit(0)
    # Read for the files and again for the runs of those drawn.
    lines = materialise(lines)
    placed = numbered(lines.select(*keys, "path").distinct(), keys, [F.col("path")])
    drawn = F.least(F.col("n"), F.lit(cap))
    at = (F.array_position(_spots(F.col("n"), F.lit(cap).cast("long")), F.col("rn") - 1) - 1).alias("_at")
    files = placed.select(*keys, "path", drawn.alias("_drawn"), at).filter("_at >= 0").select(
        *keys, "path", (F.floor(F.lit(cap) / F.col("_drawn")) + F.when(F.col("_at") < F.lit(cap) % F.col("_drawn"), 1).otherwise(0)).alias("_share")
    )
    file = [*keys, "path"]
    runs = line_runs(lines.join(files.select(*file), file, "left_semi"), file, bounded=True).withColumn("_length", (F.col("last") - F.col("first") + 1).cast("long"))
    counted = runs.join(runs.groupBy(*file).agg(F.count(F.lit(1)).alias("_runs")).join(files, file), file).withColumn(
        "_each", F.greatest(F.lit(1).cast("long"), F.floor(F.col("_share") / F.col("_runs")))
    )
    # The runs of one file are bounded by its lines.
    given = numbered(counted, file, [F.col("first")], F.least("_length", "_each"), bounded=True)
    total = given.groupBy(*file).agg(F.sum(F.least("_length", "_each")).alias("_total"))
    taken = given.join(total, file).select(
        *file, "first", (F.col("running") - F.least("_length", "_each")).alias("_before"), "_total", "_share",
        F.posexplode(_spots(F.col("_length"), F.col("_each"))).alias("_pos", "_spot"),
    )
    here = F.col("_before") + F.col("_pos")
    return taken.filter(F.array_contains(_spots(F.col("_total"), F.col("_share")), here)).select(*file, (F.col("first") + F.col("_spot")).cast(changed.schema["line"].dataType).alias("line"))

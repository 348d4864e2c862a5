"""Which lines two versions of a text differ in."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def line_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, line): lines without a partner on the other side.

    The n-th copy of a line is partner of the n-th copy over there, so a moved line counts as
    unchanged; ``changed_lines`` is exact about moves. Inputs have (keys, line_no, text).
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, "text", F.lit(name).alias("side"), F.col("line_no").alias("line"))

    # Both sides meet once, by their keys and text; where one of these is null, a line has no partner.
    copy = F.row_number().over(W.partitionBy(*keys, "text", "side").orderBy("line"))
    both = side(before, "before").unionByName(side(after, "after")).repartition(*keys, "text").withColumn("_copy", copy)
    partners = F.count(F.lit(1)).over(W.partitionBy(*keys, "text", "_copy"))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "text"]])
    return both.withColumn("_partners", partners).filter((F.col("_partners") == 1) | ~known).select(*keys, "side", "line")


def changed_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, line) by sequence matching; ``pairs`` has (keys, before, after) texts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                old, new = (row["before"] or "").splitlines(), (row["after"] or "").splitlines()
                matcher = difflib.SequenceMatcher(None, old, new, autojunk=False)
                same_old, same_new = set(), set()
                for block in matcher.get_matching_blocks():
                    same_old.update(range(block.a, block.a + block.size))
                    same_new.update(range(block.b, block.b + block.size))
                hits = [("before", i + 1) for i in range(len(old)) if i not in same_old]
                hits += [("after", i + 1) for i in range(len(new)) if i not in same_new]
                if hits:
                    out = pd.DataFrame(hits, columns=["side", "line"])
                    for key in keys:
                        out.insert(0, key, row[key])
                    yield out[[*keys, "side", "line"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)
    return pairs.select(*keys, "before", "after").mapInPandas(run, f"{fields}, side STRING, line INT")

"""Source trees as tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.functions.text import is_test_path, language_of
from impactlens.session import materialise

# Folders no scan enters, suffixes a scan keeps.
SKIP_DIRS = (
    ".git", ".venv", "venv", "node_modules", "__pycache__", ".tox", ".mypy_cache", ".pytest_cache", "dist",
    "build", ".ruff_cache", "site-packages", ".eggs",
)
SUFFIXES = (".py", ".ts", ".tsx")


def graph_key(repo: Column | str, commit: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("@", repo, commit), 256), 1, 24)


def scan_trees(
    roots: DataFrame, skip: tuple[str, ...] = SKIP_DIRS, suffixes: tuple[str, ...] = SUFFIXES,
    max_files: int | None = None,
) -> DataFrame:
    """(graph_id, path, content, over_limit) of every source file below each (graph_id, root).

    Folders are listed level by level in tasks, so one very large tree is spread too and skipped
    folders are never entered. The usual file readers hide names that begin with an underscore, which
    would lose every package file. A graph with more than ``max_files`` files is flagged, never cut.
    """
    listing = "graph_id STRING, root STRING, path STRING, is_dir BOOLEAN"
    level = roots.select("graph_id", "root", F.lit("").alias("path"), F.lit(True).alias("is_dir"))
    found = []
    while True:
        level = materialise(level.filter("is_dir").repartition(F.xxhash64("graph_id", "path")).mapInPandas(_list, listing))
        level = level.filter(~F.element_at(F.split("path", "/"), -1).isin(*skip))
        found.append(level.filter(~F.col("is_dir")))
        if level.filter("is_dir").isEmpty():
            break
    files = reduce(DataFrame.unionByName, found).filter(F.regexp_extract("path", r"[^/](\.[^./]+)$", 1).isin(*suffixes))
    contents = files.repartition(F.xxhash64("graph_id", "path")).mapInPandas(
        _read, "graph_id STRING, path STRING, content BINARY"
    )
    if max_files is None:
        return contents.withColumn("over_limit", F.lit(False))
    sizes = files.groupBy("graph_id").agg((F.count(F.lit(1)) > max_files).alias("over_limit"))
    return contents.join(sizes, "graph_id")


def scan_tree(spark: SparkSession, root: str, graph_id: str, **options) -> DataFrame:
    return scan_trees(spark.createDataFrame([(graph_id, root)], "graph_id STRING, root STRING"), **options)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            fs, base = FileSystem.from_uri(row.root)
            infos = fs.get_file_info(FileSelector(f"{base}/{row.path}".rstrip("/"), recursive=False))
            prefix = f"{row.path}/" if row.path else ""
            yield pd.DataFrame(
                [(row.graph_id, row.root, prefix + i.base_name, i.type == FileType.Directory) for i in infos],
                columns=["graph_id", "root", "path", "is_dir"],
            )


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            fs, base = FileSystem.from_uri(row.root)
            with fs.open_input_stream(f"{base}/{row.path}") as stream:
                yield pd.DataFrame({"graph_id": [row.graph_id], "path": [row.path], "content": [stream.read()]})


def text_of(raw: DataFrame) -> DataFrame:
    return raw.select("graph_id", "path", F.decode("content", "UTF-8").alias("text"))


def file_table(raw: DataFrame) -> DataFrame:
    return raw.select(
        "graph_id", "path", language_of("path").alias("lang"), F.sha2("content", 256).alias("sha256"),
        is_test_path("path").alias("is_test"),
    )


def graphs_to_build(wanted: DataFrame, built: DataFrame) -> DataFrame:
    """Graphs not stored yet; a stored one is reused."""
    return wanted.join(built.select("graph_id").distinct(), "graph_id", "left_anti")


def replace_graph(tables: dict[str, DataFrame], root: str) -> None:
    """Write every table partitioned by graph_id; the partitions present are replaced, others stay."""
    for name, df in tables.items():
        (
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("graph_id").parquet(f"{root}/{name}")
        )

"""File trees, bounded source spans and symbols with their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.operators.radius import find_symbols
from impactlens.plans.ordering import first_rows

TREE_LIMIT = 60
SPAN_LIMIT = 400


def tree_all(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """(keys, prefix, name, kind, files): every folder level at once; a folder counts the files below it.

    The usual folder is deep but narrow, so each path is repeated once per folder in it.
    """
    parts = F.split(path, "/")
    levels = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.struct(
        F.array_join(F.slice("_parts", F.lit(1), i - 1), "/").alias("prefix"),
        F.get("_parts", i - 1).alias("name"),
        F.when(i == F.size("_parts"), "file").otherwise("dir").alias("kind"),
    ))
    rows = files.select(*keys, parts.alias("_parts")).select(*keys, F.explode(levels).alias("_l"))
    return rows.groupBy(*keys, F.col("_l.prefix").alias("prefix"), F.col("_l.name").alias("name"), F.col("_l.kind").alias("kind")).agg(
        F.count(F.lit(1)).alias("files")
    )


def bounded_tree(entries: DataFrame, keys: list[str], limit: int = TREE_LIMIT) -> DataFrame:
    """At most ``limit`` entries per level, folders first; total and truncated say what was left out."""
    level = [*keys, "prefix"]
    totals = entries.groupBy(*level).agg(F.count(F.lit(1)).alias("total"))
    shown = first_rows(entries, level, [F.col("kind") != "dir", F.col("name")], limit).drop("rn")
    return shown.join(totals, level).withColumn("truncated", F.col("total") > limit)


def tree_level(files: DataFrame, prefix: str, limit: int = TREE_LIMIT, symbols: DataFrame | None = None) -> DataFrame:
    """One level of each graph's tree; a graph without the prefix has one row of kind 'missing'.

    A prefix that is a file lists its ``symbols`` (graph_id, path, fqn, line_start, line_end), or is one row of kind 'file' without them.
    """
    here = prefix.strip("/")
    under = f"{here}/" if here else ""
    inside = files.filter(F.startswith("path", F.lit(under))).select(
        "graph_id", F.substring("path", F.lit(len(under) + 1), F.length("path")).alias("rest")
    )
    head = F.split_part("rest", F.lit("/"), F.lit(1))
    kind = F.when(F.contains("rest", F.lit("/")), "dir").otherwise("file")
    entries = inside.groupBy("graph_id", F.lit(here).alias("prefix"), head.alias("name"), kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("files")
    )
    is_file = files.filter(F.col("path") == here).select("graph_id").distinct()
    none = F.lit(None).cast("long")
    if symbols is None:
        listed = is_file.select("graph_id", F.lit(here.rsplit("/", 1)[-1]).alias("name"), F.lit("file").alias("kind"), none.alias("line_start"), none.alias("line_end"))
    else:
        listed = symbols.filter(F.col("path") == here).join(is_file, "graph_id", "left_semi").select(
            "graph_id", F.col("fqn").alias("name"), F.lit("symbol").alias("kind"), F.col("line_start").cast("long"), F.col("line_end").cast("long")
        )
    missing = files.select("graph_id").distinct().join(inside.select("graph_id").distinct().unionByName(is_file), "graph_id", "left_anti")
    flags = [F.lit(here).alias("prefix"), F.lit(0).cast("long").alias("total"), F.lit(False).alias("truncated")]
    shown = bounded_tree(entries, ["graph_id"], limit)
    rest = listed.select("*", *flags).unionByName(missing.select("graph_id", F.lit("missing").alias("kind"), *flags), allowMissingColumns=True)
    return shown.unionByName(rest, allowMissingColumns=True)


def _bounds(start: str, end: str, cap: int | None) -> tuple[Column, Column, Column]:
    """First line, last line and whether the cap may have cut, of a span from ``start`` to ``end``."""
    first = F.greatest(F.col(start), F.lit(1))
    last = F.greatest(F.col(end), first)
    return (first, last, F.lit(False)) if cap is None else (first, F.least(last, first + cap - 1), last - first + 1 >= cap)


def _gathered(lines: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (keys, start, _stop) with end, total_lines and text. Lines are counted without their texts; only those inside are shuffled with them."""
    span = [*keys, "start", "_stop"]
    totals = lines.select(*keys).join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("total_lines"))
    inside = lines.select(*keys, "line_no", "text").join(wanted.select(*span), keys).filter(F.col("line_no").between(F.col("start"), F.col("_stop")))
    texts = inside.groupBy(*span).agg(F.max("line_no").alias("end"), F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("_lines")).select(
        *span, "end", F.array_join(F.transform("_lines", lambda s: s["text"]), "\n").alias("text")
    )
    return wanted.join(totals, keys, "left").join(texts, span, "left")


def read_span(lines: DataFrame, spans: DataFrame, keys: list[str], cap: int | None = SPAN_LIMIT) -> DataFrame:
    """(keys, start, end, truncated, found, total_lines, text): the lines of each span (keys, start, end), at most ``cap`` of them or all.

    Every span has its row: a file that is not there is not ``found``, and a span past its end has no ``end`` and no text.
    """
    first, last, cut = _bounds("start", "end", cap)
    wanted = spans.select(*keys, first.alias("start"), last.alias("_stop"), cut.alias("truncated")).distinct()
    read = _gathered(lines, wanted, keys).withColumn("found", F.col("total_lines").isNotNull())
    return read.fillna({"total_lines": 0, "text": ""}).drop("_stop")


def entity(symbols: DataFrame, lines: DataFrame, name: str, limit: int | None = 5, cap: int | None = SPAN_LIMIT) -> DataFrame:
    """Up to ``limit`` symbols of a name per graph (or all of them), each with its source of at most ``cap`` lines (or whole) and the full count.

    ``truncated`` tells of symbols left out, ``source_truncated`` of lines: the symbol goes on where its source was cut.
    """
    found = find_symbols(symbols, name)
    counts = found.groupBy("graph_id").agg(F.count(F.lit(1)).alias("total"))
    first, last, _ = _bounds("line_start", "line_end", cap)
    first_few = found if limit is None else first_rows(found, ["graph_id"], [F.col("path"), F.col("line_start"), F.col("fqn")], limit)
    shown = first_few.select(
        "graph_id", "fqn", "path", "line_start", "line_end", first.alias("start"), last.alias("_stop")
    )
    span = ["graph_id", "path", "start", "_stop"]
    source = _gathered(lines, shown.select(*span).distinct(), ["graph_id", "path"]).withColumnRenamed("text", "source")
    return (
        shown.join(source, span).join(counts, "graph_id")
        .withColumn("total_lines", F.coalesce("total_lines", F.lit(0))).withColumn("truncated", F.lit(False) if limit is None else F.col("total") > limit)
        .withColumn("source_truncated", F.coalesce(F.col("_stop") < F.least("line_end", "total_lines"), F.lit(False))).drop("start", "_stop", "end")
    )

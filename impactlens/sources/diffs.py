"""Unified diffs inside free text, as tables of hunks and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactlens.session import materialise

# The sentinels around a diff, and a bare closing form.
BLOCK = r"(?s)<<<DIFF\r?\n(.*?)DIFF>>>"
BARE_BLOCK = r"(?s)<<<DIFF\r?\n(.*?)\r?\n>>>[ \t]*(?:\r?\n|$)"
HUNK = r"^@@\s*-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s*@@"


def _blocks(text: Column) -> Column:
    closed = F.regexp_extract_all(text, F.lit(BLOCK), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(BARE_BLOCK), F.lit(1))
    # An indented closing sentinel leaves white space behind; it is no context line.
    trimmed = F.transform(closed, lambda b: F.regexp_replace(b, r"(^|\n)[ \t\r]+$", "$1"))
    return F.when(F.size(closed) > 0, trimmed).otherwise(bare)


def _number(group: int, default: int | None = None) -> Column:
    found = F.nullif(F.regexp_extract("text", HUNK, group), F.lit("")).try_cast("int")
    return found if default is None else F.coalesce(found, F.lit(default))


def _clean_path(line: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(line, r"^(---|\+\+\+) ", ""), r"\t.*$", "")
    return F.when(path != "/dev/null", F.regexp_replace(F.rtrim(path), "^[ab]/", ""))


def read_diffs(replies: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(verdicts, lines) of replies (key, text).

    verdicts: (key, verdict, reason, paths), verdict ok or unparseable. lines: (key, hunk_id, pos, path,
    op, text, old_no, new_no) of the accepted diffs. A diff is one value of one row, so the windows
    below never see more than one text per group.
    """
    # Texts are searched once and their lines marked once; verdicts, hunks and lines read what is written here.
    blocks = materialise(replies.select(key, _blocks(F.col("text")).alias("_b")))
    body = F.regexp_replace(F.get("_b", F.lit(0)), r"^\n+|\n+$", "")
    split = blocks.filter(F.size("_b") == 1).select(key, F.posexplode(F.split(body, "\n")).alias("pos", "text"))

    order = W.partitionBy(key).orderBy("pos")
    text = F.col("text")
    lead, lag = F.lead("text").over(order), F.lag("text").over(order)
    marked = split.withColumn("_old_file", F.startswith(text, F.lit("--- ")) & F.coalesce(F.startswith(lead, F.lit("+++ ")), F.lit(False)))
    marked = marked.withColumn(
        "_new_file", F.startswith(text, F.lit("+++ ")) & F.coalesce(F.startswith(lag, F.lit("--- ")), F.lit(False))
    ).withColumn("_header", F.startswith(text, F.lit("@@")))
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("hunk_id", F.sum(F.col("_header").cast("int")).over(upto)).withColumn(
        "_file_id", F.sum(F.col("_old_file").cast("int")).over(upto)
    )
    # Lines after a file header and before its first hunk belong to no hunk.
    marked = marked.withColumn(
        "_opened", F.max(F.when(F.col("_header") | F.col("_old_file"), F.struct("pos", "_header"))).over(upto)["_header"]
    )
    path = F.max(F.when(F.col("_new_file"), F.struct("pos", text.alias("t")))).over(upto)["t"]
    old_path = F.max(F.when(F.col("_old_file"), F.struct("pos", text.alias("t")))).over(upto)["t"]
    marked = marked.withColumn("path", F.coalesce(_clean_path(path), _clean_path(old_path)))
    marked = materialise(marked)

    body_lines = marked.filter(F.col("_opened") & ~F.col("_header") & ~F.col("_new_file"))
    inside = W.partitionBy(key, "hunk_id")
    filled = F.max(F.when(text != "", F.col("pos"))).over(inside)
    body_lines = body_lines.withColumn("_last", filled).filter(F.col("pos") <= F.col("_last"))
    op = F.when(F.substring("text", 1, 1).isin(" ", "+", "-", "\\"), F.substring("text", 1, 1)).otherwise(" ")
    body_lines = body_lines.withColumn("op", op).withColumn(
        "_bare", F.when(F.substring("text", 1, 1).isin(" ", "+", "-", "\\"), F.substring("text", F.lit(2), F.length("text"))).otherwise(text)
    )

    heads = marked.filter("_header").select(
        key, "hunk_id", "_file_id", "path", text.rlike(HUNK).alias("_formed"), _number(1, 1).alias("_start"), _number(3, 1).alias("_new_start"),
        _number(2, 1).alias("_said_old"), _number(4, 1).alias("_said_new"),
    )
    counts = body_lines.groupBy(key, "hunk_id").agg(
        F.count_if(F.col("op").isin(" ", "-")).alias("_old"), F.count_if(F.col("op").isin(" ", "+")).alias("_new"),
        F.max_by("op", F.when(F.col("op") != "\\", F.col("pos"))).alias("_end_op"),
    )
    hunks = heads.join(counts, [key, "hunk_id"], "left").fillna(0, ["_old", "_new"])
    counted = (F.col("_said_old") == F.col("_old")) & (F.col("_said_new") == F.col("_new"))
    hunks = hunks.withColumn("_bad", F.col("_formed") & ~counted & ~F.col("_end_op").eqNullSafe(F.lit(" ")))
    per_diff = hunks.groupBy(key).agg(
        F.count(F.lit(1)).alias("hunks"), F.bool_or("_bad").alias("_bad"), F.bool_or(F.col("_file_id") == 0).alias("_stray")
    )
    named = marked.filter(F.col("_old_file") | F.col("_new_file")).groupBy(key).agg(
        F.array_sort(F.collect_set(_clean_path(text))).alias("paths")
    )
    reason = (
        F.when(F.size("_b") == 0, "no diff block").when(F.size("_b") > 1, "more than one diff block")
        .when(F.trim(F.get("_b", F.lit(0))) == "", "empty block").when(F.col("hunks").isNull(), "no hunks")
        .when(F.col("_stray"), "hunk before a file header").when(F.col("_bad"), "hunk shorter or longer than its header")
    )
    verdicts = blocks.join(per_diff, key, "left").join(named, key, "left").select(
        key, F.when(reason.isNull(), "ok").otherwise("unparseable").alias("verdict"), reason.alias("reason"), "paths"
    )
    so_far = inside.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    old_no = F.sum(F.col("op").isin(" ", "-").cast("int")).over(so_far)
    new_no = F.sum(F.col("op").isin(" ", "+").cast("int")).over(so_far)
    numbered = body_lines.select(key, "hunk_id", "pos", "path", "op", F.col("_bare").alias("text"), old_no.alias("_o"), new_no.alias("_n"))
    starts = hunks.select(key, "hunk_id", "_start", "_new_start")
    lines = (
        numbered.filter(F.col("op") != "\\").join(starts, [key, "hunk_id"])
        .join(verdicts.filter(F.col("verdict") == "ok").select(key), key, "left_semi")
        .select(
            key, "hunk_id", "pos", "path", "op", "text",
            F.when(F.col("op") != "+", F.col("_start") + F.col("_o") - 1).alias("old_no"),
            F.when(F.col("op") != "-", F.col("_new_start") + F.col("_n") - 1).alias("new_no"),
        )
    )
    return verdicts, lines

"""Set-valued checks of a change: scope, plan, call sites, coverage, removals, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions.codes import MANIFESTS
from impactlens.functions.secrets import fingerprint
from impactlens.functions.text import is_test_path, last_part
from impactlens.session import materialise


def scope_check(tasks: DataFrame, touched: DataFrame, radius: DataFrame, allows_new: bool = False) -> DataFrame:
    """(job_id, diff_id, rule): the first rule each patch breaks, or 'ok'.

    ``tasks`` has (job_id, diff_id, target_file), ``touched`` (job_id, diff_id, path), ``radius`` (job_id, path).
    """
    key = ["job_id", "diff_id"]
    inside = radius.select("job_id", "path").distinct().withColumn("_inside", F.lit(True))
    p = F.col("path")
    judged = tasks.join(touched, key, "left").join(inside, ["job_id", "path"], "left")
    flags = judged.groupBy(*key).agg(
        F.bool_or(F.array_contains(F.split(p, "/"), "..") | F.startswith(p, F.lit("/"))).alias("traversal"),
        F.bool_or(p != F.col("target_file")).alias("elsewhere"),
        F.count("path").alias("paths"),
        F.bool_or(is_test_path(p)).alias("test"),
        F.bool_or(F.element_at(F.split(p, "/"), -1).isin(*MANIFESTS)).alias("manifest"),
        F.bool_or(F.col("_inside").isNull()).alias("outside"),
    )
    rule = (
        F.when(F.col("traversal"), "path traversal").when(F.col("elsewhere"), "outside task file")
        .when(F.col("paths") == 0, "no files").when(F.col("test"), "test file").when(F.col("manifest"), "manifest")
        .when(F.col("outside") & F.lit(not allows_new), "outside radius").otherwise("ok")
    )
    return flags.select(*key, rule.alias("rule"))


def scope_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Rows on one side only: 'unexpected' was done but not foreseen, 'untouched' the reverse."""
    left = actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    right = expected.select(*keys).distinct().withColumn("_e", F.lit(True))
    both = left.join(right, keys, "full").filter(F.col("_a").isNull() | F.col("_e").isNull())
    return both.select(*keys, F.when(F.col("_e").isNull(), "unexpected").otherwise("untouched").alias("side"))


def note_pieces(names: DataFrame, notes: DataFrame, block: int = 4096) -> DataFrame:
    """(job_id, name), distinct: pieces of each job's notes among which all names are that stand inside some note of their job.

    ``names`` has (job_id, name), ``notes`` (job_id, note), both in lower case. A note yields its pieces that are as long as some name
    of its job and end with the last letter of one of that length. A name is told if it equals a piece, so no name meets a note.
    The lengths of a job's names and their last letters are few whatever the job holds; long notes are read in blocks of ``block``
    code points. Null names and notes match nothing; an empty name is in every note.
    """
    shapes = names.filter(F.col("name").isNotNull()).groupBy("job_id", F.char_length("name").alias("size")).agg(F.collect_set(F.right("name", F.lit(1))).alias("ends"))
    told = notes.filter(F.col("note").isNotNull()).select("job_id", "note").join(shapes, "job_id")
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("note"), F.lit(1)), F.lit(block))
    blocks = told.select("job_id", "size", "ends", F.explode(F.transform(starts, lambda at: F.substring("note", at, F.lit(block - 1) + F.greatest(F.col("size"), F.lit(1))))).alias("block"))
    last = F.least(F.lit(block), F.char_length("block") - F.col("size") + 1)
    pieces = F.transform(F.sequence(F.lit(1), last), lambda at: F.substring("block", at, F.col("size")))
    ending = F.filter(pieces, lambda piece: F.array_contains("ends", F.right(piece, F.lit(1))))
    return blocks.filter(F.char_length("block") >= F.col("size")).select("job_id", F.explode(ending).alias("name")).distinct()


def plan_gaps(call_files: DataFrame, planned: DataFrame, notes: DataFrame, discarded: DataFrame) -> DataFrame:
    """(job_id, path, kind, severity) of call files without a task, or whose task was discarded.

    ``notes`` has one row per note (job_id, note); a note that holds the path or its base name explains the file, and whatever
    holds the path holds its base name. Case does not count.
    """
    files = call_files.select("job_id", "path").distinct()
    # Read twice: for the shapes of its names and for the answer.
    open_files = materialise(
        files.join(planned.select("job_id", "path").distinct(), ["job_id", "path"], "left_anti")
        .withColumn("name", F.lower(F.element_at(F.split("path", "/"), -1)))
    )
    told = note_pieces(open_files, notes.select("job_id", F.lower("note").alias("note"))).withColumn("told", F.lit(True))
    explained = open_files.join(told, ["job_id", "name"], "left").select(
        "job_id", "path",
        F.when(F.col("told"), "call_site_declined").otherwise("incomplete_plan").alias("kind"),
        F.when(F.col("told"), "info").otherwise("block").alias("severity"),
    )
    dropped = files.join(discarded.select("job_id", "path").distinct(), ["job_id", "path"], "left_semi").select(
        "job_id", "path", F.lit("unmigrated_call_site").alias("kind"), F.lit("warn").alias("severity")
    )
    return explained.unionByName(dropped)


def call_sites_changed(sites: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Every call site with a flag: was its baseline line changed?"""
    hit = changed.select(*keys, "line").distinct().withColumn("changed", F.lit(True))
    return sites.join(hit, [*keys, "line"], "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def dynamic_paths_exercised(sites: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds exercised: NULL where the graph has no coverage at all, else whether a test ran the line."""
    measured = coverage.select("graph_id").distinct().withColumn("_measured", F.lit(True))
    ran = coverage.filter("executed").select("graph_id", "path", "line").distinct().withColumn("_ran", F.lit(True))
    unique = sites.select("graph_id", "path", "line", "name").distinct()
    return unique.join(ran, ["graph_id", "path", "line"], "left").join(measured, "graph_id", "left").select(
        "graph_id", "path", "line", "name",
        F.when(F.col("_measured"), F.coalesce("_ran", F.lit(False))).alias("exercised"),
    )


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", fingerprint("rule", "path", "snippet"))


def new_findings(before: DataFrame, after: DataFrame, keys: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Findings after whose fingerprint was not there before, in touched files when those are given."""
    known = with_fingerprint(before).select(*keys, "fingerprint").distinct()
    fresh = with_fingerprint(after)
    if touched is not None:
        fresh = fresh.join(touched.select(*keys, "path").distinct(), [*keys, "path"], "left_semi")
    return fresh.join(known, [*keys, "fingerprint"], "left_anti")


def findings_status(scanned: DataFrame, before: DataFrame, after: DataFrame, introduced: DataFrame, keys: list[str]) -> DataFrame:
    """One row per change: inconclusive when either side had no files, else security or ok.

    ``scanned`` has (keys, side) for every file scanned.
    """
    sides = scanned.groupBy(*keys).agg(
        F.count_if(F.col("side") == "before").alias("files_before"), F.count_if(F.col("side") == "after").alias("files_after")
    )
    n = F.count(F.lit(1))
    out = sides
    for df, name in ((before, "baseline_findings"), (after, "result_findings"), (introduced, "introduced")):
        out = out.join(df.groupBy(*keys).agg(n.alias(name)), keys, "left")
    out = out.fillna(0)
    verdict = F.when((F.col("files_before") == 0) | (F.col("files_after") == 0), "inconclusive").when(
        F.col("introduced") > 0, "security"
    ).otherwise("ok")
    return out.withColumn("verdict", verdict)


def undeclared_removals(before: DataFrame, after: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, fqn) exported before, gone after, and declared neither in full nor by its last part."""
    gone = before.select(*keys, "path", "fqn").distinct().join(after.select(*keys, "path", "fqn"), [*keys, "path", "fqn"], "left_anti")
    names = declared.select(*keys, "name").distinct()
    full = names.withColumnRenamed("name", "fqn")
    return gone.join(full, [*keys, "fqn"], "left_anti").withColumn("name", last_part("fqn")).join(
        names, [*keys, "name"], "left_anti"
    ).drop("name")


def moved_symbols(declared: DataFrame, exports: DataFrame, keys: list[str]) -> DataFrame:
    """Declared removals that reappear somewhere, by full name or last part."""
    spellings = exports.select(*keys, F.explode(F.array("fqn", last_part("fqn"))).alias("name")).distinct()
    return declared.select(*keys, "name").distinct().join(spellings, [*keys, "name"], "left_semi")


def coverage_drops(before: DataFrame, after: DataFrame, touched: DataFrame, keys: list[str]) -> DataFrame:
    """Touched files measured on both sides whose percentage fell."""
    return (
        before.select(*keys, F.col("percent").alias("before"))
        .join(after.select(*keys, F.col("percent").alias("after")), keys)
        .join(touched.select(*keys).distinct(), keys, "left_semi")
        .filter(F.col("after") < F.col("before"))
    )


def test_count_ok(before: Column, after: Column) -> Column:
    """Equal counts; NULL, for unknown, when either was never measured."""
    return before == after


def unexecuted_changed_lines(changed: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Changed lines that coverage lists as missing and no test executed."""
    state = coverage.groupBy(*keys, "line").agg(F.bool_or("executed").alias("executed"))
    gaps = state.filter(~F.col("executed")).drop("executed")
    return changed.select(*keys, "line").distinct().join(gaps, [*keys, "line"], "left_semi")


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    s = F.col("severity")
    return findings.groupBy(*keys).agg(
        F.count_if(s == "block").alias("blocks"), F.count_if(s == "warn").alias("warnings"),
        F.count(F.lit(1)).alias("findings"), F.bool_or(s == "block").alias("blocked"),
    )

"""Scoring of runs: benchmark arms, fault detection, discarded work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions.codes import is_infrastructure
from impactlens.plans.ordering import exact_median


def bucket() -> Column:
    """verified, unverified (caveats only), infrastructure or merit, in that precedence."""
    caveats = F.col("error_code").isNull() & (F.col("outcome") == "UNVERIFIED") & (F.col("cause") == "caveats")
    infra = (F.coalesce("outcome", F.lit("")) == "ERROR") | is_infrastructure("error_code")
    return (
        F.when(F.col("verified"), "verified").when(F.coalesce(caveats, F.lit(False)), "unverified")
        .when(infra, "infrastructure").otherwise("merit")
    )


def score_arms(outcomes: DataFrame, bounded: bool = False) -> DataFrame:
    """One row per arm. Infrastructure results leave the denominator; 0 denominators give NULL."""
    b = F.col("bucket")
    rows = outcomes.withColumn("bucket", bucket())
    checked = (b == "verified") & F.col("oracle").isNotNull()

    def exact_sum(c: str, scale: int = 6) -> Column:
        return F.sum(F.col(c).cast(f"decimal(30,{scale})"))

    arms = rows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(b == "verified").alias("verified"), F.count_if(b == "unverified").alias("unverified"),
        F.count_if(b == "merit").alias("failed_on_merit"), F.count_if(b == "infrastructure").alias("excluded"),
        F.sum("tokens").alias("tokens"), F.sum("failed_attempts").alias("failed_attempts"),
        exact_sum("duration_s").alias("duration"), exact_sum("sandbox_cost").alias("cost"),
        F.count_if(checked).alias("checked"), F.count_if(checked & ~F.col("oracle")).alias("false_accepts"),
    )
    median = exact_median(
        rows.filter(b == "verified").select("arm", "duration_s"), ["arm"], "duration_s", bounded
    ).withColumnRenamed("median", "median_time")
    verified = F.nullif(F.col("verified"), F.lit(0))
    scored = F.nullif(F.col("verified") + F.col("unverified") + F.col("failed_on_merit"), F.lit(0))
    return arms.join(median, "arm", "left").select(
        "arm", "attempted", "verified", "unverified", "failed_on_merit", F.col("excluded").alias("excluded_infrastructure"),
        F.bround(F.col("verified") / scored, 3).alias("verified_rate"),
        F.when(F.col("checked") > 0, F.concat_ws("/", F.col("false_accepts").cast("string"), F.col("checked").cast("string"))).alias("false_accepts"),
        F.bround(F.col("tokens") / verified, 0).cast("long").alias("tokens_per_verified"),
        F.bround(F.col("failed_attempts") / verified, 1).alias("failed_attempts_per_verified"),
        F.bround("median_time", 1).alias("median_time_to_verified_s"),
        F.bround(F.nullif(F.col("cost"), F.lit(0)).cast("double"), 4).alias("sandbox_cost"),
        F.bround(F.col("duration").cast("double"), 1).alias("wall_clock_s"),
    )


def exclusions(outcomes: DataFrame) -> DataFrame:
    """Every result left out as infrastructure, by name and code, so a reader can disagree."""
    return outcomes.withColumn("bucket", bucket()).filter(F.col("bucket") == "infrastructure").select(
        "arm", "task_id", F.coalesce("error_code", F.lit("")).alias("code")
    )


def false_accepts(claims: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """Claims joined to an independent check: accepted but wrong; a claim without a check counts neither way."""
    joined = claims.filter("verified").join(oracle.select(*keys, "accepted"), keys, "left")
    return joined.withColumn("false_accept", F.col("accepted").isNotNull() & ~F.coalesce("accepted", F.lit(True)))


def discard_ratio(tasks: DataFrame, keys: list[str], max_ratio: float) -> DataFrame:
    """Discarded over all tasks; 0 while nothing is settled."""
    settled = F.count_if(F.col("state").isin("verified", "discarded"))
    ratio = F.when(settled == 0, 0.0).otherwise(F.count_if(F.col("state") == "discarded") / F.count(F.lit(1)))
    return tasks.groupBy(*keys).agg(ratio.alias("ratio")).withColumn("over_cap", F.col("ratio") > max_ratio)


def fault_class(exit_code: Column | str) -> Column:
    """0: the tests stayed green over broken code; 1: they noticed; anything else measured nothing."""
    code = F.col(exit_code) if isinstance(exit_code, str) else exit_code
    return F.when(code == 0, "survived").when(code == 1, "detected").otherwise("incompetent")


def fault_score(results: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Per group: counts, score (NULL when nothing was scoreable), status and whether it is below the floor."""
    kind = F.col("_class")
    counts = results.withColumn("_class", fault_class("exit_code")).groupBy(*keys).agg(
        F.count_if(kind == "detected").alias("detected"), F.count_if(kind == "survived").alias("survived"),
        F.count_if(kind == "incompetent").alias("incompetent"),
    )
    score = F.col("detected") / F.nullif(F.col("detected") + F.col("survived"), F.lit(0))
    return counts.withColumn("score", score).withColumn(
        "status", F.when(F.col("score").isNull(), "no_mutants").otherwise("measured")
    ).withColumn("below_floor", F.coalesce(F.col("score") < floor, F.lit(False)))


def job_status(jobs: DataFrame, tasks: DataFrame, radius_payloads: DataFrame) -> DataFrame:
    """Task counts by state and the size of the latest radius, one row per job.

    ``radius_payloads`` has (job_id, payload) of each job's latest radius event.
    """
    s = F.col("state")
    counts = tasks.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if(s == "verified").alias("verified"),
        F.count_if(s == "discarded").alias("discarded"), F.count_if(~s.isin("verified", "discarded")).alias("open"),
    )
    body = F.from_json("payload", "files ARRAY<STRING>, tests ARRAY<STRING>, unresolved ARRAY<STRING>")
    sizes = radius_payloads.select("job_id", body.alias("_r")).select(
        "job_id", *[F.coalesce(F.size(f"_r.{c}"), F.lit(0)).alias(f"radius_{c}") for c in ("files", "tests", "unresolved")]
    )
    return jobs.select("job_id", F.col("state").alias("state")).join(counts, "job_id", "left").join(
        sizes, "job_id", "left"
    ).fillna(0, ["tasks", "verified", "discarded", "open"])


def first_success(attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, best failures) per task: the first green attempt, else the most telling failure.

    ``attempts`` has (task_id, attempt_id, finished, green, verdict, has_report).
    """
    winners = attempts.filter("green").groupBy("task_id").agg(
        F.min_by("attempt_id", F.struct("finished", "attempt_id")).alias("attempt_id")
    )
    worth = (
        F.when(F.col("verdict") == "infrastructure", -1).when(F.col("has_report").isNull(), 0)
        .when(F.col("has_report"), 2).otherwise(1)
    )
    failures = attempts.filter(~F.col("green")).join(winners.select("task_id"), "task_id", "left_anti").groupBy("task_id").agg(
        F.max(F.struct(worth.alias("worth"), "attempt_id")).alias("_best")
    )
    return winners, failures.select("task_id", F.col("_best.attempt_id").alias("attempt_id"), F.col("_best.worth").alias("worth"))


def winning_diffs(tasks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(job_id, seq, path): the latest diff of each task's winning attempt."""
    latest = artifacts.filter(F.col("kind") == "diff").groupBy("attempt_id").agg(
        F.max_by("path", F.struct("created_at", "artifact_id")).alias("path")
    )
    return tasks.filter(F.col("winning_attempt_id").isNotNull()).select(
        "job_id", "seq", F.col("winning_attempt_id").alias("attempt_id")
    ).join(latest, "attempt_id").select("job_id", "seq", "attempt_id", "path")

"""Order in the event log: time in each state, holes in the numbering, the newest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlens.functions.text import is_terminal_event
from impactlens.plans.ordering import with_previous


def phase_durations(events: DataFrame, state: Column, bounded: bool = False) -> DataFrame:
    """(job_id, state, visits, micros): time from each entry to the next event of the same job."""
    rows = events.select("job_id", "seq", "ts", state.alias("state"))
    placed = with_previous(rows, ["job_id"], [F.col("seq")], ["state", "ts"], bounded)
    spent = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    return placed.filter(F.col("prev_state").isNotNull()).groupBy("job_id", F.col("prev_state").alias("state")).agg(
        F.count(F.lit(1)).alias("visits"), F.sum(spent).alias("micros")
    )


def seq_gaps(events: DataFrame, keys: list[str], bounded: bool = False) -> DataFrame:
    """(keys, first, last) of the missing sequence numbers between neighbours."""
    placed = with_previous(events.select(*keys, "seq").distinct(), keys, [F.col("seq")], ["seq"], bounded)
    return placed.filter(F.col("seq") - F.col("prev_seq") > 1).select(
        *keys, (F.col("prev_seq") + 1).alias("first"), (F.col("seq") - 1).alias("last")
    )


def recent_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs; the limit is the page a reader asked for."""
    return jobs.orderBy(F.col("created_at").desc(), F.col("job_id").desc()).limit(limit)


def terminal_events(events: DataFrame) -> DataFrame:
    """(job_id, seq) of the first event after which a job says nothing more."""
    return events.filter(is_terminal_event("kind", "payload")).groupBy("job_id").agg(F.min("seq").alias("seq"))

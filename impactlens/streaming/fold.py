"""The event log as a stream: replay then live, folded state, running ledgers, open attempts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.functions.text import TERMINAL_STATES
from impactlens.operators.ledger import ledger_by_role, model_calls
from impactlens.plans.ordering import first_rows, single_best
from impactlens.schemas import schema_of

# Events whose latest payload is kept as it is.
KEPT = (
    "baseline.ready", "graph.built", "radius.computed", "characterise.result", "cleanup.planned", "cleanup.result",
    "cleanup.skipped", "security.result", "impact.result", "strength.result", "integration.result", "pr.opened",
)
_PAYLOAD = (
    "state STRING, reason STRING, task_id STRING, attempt_id STRING, verdict STRING, winning_attempt_id STRING, "
    "url STRING, tasks ARRAY<STRUCT<id: STRING>>"
)


def each_once(events: DataFrame, after_seq: int | None = None, lateness: str = "1 hour") -> DataFrame:
    """Each (job, seq) once, resuming after a number; repeats within the lateness are known from state, older ones fall to the watermark."""
    rows = events if after_seq is None else events.filter(F.col("seq") > after_seq)
    return rows.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["job_id", "seq", "kind"])


def read_event_stream(spark: SparkSession, directory: str, after_seq: int = 0, lateness: str = "1 hour") -> DataFrame:
    """History, then live: the same directory either way, each (job, seq) once, resuming after a seq."""
    return each_once(spark.readStream.schema(schema_of("event")).parquet(directory), after_seq, lateness)


def slots(events: DataFrame) -> DataFrame:
    """(job_id, slot, id, rank, seq, value): what each event writes into the state of its job.

    Within a slot the highest (rank, seq) wins, so neither arrival order nor partial sums matter and a
    busy job is folded on many tasks before its rows meet.
    """
    p = F.from_json("payload", _PAYLOAD)
    k = F.col("kind")
    state = F.when(k == "job.stopped", "NoPR").when(k == "job.state", F.col("_p.state"))
    working = state.isNotNull() & (k == "job.state") & ~state.isin(*TERMINAL_STATES)

    def entry(slot: str, ident: Column, value: Column, keep: Column, rank: int = 0) -> Column:
        return F.when(keep, F.struct(
            F.lit(slot).alias("slot"), ident.cast("string").alias("id"), F.lit(rank).alias("rank"), value.cast("string").alias("value"),
        ))

    none = F.lit("")
    attempt, task = F.col("_p.attempt_id"), F.col("_p.task_id")
    planned = k.isin("plan.ready", "cleanup.tasks_created")
    winner = F.when(F.col("_p.winning_attempt_id").isNotNull(), "verified").otherwise("discarded")
    listed = F.transform(
        F.when(planned, F.col("_p.tasks")),
        lambda t: F.struct(F.lit("task").alias("slot"), t["id"].alias("id"), F.lit(0).alias("rank"), F.lit("pending").alias("value")),
    )
    single = F.array_compact(F.array(
        entry("state", none, state, state.isNotNull()), entry("reached", none, state, working), entry("visited", state, state, working),
        entry("stop_reason", none, F.col("_p.reason"), k.isin("job.state", "job.stopped") & F.col("_p.reason").isNotNull()),
        entry("task", task, F.lit("running"), (k == "attempt.started") & task.isNotNull(), 1),
        entry("task", task, winner, (k == "task.settled") & task.isNotNull(), 2),
        entry("attempt", attempt, F.lit("running"), (k == "attempt.started") & attempt.isNotNull()),
        entry("attempt", attempt, F.col("_p.verdict"), (k == "attempt.verdict") & attempt.isNotNull(), 1),
        entry("latest", k, F.col("payload"), k.isin(*KEPT)),
        entry("pr_url", none, F.col("_p.url"), k == "pr.opened"),
    ))
    rows = events.withColumn("_p", p)
    empty = F.array().cast("array<struct<slot:string,id:string,rank:int,value:string>>")
    return rows.select(
        "job_id", "seq", F.explode(F.concat(single, F.coalesce(listed, empty))).alias("_s")
    ).select("job_id", "seq", "_s.*")


def fold_state(events: DataFrame) -> DataFrame:
    """(job_id, slot, id, value): the folded state, for a stream (update or complete mode) or a batch.

    A task seen only in later events, never in a plan, has ``planned`` false and is no task of the board.
    """
    order = F.struct("rank", "seq")
    return slots(events).groupBy("job_id", "slot", "id").agg(
        F.max_by("value", order).alias("value"), F.max("seq").alias("last_seq"),
        F.min("seq").alias("first_seq"), (F.min("rank") == 0).alias("planned"),
    )


def stream_ledger(events: DataFrame) -> DataFrame:
    """The ledger of a stream of events, growing as calls arrive."""
    return ledger_by_role(model_calls(events))


def open_attempts(events: DataFrame, lateness: str = "10 minutes", patience: str = "30 minutes") -> DataFrame:
    """(job_id, attempt_id, started, verdict): attempts joined to their verdict, 'cancelled' when none came in time."""
    attempt = F.get_json_object("payload", "$.attempt_id")
    started = events.filter(F.col("kind") == "attempt.started").select(
        "job_id", attempt.alias("attempt_id"), F.col("ts").alias("started")
    ).withWatermark("started", lateness)
    ended = events.filter(F.col("kind") == "attempt.verdict").select(
        F.col("job_id").alias("_job"), attempt.alias("_attempt"), F.get_json_object("payload", "$.verdict").alias("_verdict"),
        F.col("ts").alias("ended"),
    ).withWatermark("ended", lateness)
    cond = (
        (F.col("job_id") == F.col("_job")) & (F.col("attempt_id") == F.col("_attempt"))
        & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {patience}"))
    )
    return started.join(ended, cond, "left_outer").select(
        "job_id", "attempt_id", "started", F.coalesce("_verdict", F.lit("cancelled")).alias("verdict")
    )


def newest_per_job(events: DataFrame, keep: int = 400) -> DataFrame:
    """The newest entries of each job, for a reader's bounded log view."""
    return first_rows(events, ["job_id"], [F.col("seq").desc()], keep).drop("rn")


class KeyedSink:
    """A foreachBatch sink for update mode: the newest row of each key, in folders of a directory that are each written whole.

    A batch that runs again replaces its own folder, so rows count once. After every ``compact_every`` batches the view is written as
    one base folder; the folders it holds are deleted only when it is complete, and readers take the newest base and what came
    after it. With ``merge`` the view is made by that function instead, as for a bounded log.
    """

    def __init__(self, directory: str, keys: list[str], compact_every: int = 10, merge: Callable[[DataFrame], DataFrame] | None = None):
        self.directory, self.keys, self.compact_every, self.merge = directory.rstrip("/"), keys, compact_every, merge

    def _folders(self, spark: SparkSession) -> list[tuple[int, str]]:
        """(epoch, kind) of the complete folders."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.directory)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = []
        for entry in fs.listStatus(path):
            kind, _, epoch = entry.getPath().getName().partition("-")
            done = spark._jvm.org.apache.hadoop.fs.Path(entry.getPath(), "_SUCCESS")
            if kind in ("base", "batch") and fs.exists(done):
                found.append((int(epoch), kind))
        return sorted(found)

    def _live(self, spark: SparkSession) -> list[tuple[int, str]]:
        folders = self._folders(spark)
        base = max((e for e, kind in folders if kind == "base"), default=-1)
        return [(e, kind) for e, kind in folders if e > base or (e == base and kind == "base")]

    def read(self, spark: SparkSession, schema) -> DataFrame:
        parts = [spark.read.schema(schema).parquet(f"{self.directory}/{kind}-{e}").withColumn("_epoch", F.lit(e)) for e, kind in self._live(spark)]
        if not parts:
            return spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, parts)
        if self.merge:
            return self.merge(rows.drop("_epoch"))
        return single_best(rows, self.keys, [F.col("_epoch")], descending=True).select(*parts[0].drop("_epoch").columns)

    def write(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if any(kind == "base" and e >= epoch for e, kind in self._folders(spark)):
            return  # it ran before and is in the base
        rows = self.merge(batch) if self.merge else batch
        rows.write.mode("overwrite").parquet(f"{self.directory}/batch-{epoch}")
        if len(self._live(spark)) >= self.compact_every:
            old = self._folders(spark)
            self.read(spark, batch.schema).write.mode("overwrite").parquet(f"{self.directory}/base-{epoch}")
            for e, kind in old:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.directory}/{kind}-{e}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def newest_sink(directory: str, keep: int = 400, compact_every: int = 10) -> KeyedSink:
    """A bounded view of the newest entries of each job; repeats count once."""
    return KeyedSink(directory, ["job_id"], compact_every, lambda rows: newest_per_job(rows.dropDuplicates(["job_id", "seq"]), keep))


def run_into(stream: DataFrame, sink: KeyedSink, checkpoint: str, mode: str = "update") -> DataFrame:
    """Runs a stream over all that is there, into the sink, and returns the sink's view."""
    stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sink.read(stream.sparkSession, stream.schema)

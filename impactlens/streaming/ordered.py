"""Rows of a stream in the order of their numbers, whatever files and batches they came in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: The job of rows that carry no event and only move the watermark on, as when a log ends.
HEARTBEAT = ""


def _pack(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Ordered(StatefulProcessor):
    """Holds rows by stretches of event time and hands each stretch on, by job and ``seq``, once the watermark has passed it.

    The stream is grouped by lanes, each the jobs of one hash, since a state handle costs more than the rows of a quiet job. State has one
    packed row per lane and open stretch, removed when it is handed on, and one small row per job: the highest number and the
    time reached, and the fields of ``MEMORY``. A task holds one stretch of one lane at once. A number handed on once is not
    handed on again. Jobs from which nothing came for ``forget_ms`` of event time lose their state.
    """

    #: Further fields kept per job.
    MEMORY = ""
    #: Whether the row of a silent job goes.
    FORGETS = True

    def __init__(self, stretch_ms: int, forget_ms: int):
        self.stretch_ms, self.forget_ms = stretch_ms, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "stretch BIGINT", "rows BINARY")
        self.jobs = handle.getMapState("jobs", "job_id STRING", "seq BIGINT, ms BIGINT" + (self.MEMORY and ", " + self.MEMORY))
        self.sweep = handle.getValueState("sweep", "ms BIGINT")

    def release(self, job: str, rows: pd.DataFrame, reached: int | None, memory: tuple) -> tuple[pd.DataFrame | None, tuple]:
        """The output for the next rows of a job and its new memory; ``reached`` is the number before them, memory is empty at first."""
        raise NotImplementedError

    def forget(self, jobs: set[str]) -> None:
        """Clears what a subclass keeps elsewhere for silent jobs."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for batch in rows:
            batch = batch[batch["job_id"] != HEARTBEAT]
            stretch = batch["ms"].to_numpy() // self.stretch_ms
            for number in map(int, np.unique(stretch)):
                part = batch[stretch == number]
                if self.waiting.containsKey((number,)):
                    part = pd.concat([_unpack(self.waiting.getValue((number,))[0]), part])
                else:
                    self.handle.registerTimer((number + 1) * self.stretch_ms)
                self.waiting.updateValue((number,), (_pack(part.drop_duplicates(["job_id", "seq"])),))
        return iter(())

    def _handed_on(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = rows.sort_values(["job_id", "seq"], kind="stable")
        names = rows["job_id"].to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
        outs = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            job, part = names[a], rows.iloc[a:b]
            known = tuple(self.jobs.getValue((job,))) if self.jobs.containsKey((job,)) else None
            if known:
                part = part[part["seq"].to_numpy() > known[0]]
                if not len(part):
                    continue
            out, memory = self.release(job, part, known and known[0], known[2:] if known else ())
            self.jobs.updateValue((job,), (int(part["seq"].iloc[-1]), int(part["ms"].iloc[-1]), *memory))
            if out is not None:
                outs.append(out)
        if outs:
            yield pd.concat(outs, ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        for number in sorted(n for (n,) in self.waiting.keys() if (n + 1) * self.stretch_ms <= now):
            rows = _unpack(self.waiting.getValue((number,))[0])
            self.waiting.removeKey((number,))
            yield from self._handed_on(rows)
            if not self.sweep.exists():
                self._sweep_at(int(rows["ms"].min()) + self.forget_ms, now)
        if self.sweep.exists() and self.sweep.get()[0] <= now:
            self.sweep.clear()
            reached = {job: value[1] for (job,), value in self.jobs.iterator()}
            silent = {job for job, ms in reached.items() if ms + self.forget_ms <= now}
            self.forget(silent)
            for job in silent if self.FORGETS else ():
                self.jobs.removeKey((job,))
            if rest := [ms for job, ms in reached.items() if job not in silent]:
                self._sweep_at(min(rest) + self.forget_ms, now)

    def _sweep_at(self, ms: int, now: int) -> None:
        """Silent jobs are looked for again at this time; one such timer a lane."""
        self.sweep.update((max(ms, now + 1),))
        self.handle.registerTimer(max(ms, now + 1))

    def close(self) -> None:
        pass


def milliseconds(spark, interval: str) -> int:
    return int(spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {interval})").first()[0])


def in_order(
    rows: DataFrame, processor: type[Ordered], schema: str, lateness: str, stretch: str, forget: str, lanes: int | None = None, **options
) -> DataFrame:
    """The stream of ``processor`` over (job_id, seq, ts, ...), each job's rows by ``seq``.

    Within a job the time must not fall as the number rises. A row may come up to ``lateness`` of event time behind the newest
    row of all; later ones are dropped by the watermark. ``stretch`` is how much of a job is sorted at once, ``forget`` after what
    silence a job's state goes. Rows without a job, a number or a time have no place in the order and are left out. The last
    stretches come out when later rows or a heartbeat (job ``HEARTBEAT``) move the watermark past them. ``lanes`` are four for each
    shuffle partition where not given; like those, a checkpoint keeps them.
    """
    spark = rows.sparkSession
    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.filter(F.col("job_id").isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", lateness)
    placed = placed.withColumns({"ms": F.unix_millis("ts"), "lane": F.pmod(F.xxhash64("job_id"), F.lit(lanes)).cast("int")})
    made = processor(stretch_ms=milliseconds(spark, stretch), forget_ms=milliseconds(spark, forget), **options)
    return placed.groupBy("lane").transformWithStateInPandas(made, schema, "Append", "EventTime")

"""Stateful guards over an event stream: holes in the numbering, closing, and token budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlens.functions.text import is_terminal_event
from impactlens.streaming.ordered import Ordered, in_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Custom state needs the RocksDB provider; it also keeps large state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Gaps(Ordered):
    def release(self, job, rows, reached, memory):
        seqs = rows["seq"].to_numpy()
        if reached is not None:
            seqs = np.concatenate([[reached], seqs])
        wide = np.flatnonzero(np.diff(seqs) > 1)
        return pd.DataFrame({"job_id": job, "first": seqs[wide] + 1, "last": seqs[wide + 1] - 1}) if len(wide) else None, ()


def detect_gaps(events: DataFrame, lateness: str = "1 hour", stretch: str = "10 minutes", forget: str = "7 days") -> DataFrame:
    """(job_id, first, last) of numbers that did not come within the lateness: a reader has to replay them.

    Rows are judged in the order of their numbers (``ordered.in_order``), so the files and batches they come in make no difference.
    """
    rows = events.select("job_id", "seq", "ts")
    return in_order(rows, _Gaps, "job_id STRING, first BIGINT, last BIGINT", lateness, stretch, forget)


class _Closing(Ordered):
    MEMORY = "closes_us BIGINT"

    def __init__(self, drain_ms: int, **times):
        super().__init__(**times)
        self.drain_ms = drain_ms

    def release(self, job, rows, reached, memory):
        end = memory[0] if memory else None
        terminal = rows["terminal"].to_numpy()
        if end is None and terminal.any():
            end = int(rows["us"].iloc[int(terminal.argmax())]) + self.drain_ms * 1000
        late = np.zeros(len(rows), bool) if end is None else rows["us"].to_numpy() > end
        return rows[["job_id", "seq", "ts", "kind", "payload"]].assign(route=np.where(late, "late", "main")), (end,)


def close_on_terminal(
    events: DataFrame, drain_ms: int = 1500, lateness: str = "1 hour", stretch: str = "10 minutes", forget: str = "7 days"
) -> DataFrame:
    """Adds route: 'main' up to a short drain after the job's first terminal event by number, 'late' behind it."""
    flagged = events.select(
        "job_id", "seq", "ts", "kind", "payload", F.coalesce(is_terminal_event("kind", "payload"), F.lit(False)).alias("terminal"), F.unix_micros("ts").alias("us")
    )
    schema = "job_id STRING, seq BIGINT, ts TIMESTAMP, kind STRING, payload STRING, route STRING"
    return in_order(flagged, _Closing, schema, lateness, stretch, forget, drain_ms=drain_ms)


def _judge(spent: int, budget: int, op: str, estimate: int, actual: int) -> tuple[int, bool]:
    """Balance after one operation, and whether it was granted."""
    if op == "reserve":
        return (spent, False) if spent + estimate > budget else (spent + estimate, True)
    if op == "settle":
        return spent + actual - estimate, True
    if op == "release":
        return spent - estimate, True
    return spent + actual, True


BUDGET_ROW = "job_id STRING, seq BIGINT, op STRING, granted BOOLEAN, spent BIGINT, remaining BIGINT"


def _judged(batch: pd.DataFrame, balances: dict[str, int], refused: set) -> pd.DataFrame:
    columns = ["job_id", "op", "call_id", "estimate", "actual", "budget"]
    spents, grants, left = [], [], []
    for job, op, call, estimate, actual, budget in zip(*[batch[c].tolist() for c in columns], strict=True):
        spent = balances.get(job, 0)
        follows_refusal = op in ("settle", "release") and (job, call) in refused
        if follows_refusal:
            granted = False
        else:
            spent, granted = _judge(spent, budget, op, estimate, actual)
        if op == "reserve" and not granted and call is not None:
            refused.add((job, call))
        balances[job] = spent
        spents.append(spent)
        grants.append(granted)
        left.append(max(0, budget - spent))
    return batch[["job_id", "seq", "op"]].assign(granted=np.array(grants, dtype=bool), spent=spents, remaining=left)


class _Refused:
    """Refused calls: those of the rows at hand, and those in state, looked up one by one."""

    def __init__(self, stored):
        self.stored, self.new = stored, set()

    def __contains__(self, call: tuple[str, str]) -> bool:
        return call in self.new or (call[1] is not None and self.stored.containsKey(call))

    def add(self, call: tuple[str, str]) -> None:
        self.new.add(call)
        self.stored.updateValue(call, (True,))


class _Budget(Ordered):
    MEMORY = "spent BIGINT"
    #: The balance of a job stays, one number; calls refused long ago are settled or given up.
    FORGETS = False

    def init(self, handle) -> None:
        super().init(handle)
        self.refused = handle.getMapState("refused", "job_id STRING, call_id STRING", "refused BOOLEAN")

    def release(self, job, rows, reached, memory):
        balances = {job: memory[0] if memory else 0}
        out = _judged(rows, balances, _Refused(self.refused))
        return out, (int(balances[job]),)

    def forget(self, jobs) -> None:
        for call in [c for c in self.refused.keys() if c[0] in jobs]:
            self.refused.removeKey(call)


def budget_guard(operations: DataFrame, lateness: str = "1 hour", stretch: str = "10 minutes", forget: str = "7 days") -> DataFrame:
    """Grants or refuses each (job_id, seq, ts, op, call_id, estimate, actual, budget) in the order of the numbers.

    A refused reservation does not count, and neither does what follows on the same call.
    """
    rows = operations.select("job_id", "seq", "ts", "op", "call_id", "estimate", "actual", "budget")
    return in_order(rows, _Budget, BUDGET_ROW, lateness, stretch, forget)


def budget_replay(operations: DataFrame) -> DataFrame:
    """The batch twin. Each refusal changes later balances, so a job is read once in order, row by row.

    Rows stream through in Arrow batches; a task holds one balance per job, never a whole group.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        balances: dict[str, int] = {}
        refused: set = set()
        for batch in batches:
            yield _judged(batch, balances, refused)
            current = batch["job_id"].iloc[-1] if len(batch) else None
            balances = {k: v for k, v in balances.items() if k == current}
            refused = {r for r in refused if r[0] == current}

    ordered = operations.repartition(F.col("job_id")).sortWithinPartitions("job_id", "seq")
    return ordered.mapInPandas(run, BUDGET_ROW)

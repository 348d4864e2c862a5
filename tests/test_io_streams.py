import datetime as dt
import json

from pyspark.sql import functions as F

from impactlens.operators import timeline
from impactlens.plans import stream_queries
from impactlens.schemas import schema_of
from impactlens.session import materialise
from impactlens.sources import artifacts, diffs, events
from impactlens.streaming import fold, guards

T0 = dt.datetime(2025, 1, 1)


def log(spark, *items):
    """(seq, kind, payload[, job[, seconds]])"""
    out = []
    for seq, kind, payload, *rest in items:
        job, seconds = (rest + [None, None])[:2]
        out.append((seq, job or "j", T0 + dt.timedelta(seconds=seconds if seconds is not None else seq), kind, json.dumps(payload)))
    return spark.createDataFrame(out, schema_of("event"))


def drain(stream, path, mode="append"):
    run = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check")
        .outputMode(mode).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def memory(stream, name, mode):
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


STORY = [
    (1, "job.state", {"state": "Ingesting"}), (2, "plan.ready", {"tasks": [{"id": "t1"}, {"id": "t2"}, {"id": "t3"}]}), (3, "job.state", {"state": "Executing"}),
    (4, "attempt.started", {"task_id": "t1", "attempt_id": "a1"}), (5, "attempt.started", {"task_id": "t2", "attempt_id": "a2"}),
    (6, "attempt.verdict", {"attempt_id": "a1", "verdict": "ok"}), (7, "task.settled", {"task_id": "t1", "winning_attempt_id": "a1"}),
    (8, "task.settled", {"task_id": "t3", "discard_reason": "x"}), (9, "impact.result", {"v": 1}), (10, "impact.result", {"v": 2}),
    (11, "pr.opened", {"url": "u"}), (12, "job.state", {"state": "Done", "reason": "fine"}), (13, "task.settled", {"task_id": "ghost"}),
]


def test_fold(spark):
    got = {(r.slot, r.id): r for r in fold.fold_state(log(spark, *STORY)).collect()}
    value = {k: r.value for k, r in got.items()}
    assert value["state", ""] == "Done" and value["reached", ""] == "Executing" and value["stop_reason", ""] == "fine" and value["pr_url", ""] == "u"
    assert {k[1] for k in value if k[0] == "visited"} == {"Ingesting", "Executing"}
    assert (value["task", "t1"], value["task", "t2"], value["task", "t3"]) == ("verified", "running", "discarded")
    assert got["task", "t1"].planned and not got["task", "ghost"].planned
    assert (value["attempt", "a1"], value["attempt", "a2"]) == ("ok", "running") and json.loads(value["latest", "impact.result"]) == {"v": 2}
    stopped = fold.fold_state(log(spark, (1, "job.state", {"state": "Mapping"}), (2, "job.stopped", {"reason": "r"})))
    assert {(r.slot, r.value) for r in stopped.collect()} >= {("state", "NoPR"), ("reached", "Mapping"), ("stop_reason", "r")}


def test_stream_folds_like_a_batch_and_drops_repeats(spark, tmp_path, rows):
    directory = str(tmp_path / "log")
    log(spark, *STORY[:6]).coalesce(1).write.mode("append").parquet(directory)
    log(spark, *STORY[4:9]).coalesce(1).write.mode("append").parquet(directory)
    log(spark, *STORY[9:]).coalesce(1).write.mode("append").parquet(directory)
    once = drain(fold.read_event_stream(spark, directory), str(tmp_path / "once"))
    assert rows(once, "seq") == sorted(((i,) for i in range(1, 14)), key=repr)
    resumed = drain(fold.read_event_stream(spark, directory, after_seq=10), str(tmp_path / "resumed"))
    assert sorted(r.seq for r in resumed.collect()) == [11, 12, 13]
    streamed = memory(fold.fold_state(fold.read_event_stream(spark, directory)), "folded", "complete")
    assert rows(streamed) == rows(fold.fold_state(log(spark, *STORY)))


def test_stream_ledger_equals_batch(spark, tmp_path, rows):
    directory = str(tmp_path / "calls")
    call = {"role": "coder", "tier": "t", "model": "m", "prompt_tokens": 3, "completion_tokens": 1, "billed_tokens": 4, "from_cache": False}
    batch = log(spark, *[(i, "model.call", {**call, "role": f"r{i % 2}"}) for i in range(6)])
    for part in batch.randomSplit([0.5, 0.5], seed=1):
        part.write.mode("append").parquet(directory)
    streamed = memory(fold.stream_ledger(spark.readStream.schema(schema_of("event")).parquet(directory)), "ledger", "complete")
    assert rows(streamed) == rows(fold.stream_ledger(batch))


def beat(part):
    """A row of no job, long after all others: what is held back comes out."""
    far = (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts")
    return part.limit(1).select(*[F.lit("").alias(c) if c == "job_id" else far if c == "ts" else F.col(c) for c in part.columns])


def stream_of(spark, tmp_path, *parts):
    directory = str(tmp_path / "in")
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(directory)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(directory)


def test_gaps_across_batches(spark, tmp_path, rows):
    parts = log(spark, (1, "x", {}), (2, "x", {}), (9, "x", {})), log(spark, (6, "x", {}), (5, "x", {}), (2, "x", {}), (2, "x", {}, "k"))
    stream = stream_of(spark, tmp_path, *parts, beat(parts[0]))
    assert rows(drain(guards.detect_gaps(stream), str(tmp_path))) == [("j", 3, 4), ("j", 7, 8)]
    batch = log(spark, (1, "x", {}), (2, "x", {}), (5, "x", {}), (6, "x", {}))
    assert rows(timeline.seq_gaps(batch, ["job_id"])) == [("j", 3, 4)]


def test_closing(spark, tmp_path):
    stream = stream_of(
        spark, tmp_path, log(spark, (1, "job.state", {"state": "Ingesting"}), (2, "job.state", {"state": "Aborted"})),
        log(spark, (3, "pr.opened", {}, "j", 3), (4, "x", {}, "j", 60), (5, "x", {}, "k", 60)), beat(log(spark, (1, "x", {}))),
    )
    got = {(r.job_id, r.seq): r.route for r in drain(guards.close_on_terminal(stream, drain_ms=1500), str(tmp_path)).collect()}
    assert got == {("j", 1): "main", ("j", 2): "main", ("j", 3): "main", ("j", 4): "late", ("k", 5): "main"}


OPS = "job_id STRING, seq BIGINT, op STRING, call_id STRING, estimate BIGINT, actual BIGINT, budget BIGINT"


def test_budget(spark, tmp_path, rows):
    ops = [("a", 1, "reserve", "x", 700, 0, 1000), ("a", 2, "reserve", "y", 400, 0, 1000), ("a", 3, "settle", "y", 400, 300, 1000), ("a", 4, "release", "x", 700, 0, 1000),
           ("b", 1, "reserve", "x", 500, 0, 1000), ("b", 2, "settle", "x", 500, 620, 1000), ("b", 3, "spend", "z", 0, 9999, 1000)]
    batch = spark.createDataFrame(ops, OPS)
    want = [("a", 1, True, 300), ("a", 2, False, 300), ("a", 3, False, 300), ("a", 4, True, 1000), ("b", 1, True, 500), ("b", 2, True, 380), ("b", 3, True, 0)]
    assert rows(guards.budget_replay(batch), "job_id", "seq", "granted", "remaining") == want
    timed = [spark.createDataFrame(part, OPS).withColumn("ts", F.timestamp_seconds("seq")) for part in (ops[:1] + ops[3:5], ops[1:3] + ops[5:] + ops[:1])]
    stream = stream_of(spark, tmp_path, *timed, beat(timed[0]))
    got = drain(guards.budget_guard(stream), str(tmp_path))
    assert rows(got, "job_id", "seq", "granted", "remaining") == want


def test_open_attempts(spark, tmp_path, rows):
    hours = 3600
    stream = stream_of(
        spark, tmp_path,
        log(spark, (1, "attempt.started", {"attempt_id": "a"}), (2, "attempt.started", {"attempt_id": "b"}), (3, "attempt.verdict", {"attempt_id": "a", "verdict": "ok"})),
        log(spark, (4, "attempt.started", {"attempt_id": "c"}, "j", 9 * hours), (5, "attempt.verdict", {"attempt_id": "c", "verdict": "red"}, "j", 9 * hours + 5)),
        log(spark, (6, "attempt.started", {"attempt_id": "d"}, "j", 20 * hours), (7, "attempt.verdict", {"attempt_id": "d", "verdict": "ok"}, "j", 20 * hours + 5)),
    )
    got = drain(fold.open_attempts(stream), str(tmp_path))
    assert {("a", "ok"), ("b", "cancelled"), ("c", "red")} <= set(rows(got, "attempt_id", "verdict"))


def test_guards_do_not_depend_on_files(spark, tmp_path, rows):
    """Four files of numbers dealt by hash, one a trigger, each with repeats of the others."""
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ops = stream_queries._operations(raw)
    parts = [ops.filter(F.pmod(F.xxhash64("seq"), F.lit(4)).isin(i, (i + 1) % 4)) for i in range(4)]
    stream = stream_of(spark, tmp_path, *parts, beat(parts[0].withColumn("ts", F.expr("ts + INTERVAL 60 DAYS"))))
    got = drain(guards.budget_guard(stream, "40 days", "3 days", "3650 days"), str(tmp_path))
    assert rows(got) == rows(guards.budget_replay(ops)) and got.count() == 1000


def test_silent_jobs_are_forgotten(spark, tmp_path, rows):
    day = 86_400
    parts = [
        log(spark, (1, "job.stopped", {}, "j", 0), (2, "x", {}, "j", 60), (1, "x", {}, "k", 0)), log(spark, (5, "x", {}, "k", 5 * day)),
        log(spark, (9, "x", {}, "j", 20 * day), (9, "x", {}, "k", 20 * day)), log(spark, (1, "x", {}, "m", 40 * day)),
    ]
    stream = stream_of(spark, tmp_path, *parts, beat(parts[3]))
    got = drain(guards.detect_gaps(stream, forget="10 days"), str(tmp_path))
    assert rows(got) == [("k", 2, 4)]
    (tmp_path / "c").mkdir()
    stream = stream_of(spark, tmp_path / "c", *parts, beat(parts[3]))
    done = drain(guards.close_on_terminal(stream, forget="30 days"), str(tmp_path / "c"))
    assert {(r.job_id, r.seq) for r in done.filter("route = 'late'").collect()} == {("j", 2), ("j", 9)}


def test_rows_without_a_place_are_left_out(spark, tmp_path, rows):
    part = log(spark, (1, "x", {}), (4, "x", {}))
    odd = part.limit(1).select(F.lit(None).cast("long").alias("seq"), "job_id", "ts", "kind", "payload")
    stream = stream_of(spark, tmp_path, part.unionByName(odd).unionByName(part.withColumn("job_id", F.lit(None).cast("string"))), beat(part))
    assert rows(drain(guards.detect_gaps(stream), str(tmp_path))) == [("j", 2, 3)]


def test_newest_view_is_bounded(spark, tmp_path):
    view = fold.newest_sink(str(tmp_path / "view"), keep=3, compact_every=2)
    one, two = log(spark, *[(i, "x", {}) for i in range(1, 5)]), log(spark, (5, "x", {}), (4, "x", {}), (1, "x", {}, "k"))
    for epoch, batch in enumerate([one, two, two, one]):
        view.write(batch, epoch)
        view.write(batch, epoch)
    assert sorted((r.job_id, r.seq) for r in view.read(spark, one.schema).collect()) == [("j", 3), ("j", 4), ("j", 5), ("k", 1)]
    assert len(view._folders(spark)) <= 2


def test_keyed_sink_keeps_the_newest_row_of_each_key(spark, tmp_path, rows):
    sink = fold.KeyedSink(str(tmp_path / "sink"), ["k"], compact_every=3)
    schema = "k STRING, n INT"
    assert sink.read(spark, schema).isEmpty()
    for epoch, batch in enumerate([[("a", 1), ("b", 1)], [("a", 2)], [("c", 1)], [("a", 3), (None, 1)], [], [("b", 9), (None, 2)]]):
        for _ in range(2):
            sink.write(spark.createDataFrame(batch, schema), epoch)
    assert sorted(tuple(r) for r in sink.read(spark, schema).collect() if r.k) == [("a", 3), ("b", 9), ("c", 1)]
    assert [r.n for r in sink.read(spark, schema).filter("k IS NULL").collect()] == [2] and len(sink._folders(spark)) < 4


def test_append_page_and_trace(spark, tmp_path, rows):
    directory = str(tmp_path / "events")
    assert events.read_events(spark, directory) is None
    first = log(spark, (1, "a", {}), (2, "b", {})).drop("seq")
    events.append_events(first, directory)
    events.append_events(log(spark, (3, "c", {}), (9, "d", {}, "k")).drop("seq"), directory)
    stored = events.read_events(spark, directory)
    assert rows(stored, "job_id", "seq", "kind") == [("j", 1, "a"), ("j", 2, "b"), ("j", 3, "c"), ("k", 1, "d")]
    assert [r.kind for r in events.events_since(stored.filter("job_id = 'j'"), 1, 1).collect()] == ["b"]
    events.write_trace(spark.readStream.schema(schema_of("event")).parquet(directory), str(tmp_path / "trace"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.json(f"{tmp_path}/trace").filter("job_id = 'j'").count() == 3


def test_manifest_and_report(spark, tmp_path, rows):
    index = spark.createDataFrame([("a",), ("b",), ("c",)], "path STRING").withColumn("sha256", F.sha2(F.encode("path", "UTF-8"), 256))
    files = spark.createDataFrame([("a", bytearray(b"a")), ("b", bytearray(b"x"))], "path STRING, content BINARY")
    assert rows(artifacts.artifact_manifest(index, files, ["path"]), "path", "present", "intact") == [("a", True, True), ("b", True, False), ("c", False, False)]
    events.write_report(index, index.limit(1), index.limit(2), str(tmp_path))
    assert rows(spark.read.json(str(tmp_path)).groupBy("section").count()) == [("excluded", 1), ("outcomes", 2), ("summary", 3)]


def test_phases(spark, rows):
    got = timeline.phase_durations(log(spark, (1, "a", {}, "j", 0), (2, "b", {}, "j", 5), (3, "a", {}, "j", 7), (4, "c", {}, "j", 8)), F.col("kind"))
    assert rows(got) == [("j", "a", 2, 6_000_000), ("j", "b", 1, 2_000_000)]


HEAD = "--- a/m.py\n+++ b/m.py\n"
DIFFS = {
    "good": (HEAD + "@@ -3,3 +3,3 @@ def f\n a\n-b\n+c\n d\n", "ok"),
    "no numbers": (HEAD + "@@ ...\n a\n-b\n+c\n d\n", "ok"),
    "wrong counts, closed": (HEAD + "@@ -3,9 +3,9 @@\n a\n-b\n+c\n d\n", "ok"),
    "wrong counts, open": (HEAD + "@@ -3,9 +3,9 @@\n a\n-b\n+c\n", "unparseable"),
    "no hunks": (HEAD, "unparseable"),
    "stray hunk": ("@@ -1 +1 @@\n-a\n+b\n c\n" + HEAD, "unparseable"),
    "empty": ("\n", "unparseable"),
    "two files": (HEAD + "@@ -1 +1 @@\n-a\n+b\n--- a/n.py\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-z\n", "ok"),
}


def test_diffs(spark, rows):
    replies = [(k, f"words\n<<<DIFF\n{body}DIFF>>>\n") for k, (body, _) in DIFFS.items()]
    block = "<<<DIFF\n" + DIFFS["good"][0]
    replies += [("twice", block + "DIFF>>>\n" + block + "DIFF>>>"), ("none", DIFFS["good"][0]), ("bare", block + ">>>\n"), ("indented", block + "  DIFF>>>")]
    verdicts, lines = diffs.read_diffs(spark.createDataFrame(replies, "name STRING, text STRING"), "name")
    got = {r.name: r for r in verdicts.collect()}
    want = {k: v for k, (_, v) in DIFFS.items()} | {"twice": "unparseable", "none": "unparseable", "bare": "ok", "indented": "ok"}
    assert {k: r.verdict for k, r in got.items()} == want
    assert got["two files"].paths == ["m.py", "n.py"]
    assert rows(lines.filter("name = 'good'"), "op", "text", "old_no", "new_no") == [(" ", "a", 3, 3), (" ", "d", 5, 5), ("+", "c", None, 4), ("-", "b", 4, None)]
    assert lines.filter("name IN ('twice', 'empty')").isEmpty()


def test_scratch_tables_can_be_cleared(spark):
    from pathlib import Path

    from impactlens import session

    kept = session.materialise(spark.range(3))
    files = [Path(f.removeprefix("file://").removeprefix("file:")) for f in kept.inputFiles()]
    assert kept.count() == 3 and all(f.exists() for f in files)
    ours = session._WRITTEN[spark.sparkContext.applicationId]
    rest, session._WRITTEN[spark.sparkContext.applicationId] = ours[:-1], ours[-1:]
    assert session.clear_scratch(spark) == 1 and not any(f.exists() for f in files)
    session._WRITTEN[spark.sparkContext.applicationId] = rest


def test_drops_of_many_files_come_whole(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 300, raising=False)
    # Attempts with a verdict each, written by 14 tasks that each go over the whole time.
    monkeypatch.setattr(stream_queries, "materialise", lambda df: materialise(df).repartition(14))
    at = F.pmod(F.floor(F.col("id") / 2) * 7919, F.lit(3500)) * 20 + F.col("id") % 2
    kind = F.when(F.col("id") % 2 == 0, "attempt.started").otherwise("attempt.verdict")
    payload = F.to_json(F.struct(F.floor(F.col("id") / 2).cast("string").alias("attempt_id"), F.lit("ok").alias("verdict")))
    log = spark.range(0, 7000, 1, 4).select(
        F.lit("j").alias("job_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1_700_000_000) + at).alias("ts"), kind.alias("kind"), payload.alias("payload")
    )
    stream, lateness = stream_queries._dropped(log)
    once = stream_queries._replayed(fold.each_once(stream, lateness=lateness))
    done = stream_queries._finished(fold.open_attempts(once, lateness, "1 minute")).filter("job_id = 'j'")
    assert done.groupBy("verdict").count().collect() == [("ok", 3500)]

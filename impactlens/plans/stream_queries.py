"""Event logs read as streams of overlapping drops, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactlens.plans import bindings as b
from impactlens.plans.ordering import with_previous
from impactlens.plans.registry import query
from impactlens.session import materialise, new_folder
from impactlens.streaming import fold, guards, ordered


#: Stays ahead of all that the streams below hold back.
FORGET = "36500 days"


#: Rows that a file of a drop should hold.
FILE_ROWS = 1_000_000


def _laid(rows: DataFrame, drops: int) -> DataFrame:
    """A stream of stored rows, in the order of their ``_drop``, one whole drop a trigger.

    Every drop has the same number of files, so that no trigger ends inside one: the watermark would pass rows of its later files.
    """
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "stream-in")
    sizes = dict(rows.groupBy("_drop").count().collect())
    files = 1 + max(sizes.values(), default=0) // FILE_ROWS
    for number in range(drops):
        rows.filter(F.col("_drop") == number).repartition(files).write.mode("append").parquet(folder)
        # Empty partitions leave no file: the drop is made up with empty ones.
        for _ in range((number + 1) * files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _dropped(rows: DataFrame) -> tuple[DataFrame, str]:
    """The rows of a log (job_id, seq, ts, kind, ...) as a stream of four drops that overlap, and the lateness that covers the overlap.

    A row comes up to a fifth of the log's time late, one in five comes again in the next drop, and numbers are mixed inside a drop.
    The fifth drop has heartbeats only, one of each kind that a join may wait for, after which nothing is held back. ``_drop`` is
    the number of the drop.
    """
    spark = rows.sparkSession
    low, high = rows.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    low, high = low or 0, high or 0
    span = high - low + 1
    late = span // 5
    drop = F.floor(4 * (F.unix_millis("ts") - low + F.pmod(F.xxhash64("job_id", "seq"), F.lit(late + 1))) / (span + late + 1)).cast("int")
    again = F.pmod(F.xxhash64("seq", "job_id", F.lit("again")), F.lit(5)) == 0
    placed = rows.withColumn("_drop", F.explode(F.array_distinct(F.array(drop, F.least(drop + again.cast("int"), F.lit(3))))))
    beats = spark.createDataFrame([(ordered.HEARTBEAT, k) for k in ("attempt.started", "attempt.verdict")], "job_id STRING, kind STRING")
    nulls = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name not in ("job_id", "kind")}
    beats = beats.withColumns(nulls).withColumns({"seq": F.lit(-1).cast("long"), "ts": F.timestamp_millis(F.lit(high + 2 * span)), "_drop": F.lit(4)})
    if "payload" in rows.columns:
        # Filters for join keys that are not null run before the watermark: a heartbeat must pass them.
        beats = beats.withColumn("payload", F.lit('{"attempt_id": "heartbeat"}'))
    return _laid(materialise(placed.unionByName(beats)), 5), f"{late // 1000 + 1} seconds"


def _finished(stream: DataFrame) -> DataFrame:
    """Everything an append-mode stream yields, through a checkpointed file sink."""
    spark = stream.sparkSession
    root = new_folder(spark, "stream")
    run = (
        stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check")
        .outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _merged(stream: DataFrame, keys: list[str], mode: str = "update", sink=None) -> DataFrame:
    root = new_folder(stream.sparkSession, "stream")
    make = sink or (lambda directory: fold.KeyedSink(directory, keys, compact_every=3))
    return fold.run_into(stream, make(f"{root}/view"), f"{root}/check", mode)


def _fold_events(rows: DataFrame) -> DataFrame:
    """User events as job events: clicks change state, views start attempts at tasks, purchases end them, signups plan or settle tasks."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(F.col("event_type") == "click", "job.state").when(F.col("event_type") == "error", "job.stopped")
        .when(F.col("event_type") == "view", "attempt.started").when(F.col("event_type") == "purchase", "attempt.verdict")
        .when(k < 40, "plan.ready").when(k < 70, "task.settled").otherwise("graph.built")
    )
    state = F.when(k < 50, "Mapping").when(k < 90, "Executing").otherwise("Done")
    task = F.concat(F.lit("t"), (k % 5).cast("string"))
    payload = F.to_json(F.struct(
        state.alias("state"), F.concat(F.lit("a"), (k % 7).cast("string")).alias("attempt_id"), F.when(kind != "plan.ready", task).alias("task_id"),
        F.when(k < 60, "red").otherwise("ok").alias("verdict"), F.concat(F.lit("why "), k.cast("string")).alias("reason"),
        F.when(k % 2 == 0, "w").alias("winning_attempt_id"), F.when(kind == "plan.ready", F.array(F.struct(task.alias("id")))).alias("tasks"),
    ))
    return rows.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), payload.alias("payload")
    )


SLOTS = """e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
s AS (SELECT *, CASE WHEN k < 50 THEN 'Mapping' WHEN k < 90 THEN 'Executing' ELSE 'Done' END AS st,
  CASE WHEN event_type <> 'signup' THEN '' WHEN k < 40 THEN 'plan' WHEN k < 70 THEN 'settle' ELSE 'built' END AS act FROM e),
slot AS (
  SELECT job_id, seq, 'state' AS slot, '' AS id, 0 AS rank, CASE WHEN event_type = 'click' THEN st ELSE 'NoPR' END AS value FROM s WHERE event_type IN ('click', 'error')
  UNION ALL SELECT job_id, seq, 'reached', '', 0, st FROM s WHERE event_type = 'click' AND st <> 'Done'
  UNION ALL SELECT job_id, seq, 'visited', st, 0, st FROM s WHERE event_type = 'click' AND st <> 'Done'
  UNION ALL SELECT job_id, seq, 'stop_reason', '', 0, 'why ' || k FROM s WHERE event_type IN ('click', 'error')
  UNION ALL SELECT job_id, seq, 'task', 't' || (k % 5), 1, 'running' FROM s WHERE event_type = 'view'
  UNION ALL SELECT job_id, seq, 'task', 't' || (k % 5), 0, 'pending' FROM s WHERE act = 'plan'
  UNION ALL SELECT job_id, seq, 'task', 't' || (k % 5), 2, CASE WHEN k % 2 = 0 THEN 'verified' ELSE 'discarded' END FROM s WHERE act = 'settle'
  UNION ALL SELECT job_id, seq, 'latest', 'graph.built', 0,
    '{"state":"' || st || '","attempt_id":"a' || (k % 7) || '","task_id":"t' || (k % 5) || '","verdict":"ok","reason":"why ' || k || CASE WHEN k % 2 = 0 THEN '","winning_attempt_id":"w"}' ELSE '"}' END
    FROM s WHERE act = 'built'
  UNION ALL SELECT job_id, seq, 'attempt', 'a' || (k % 7), 0, 'running' FROM s WHERE event_type = 'view'
  UNION ALL SELECT job_id, seq, 'attempt', 'a' || (k % 7), 1, CASE WHEN k < 60 THEN 'red' ELSE 'ok' END FROM s WHERE event_type = 'purchase')"""


@query(f"""WITH {SLOTS}
SELECT job_id, slot, id, arg_max(value, rank * 1000000000 + seq) AS value, max(seq) AS last_seq, min(seq) AS first_seq, min(rank) = 0 AS planned FROM slot GROUP BY 1, 2, 3""")
def folded_state(spark, d):
    stream, _ = _dropped(_fold_events(b.table(spark, d, "events")))
    folded = fold.fold_state(stream.filter(F.col("job_id") != ordered.HEARTBEAT))
    return _merged(folded, ["job_id", "slot", "id"])


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS role, CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'fast' ELSE 'deep' END AS tier, 'm' AS model,
  count(*) AS calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS prompt_tokens, sum(CASE WHEN event_type <> 'error' THEN event_id % 50 END)::BIGINT AS completion_tokens,
  sum(CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 50)::BIGINT AS billed_tokens, count_if(event_id % 3 = 0) AS cached, CAST(NULL AS BIGINT) AS cached_prompt_tokens FROM events GROUP BY 1, 2, 3""")
def stream_ledger(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    call = F.to_json(F.struct(
        F.col("event_type").alias("role"), F.when(k < 50, "fast").otherwise("deep").alias("tier"), F.lit("m").alias("model"), k.alias("prompt_tokens"),
        F.when(F.col("event_type") != "error", F.col("event_id") % 50).alias("completion_tokens"), (k + F.col("event_id") % 50).alias("billed_tokens"), (F.col("event_id") % 3 == 0).alias("from_cache"),
    ))
    rows = b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit("model.call").alias("kind"), call.alias("payload")
    )
    stream, lateness = _dropped(rows)
    # Repeats are dropped by a first stream, as running sums would count them again.
    once = _replayed(fold.each_once(stream, lateness=lateness))
    return _merged(fold.stream_ledger(once), ["job_id", "role", "tier", "model"])


def _replayed(stream: DataFrame) -> DataFrame:
    """A stream over what another stream has put out, drop by drop."""
    return _laid(_finished(stream), 5)


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, event_type AS kind, props AS payload FROM events WHERE event_id > 100""")
def stream_replay(spark, d):
    rows = b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("props").alias("payload")
    )
    stream, lateness = _dropped(rows)
    return _finished(fold.each_once(stream, after_seq=100, lateness=lateness)).select("job_id", "seq", "kind", "payload")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, event_type FROM events),
a AS (SELECT job_id, seq, ts, lead(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS ended, lead(seq % 2) OVER w AS v, event_type FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seq))
SELECT job_id, CAST(seq AS VARCHAR) AS attempt_id, CASE WHEN ended IS NULL OR ended > ts + INTERVAL 12 HOUR THEN 'cancelled' WHEN v = 0 THEN 'ok' ELSE 'red' END AS verdict FROM a WHERE event_type = 'view'""")
def stream_attempts(spark, d):
    # A view starts an attempt; a purchase that follows it at once is its verdict.
    e = b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")
    )
    before = with_previous(e, ["job_id"], [F.col("seq")], ["seq", "kind"])
    verdict = (F.col("kind") == "purchase") & (F.col("prev_kind") == "view")
    payload = F.to_json(F.struct(
        F.when(verdict, F.col("prev_seq")).otherwise(F.col("seq")).cast("string").alias("attempt_id"), F.when(F.col("seq") % 2 == 0, "ok").otherwise("red").alias("verdict"),
    ))
    kind = F.when(verdict, "attempt.verdict").when(F.col("kind") == "view", "attempt.started").otherwise("other")
    stream, lateness = _dropped(before.select("job_id", "seq", "ts", kind.alias("kind"), payload.alias("payload")))
    # Repeats are dropped by a first stream; a repeated start would meet its verdict twice.
    done = _finished(fold.open_attempts(_replayed(fold.each_once(stream, lateness=lateness)), lateness=lateness, patience="12 hours"))
    return done.filter(F.col("job_id") != ordered.HEARTBEAT).select("job_id", "attempt_id", "verdict")


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20""")
def stream_newest(spark, d):
    stream, _ = _dropped(_fold_events(b.table(spark, d, "events")))
    rows = stream.filter(F.col("job_id") != ordered.HEARTBEAT).select("job_id", "seq")
    return _merged(rows, [], "append", lambda directory: fold.newest_sink(directory, keep=20, compact_every=2))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq FROM events WHERE event_type <> 'view'),
n AS (SELECT job_id, seq // 150 AS seq FROM e GROUP BY ALL), p AS (SELECT job_id, seq, lag(seq) OVER (PARTITION BY job_id ORDER BY seq) AS prev FROM n)
SELECT job_id, prev + 1 AS first, seq - 1 AS last FROM p WHERE seq - prev > 1""")
def stream_gaps(spark, d):
    guards.use_rocksdb(spark)
    rows = b.table(spark, d, "events").filter(F.col("event_type") != "view").select(
        F.col("user_id").cast("string").alias("job_id"), F.floor(F.col("event_id") / 150).alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")
    )
    stream, lateness = _dropped(rows)
    return _finished(guards.detect_gaps(stream, lateness, "10 days", FORGET))


def _operations(rows: DataFrame) -> DataFrame:
    """Users reserve, settle and release tokens; an operation is named by its event type."""
    k = F.get_json_object("props", "$.k").cast("long")
    op = F.when(F.col("event_type").isin("view", "click", "signup"), "reserve").when(F.col("event_type") == "purchase", "settle").otherwise("release")
    return rows.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.col("event_id").cast("string").alias("call_id"), k.alias("estimate"), F.floor(F.col("value")).cast("long").alias("actual"),
        F.lit(600).cast("long").alias("budget"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
    )


BUDGET = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'reserve' WHEN event_type = 'purchase' THEN 'settle' ELSE 'release' END AS op,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS est, CAST(floor(value) AS BIGINT) AS act, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
walk AS (
  SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS op, true AS granted, CAST(0 AS BIGINT) AS spent FROM (SELECT DISTINCT job_id FROM e)
  UNION ALL
  SELECT w.job_id, e.rn, e.seq, e.op, NOT (e.op = 'reserve' AND w.spent + e.est > 600),
    CASE WHEN e.op = 'reserve' THEN CASE WHEN w.spent + e.est > 600 THEN w.spent ELSE w.spent + e.est END WHEN e.op = 'settle' THEN w.spent + e.act - e.est ELSE w.spent - e.est END
  FROM walk w JOIN e ON e.job_id = w.job_id AND e.rn = w.rn + 1)
SELECT job_id, seq, op, granted, spent, greatest(0, 600 - spent) AS remaining FROM walk WHERE rn > 0"""


@query(BUDGET)
def stream_budget(spark, d):
    guards.use_rocksdb(spark)
    stream, lateness = _dropped(_operations(b.table(spark, d, "events")))
    return _finished(guards.budget_guard(stream, lateness, "10 days", FORGET))


@query(BUDGET)
def budget_replay(spark, d):
    return guards.budget_replay(_operations(b.table(spark, d, "events")))


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts, event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS INTEGER) > 80 AS terminal FROM events),
shut AS (SELECT job_id, arg_min(ts, seq) + INTERVAL 1 HOUR AS shut FROM e WHERE terminal GROUP BY 1)
SELECT e.job_id, e.seq, CASE WHEN e.ts > s.shut THEN 'late' ELSE 'main' END AS route FROM e LEFT JOIN shut s ON s.job_id = e.job_id""")
def stream_closing(spark, d):
    guards.use_rocksdb(spark)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when((F.col("event_type") == "error") & (k > 80), "job.stopped").otherwise(F.col("event_type"))
    rows = b.table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"), F.col("props").alias("payload"),
    )
    stream, lateness = _dropped(rows)
    return _finished(guards.close_on_terminal(stream, 3_600_000, lateness, "10 days", FORGET)).select("job_id", "seq", "route")

"""The event log as a directory: append, page, replay, trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from impactlens.plans.ordering import numbered
from impactlens.schemas import schema_of
from impactlens.session import materialise

TOPS = "job_id STRING, top LONG"


def append_events(events: DataFrame, directory: str) -> None:
    """Append (job_id, ts, kind, payload); seq goes on from the highest stored one of each job.

    The highest numbers lie beside the log, one small row per job and append, so appending does not read the log again; a log
    without them is read once. One writer at a time may append for a job.
    """
    spark = events.sparkSession
    placed = materialise(numbered(events, ["job_id"], [F.col("ts"), F.col("kind"), F.col("payload")]))
    tops_at = directory.rstrip("/") + "_tops"
    stored = spark.read.schema(TOPS).parquet(tops_at) if _exists(spark, tops_at) else None
    if stored is None and (log := read_events(spark, directory)) is not None:
        stored = log.select("job_id", F.col("seq").alias("top"))
    tops = stored.groupBy("job_id").agg(F.max("top").alias("_top")) if stored is not None else spark.createDataFrame([], "job_id STRING, _top LONG")
    rows = materialise(placed.join(tops, "job_id", "left").select(
        (F.col("rn") + F.coalesce("_top", F.lit(0))).cast("long").alias("seq"), "job_id", "ts", "kind", "payload"
    ))
    rows.write.mode("append").parquet(directory)
    known = rows.groupBy("job_id").agg(F.max("seq").alias("top"))
    old = tops.withColumnRenamed("_top", "top").join(known.select("job_id"), "job_id", "left_anti")
    # Tops already stored need no second row.
    (known if _exists(spark, tops_at) else known.unionByName(old)).write.mode("append").parquet(tops_at)


def _exists(spark: SparkSession, directory: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_events(spark: SparkSession, directory: str) -> DataFrame | None:
    return spark.read.schema(schema_of("event")).parquet(directory) if _exists(spark, directory) else None


def events_since(events: DataFrame, after: int, limit: int | None = None) -> DataFrame:
    """Keyset page after a seq, or the full replay without a limit. The limit is the page size."""
    rows = events.filter(F.col("seq") > after)
    return rows if limit is None else rows.orderBy("seq").limit(limit)


def write_trace(stream: DataFrame, directory: str, checkpoint: str) -> StreamingQuery:
    """One folder of JSON lines per job."""
    return (
        stream.writeStream.format("json").partitionBy("job_id").option("path", directory)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )


def write_report(arms: DataFrame, excluded: DataFrame, outcomes: DataFrame, directory: str) -> None:
    """Summary, exclusions and outcomes as JSON lines, told apart by a section column."""
    def section(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))

    rows = section(arms, "summary").unionByName(section(excluded, "excluded")).unionByName(section(outcomes, "outcomes"))
    rows.write.mode("overwrite").partitionBy("section").json(directory)

"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

_WRITTEN: dict[str, list[str]] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings every operator relies on; nothing that sizes the cluster."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("impactlens")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: ``spark.checkpoint.dir`` of the session, else a folder in its warehouse.

    Off a local master a warehouse on the file system of one machine is no shared folder, and an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = spark._jvm.org.apache.hadoop.fs.Path(warehouse)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of one machine")
    return f"{warehouse}/_scratch"


def new_folder(spark: SparkSession, kind: str, make: bool = False) -> str:
    """The full path of a new folder in the shared one; ``clear_scratch`` deletes it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/impactlens-{kind}-{uuid.uuid4().hex}")
    files = named.getFileSystem(spark._jsc.hadoopConfiguration())
    path = files.makeQualified(named)
    if make:
        files.mkdirs(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path.toString())
    return path.toString()


def store(df: DataFrame, *partition_by: str) -> str:
    """Writes a table of its own to the shared folder and returns its full path; ``clear_scratch`` deletes it."""
    path = new_folder(df.sparkSession, "table")
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    # Read back once or twice, so size counts more than speed.
    writer.parquet(path, compression="zstd")
    return path


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Cut the lineage with a written table; survives lost executors and carries real sizes."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, *partition_by))


def clear_scratch(spark: SparkSession) -> int:
    """Delete the tables this application wrote to cut lineage; call it once their results are stored."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)

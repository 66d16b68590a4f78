"""Session helpers: the test session, the shared checkpoint folder and size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Setting of the session: partitions that `spread_out` makes of a table that is read in fewer; unset or 0 leaves all as they are read.
SPREAD = "spark.loamgrid.spread"
#: Largest number of rows that `small` lets through to the driver or a broadcast.
SMALL_ROWS = 200_000


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """The session of tests and of bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loamgrid")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config(SPREAD, str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, kind: str = "checkpoint") -> str:
    """The folder below `spark.checkpoint.dir` or the folder that was set for checkpoints, or a new one below it for another kind.

    Where neither is set, a local session takes a temporary folder; on a cluster that folder would be on one machine, so it raises.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="loamgrid-")
        context.setCheckpointDir(base)
    return base if kind == "checkpoint" else f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder. `spark.cleaner.referenceTracking.cleanCheckpoints` removes it after use."""
    context = df.sparkSession.sparkContext
    base = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    """The same for wide tables that are used several times: written to the shared folder by columns and read from there."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def small(df: DataFrame, limit: int = SMALL_ROWS, what: str = "table") -> list:
    """Rows of a table whose size is bounded by its meaning; raises beyond `limit` instead of flooding the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and can't be held by the driver")
    return rows


def fitting(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """A narrow table that is stored already, marked for a broadcast if it has at most `limit` rows; else as it is, to be joined by shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table by its name."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_out(df: DataFrame) -> DataFrame:
    """Rows of a table in few files over the partitions that the session's setting SPREAD names, before heavy work on each row."""
    least = int(df.sparkSession.conf.get(SPREAD, "0"))
    return df.repartition(least) if least and df.rdd.getNumPartitions() < least else df


def fresh(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: rows delivered again are the same row. Which of unequal copies stays is left open."""
    return df.dropDuplicates([key])



def fresh_rows(df: DataFrame, key: str) -> DataFrame:
    """The same for wide rows: only rows whose key occurs several times are shuffled, as long as these keys are few enough to broadcast.

    Rows without a key all stay.
    """
    twice = durable(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    if twice.limit(1_000_001).count() > 1_000_000:
        return df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
    return df.join(F.broadcast(twice), key, "left_anti").unionByName(df.join(F.broadcast(twice), key, "left_semi").dropDuplicates([key]))

"""Session settings and the shared scratch location."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Planning settings that do not depend on cluster size.  Shuffle partition counts and memory are left to
# whoever submits the job; AQE coalesces small shuffles and splits skewed ones.
PLANNER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytecodes, and interprets them ten times slower.  Below this
    # limit Spark generates one method per stage; above it, it generates smaller ones per operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "larder", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or reuse) a session with the planner settings above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**PLANNER_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a checkpoint folder set in the program.

    There is no fallback: a folder of one machine would be lost with it.
    """
    context = spark.sparkContext
    folder = (
        context.getConf().get("spark.checkpoint.dir")
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for a table written within a job."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written for a later step and has been read by it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where the input is too small, by Spark's estimate, to give each core a file split.

    An unsplit file is read by one task whatever is to be done with its rows.  The shuffle this costs is bounded by the
    number of cores times the size of a split; larger inputs have splits for all cores and are left as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def checkpointed(df):
    """Reliable checkpoint: cuts lineage and survives losing the executors that computed it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

"""Session helpers: settings for local runs and the shared scratch folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "feedback_engine", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benches. A cluster brings its own session instead.

    A scratch folder of its own is set only where the settings name none.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    if not SparkConf().contains(CHECKPOINT_KEY):
        builder = builder.config(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="feedback-scratch-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach. The session must name it; nothing is invented here."""
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
    return root.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{scratch_root(spark)}/feedback_engine/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path per call, so that a re-run never meets an older run's files."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application has written to the shared folder; results that still read it must be stored first.

    Works on any file system Spark can write to. False if there was nothing.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted. Spark keeps them until the driver's JVM happens to collect their plans,
    which with a roomy heap can be after the job. The small job
    takes the place of the last one, which Spark's threads still hold; the second collection finds what the first made free."""
    gc.collect()
    spark.range(8).repartition(2).count()
    spark._jvm.System.gc()
    time.sleep(0.3)
    spark._jvm.System.gc()


def discard(*stored: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more, and the shuffle files of finished jobs."""
    spark = stored[0].sparkSession
    for table in stored:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(spark)

"""Session settings that the library relies on, and how it cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and bench.py; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Bytes of an Arrow batch between Spark and Python at most.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by BATCH_BYTES, where it hasn't a smaller bound: rows of long texts otherwise make batches of tens of MB."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back_heap(spark: SparkSession) -> None:
    """The executors' JVMs collect their garbage and give unused heap back, which they otherwise keep from stage to stage, beside what Python workers need.

    One task for each core, so that every executor gets some when none is busy; an executor that gets none only keeps its heap.
    """
    sc = spark.sparkContext
    n = 1 if sc.master.startswith("local[") else sc.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed and written to the checkpoint folder that the cluster shares.

    The folder is the session's spark.checkpoint.dir. A session without one gets a temporary folder
    if all of it runs on this machine (tests, bench.py); on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return df.checkpoint(eager=True)

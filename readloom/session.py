"""Session helpers: a default local session and lineage cutting in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = 8, app: str = "readloom", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session to the operators."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate data: ``spark.checkpoint.dir``. Where that is unset a folder of this machine is
    taken on a local master; on a cluster it is an error, as executors don't share such a folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs a task and not the
    result, and plans of loops stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join side that is never broadcast. Spark takes the rows of a column function, and of what is cut off
    behind it, to be as many as the rows it reads; a read makes a hundred k-mers, so a table of those that Spark takes for
    small enough to broadcast would fill the driver."""
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Sessions for tests and the local benchmark; a cluster brings its own."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: the session's spark.checkpoint.dir; on a single machine, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="souk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, where: str) -> None:
    """Delete a folder, wherever it is; what is gone or out of reach is left."""
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when Python ends."""
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    atexit.register(remove, spark, where)
    return where


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all machines share: computed once, and what reads it is planned apart from what made it."""
    where = scratch(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows over all cores, by keys that few rows share. For rules that cost much a row: a table of few bytes is one file split, and its rows one task, however many they are."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("souk")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )

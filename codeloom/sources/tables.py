"""Tables given as Parquet, and cutting of lineage through a shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no spark.checkpoint.dir and all tasks run in the driver's process.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which the driver and all executors reach. It goes when the session's
    process ends. On a cluster that names no such folder this is an error, as each machine would write its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = LOCAL_CHECKPOINTS
    folder = f"{root.rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the folder that all executors share and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by cut(), once nothing reads it any more."""
    for folder in sorted({f.rpartition("/")[0] for f in df.inputFiles()}):
        delete_folder(df.sparkSession, folder)

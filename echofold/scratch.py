"""Tables that are written down between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where that is unset, a temporary one in local mode and an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _LOCAL_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="echofold-"))


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _target(spark, path)
    files.delete(target, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """What is read lazily goes when the session's file system is closed."""
    files, target = _target(spark, path)
    files.deleteOnExit(target)


def new_path(spark: SparkSession) -> str:
    """A path in the shared folder that is deleted when the session ends."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` written to the shared folder, once, and read from there, so that its lineage ends. Rows of unlike ``partitions`` lie in folders of their own."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.partitionBy(*partitions).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all shuffle partitions: for rows that are few in bytes and dear in work, which adaptive execution would put into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Input of a task by Spark's estimate, which knows files as they are compressed.
TASK_BYTES = 4 << 20


def sized(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its size asks for, where that is more than there are shuffle partitions, so that a task doesn't grow with the input."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = -(-estimate // TASK_BYTES)
    # An input of unknown size is estimated as endless.
    return df.repartition(tasks, *keys) if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < tasks < 1 << 16 else df

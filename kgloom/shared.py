"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def steady(spark: SparkSession) -> None:
    """A union says nothing of its partitioning.

    Spark 4.1 lets a union of equally partitioned inputs claim their partitioning; after adaptive execution has changed
    the inputs, the claim can fail ("Can't zip RDDs with unequal numbers of partitions").
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own in a local session where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kgloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are stored for the time of a computation, whose result doesn't read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            removed(self.spark, self.paths.pop())


#: Below so many bytes a table is dealt to all cores before costly work on its rows.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: its file may be one row group, which one task would read.

    A large one has splits enough, and its texts aren't moved.
    """
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if known < SPREAD_BYTES else df


#: Ids that are sent to all tasks rather than move the texts beside them: numbers, and others.
SENT_NUMBERS, SENT_IDS = 1 << 22, 1 << 19


def sendable(ids: DataFrame) -> DataFrame:
    """A table of ids for the right side of a join, broadcast if it is of bounded size; it is counted for that."""
    most = SENT_NUMBERS if all(f.dataType.typeName() in ("long", "integer") for f in ids.schema) else SENT_IDS
    return F.broadcast(ids) if ids.count() <= most else ids


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether there was one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def present(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))

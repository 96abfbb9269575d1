"""Tables of intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a fresh local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphsieve-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path there that no other call gets; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/graphsieve/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: it is computed once, survives lost executors and ends the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables as `written` makes them that go at the end of a with block; what is returned from it must not read them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])


def spread(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """df, of about `rows` rows that take long, dealt to a task for each `each` of them, and to one for every core at least; by their bytes alone they would meet in few.

    With keys, dealt by their hash: rows of equal keys meet, so that what is grouped by them then needs no further exchange, and no task groups more than its share.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)), *keys)

"""Cutting the lineage of driver loops through a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(of: DataFrame | SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only under a local master that names none."""
    spark = of if isinstance(of, SparkSession) else of.sparkSession
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(named)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame, **options: str) -> DataFrame:
    """df written to the shared folder (with the writer's options) and read again: no lineage, and a lost executor takes nothing with it."""
    path = f"{shared_folder(df)}/loop-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).exists(p)


def forget(df: DataFrame) -> None:
    """Deletes a table that cut() made and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for what is executed inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most, for what is executed inside: a worker holds a batch whole."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


#: Bytes of input files for one partition of a wide step.
WIDE = 16 << 20


def widely(df: DataFrame, *keys: str) -> DataFrame:
    """df parted by the keys into as many parts as its input files ask for, the session's number at least: a task's memory stays as the input grows."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for x in df.inputFiles():
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        size += p.getFileSystem(hadoop).getFileStatus(p).getLen()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # when the session's number is enough, Spark chooses the shuffles itself
    return df if size <= parts * WIDE else df.repartition(-(-size // WIDE), *keys)


def numbered(df: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """df and a column of its rows' numbers from 0 in an order without ties.

    Numbers come from range partitions and their sizes, so no single task sorts all rows; the one window is over
    a row for each partition.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    starts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0")).withColumn("_start", F.sum("_n").over(W.orderBy("_p")) - F.col("_n"))
    return parts.join(F.broadcast(starts), "_p").select(*df.columns, (F.col("_start") + F.col("_m") - F.col("_m0")).alias(name))

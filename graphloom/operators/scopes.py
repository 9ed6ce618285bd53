"""Scope chains: which named ranges of a file enclose each row of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans.iterate import cut

ROW = "file string, start long, stop long, name string, uid string"


def scope_chains(ranges: DataFrame, separator: str = "::") -> DataFrame:
    """uid, chain (outermost first, null outside all), depth: from file, start, stop, name, uid; stop is inside.

    A range is enclosed by every other of its file that holds it; of equal ranges the one of the smaller uid encloses. Rows are
    sorted by file and start over range partitions, and each partition is swept once with the ranges that are still
    open; those that are open where a partition begins are found by a join with the partitions' first rows, so a file
    may lie in many partitions. A task holds as many ranges as are open at one place.
    """
    order = [F.asc("file"), F.asc("start"), F.desc("stop"), F.asc("uid")]
    given = ranges.select("file", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "name", "uid").where("file is not null and start <= stop")
    parts = cut(given.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    first = parts.groupBy("_p").agg(F.min(F.struct("file", "start", -F.col("stop"), "uid")).alias("x")).select("_p", F.col("x.file").alias("file"), F.col("x.start").alias("at"))
    open_ = parts.alias("r").join(F.broadcast(first.alias("f")), (F.col("r.file") == F.col("f.file")) & (F.col("r._p") < F.col("f._p")) & (F.col("r.stop") >= F.col("f.at")))
    carried = open_.select(F.col("f._p").alias("_p"), F.col("r.file").alias("file"), F.col("r.start").alias("start"), F.col("r.stop").alias("stop"), F.col("r.name").alias("name"), F.col("r.uid").alias("uid"), F.lit(True).alias("_carried"))
    every = parts.withColumn("_carried", F.lit(False)).unionByName(carried.select("file", "start", "stop", "name", "uid", "_p", "_carried"))
    swept = every.repartition("_p").sortWithinPartitions("_p", *order)
    return swept.select("_p", "file", "start", "stop", "name", "uid", "_carried").mapInArrow(_sweep(separator), "uid string, chain string, depth int")


def _sweep(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held = None, None, []  # held: (stop, name) of the ranges that are open, in the order of their starts
        for b in batches:
            out: list[tuple[str | None, str | None, int]] = []
            for p, f, start, stop, name, uid, carried in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (p, f) != (part, file):
                    part, file, held = p, f, []
                held = [x for x in held if x[0] >= start]
                if not carried:
                    chain = [n for s, n in held if s >= stop and n is not None]
                    out.append((uid, separator.join(chain) if chain else None, len(chain)))
                held.append((stop, name))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int32())], names=["uid", "chain", "depth"])

    return run

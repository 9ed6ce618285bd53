"""Helpers that several operators share: shared storage, words, hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the only characters that part words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BATCH = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="graphloom-")
        sc.setCheckpointDir(named)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    if by:
        writer = writer.partitionBy(*by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ROWS_PER_BATCH rows, so that long texts fit into a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows, for what is executed inside and has short rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Batches gathered until the column holds most_bytes; a table has at most that plus one batch."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.column(b.schema.get_field_index(column)).nbytes
        if n >= most_bytes:
            yield pa.Table.from_batches(held)
            held, n = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield pa.Table.from_batches(held)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def crc_mod(column: str, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star steps until nothing changes; each step is written to the shared folder,
    the one before it is deleted, and only a count and a checksum come to the driver. A hub's rows are pre-aggregated (min) and joined, so that
    adaptive execution can split them.
    """
    spark = edges.sparkSession
    e = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(e)
    if not before[0]:
        return spark.createDataFrame([], "node long, component long")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e, old = written(small, "edges"), e
        forget(old)
        after = mark(e)
        if after == before:
            break
        before = after
    star = e.groupBy("u").agg(F.min("v").alias("m"))
    return star.select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(star.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())

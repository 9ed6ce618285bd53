"""Two-pass external shuffle into shards; DataFrame operations only.

Pass 1 scatters the whole records uniformly over memory-sized buckets (about BUCKET_BYTES each, by the size of all columns of
the records; where that takes more than MOST_BUCKETS, it raises) by a seeded hash of the id and of the row's place, so that a repeated id or a null id cannot fill one
bucket. Pass 2 Fisher-Yates shuffles each bucket (Spark's seeded `shuffle` of the sorted bucket) and writes it to
the shared folder; what is read afterwards is that written order. The buckets laid end to end are one random
permutation, which is cut into n_shards runs, so a bucket goes to one shard, or to two where a cut falls into it.
The shards are written too, and the plan is read off the written shards. The law is `rows`: shard counts
differ by one at most, slots run from 0 without gaps.

A task holds one bucket's records at a time; a record longer than a bucket is held alone with the few that fall to
it. The starts of the buckets are summed in runs of RUN buckets, then within each run. Columns of the records may
have any names: a column named as one of the plan comes back with doc_ in front. Null texts have size 8 and
checksum 0. Repeated rows are separate records. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import shared_dir

SHARDS = 24
BUCKET_BYTES = 16 << 20
MOST_BUCKETS = 1 << 26
#: Starts of so many buckets are sent to every task.
SMALL = 1 << 20
#: Tasks of the scatter at most; each has a run of buckets.
OWNERS = 1 << 16
RUN = 1 << 10
SEED = 20_240_611
#: The columns of a plan besides the id.
PLAN = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _written(df: DataFrame, path: str, *by: str) -> DataFrame:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket_at_a_time(spark: SparkSession):
    """Settings under which an aggregation sorts its input and holds one group's list at a time."""
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    return lambda: spark.conf.set(name, before)


def record_bytes(docs: DataFrame) -> Column:
    """What a whole record takes, about: all its columns, nulls as nothing, and some for the row; nested ones by their JSON."""
    size = F.lit(64)
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 8 + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + 8 + F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("x")))), F.lit(0))
        else:
            size = size + 8
    return size.cast("long")


def external_shuffle(docs: DataFrame, id_col: str, text_col: str, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(place, _rec): all rows, whole, with a gapless random position from 0, from the written buckets; and the number of rows."""
    spark = docs.sparkSession
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(record_bytes(docs)).alias("b")).first()
    n_buckets = max(1, math.ceil((total.b or 0) / bucket_bytes))
    if n_buckets > MOST_BUCKETS:
        raise ValueError(f"{total.b} bytes need {n_buckets} buckets of {bucket_bytes}; at most {MOST_BUCKETS} are dealt: give a greater bucket_bytes")
    owners = min(n_buckets, OWNERS)
    records = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_rec"))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_id", "_row"), F.lit(n_buckets))
    scattered = records.withColumn("_bucket", bucket).withColumn("_owner", F.floor(F.col("_bucket") * owners / n_buckets).cast("int")).repartitionById(owners, "_owner")
    restore = _bucket_at_a_time(spark)
    try:
        buckets = scattered.groupBy("_owner", "_bucket").agg(F.collect_list(F.struct("_id", "_row", "_rec")).alias("_recs"))
        by_id = F.expr("array_sort(_recs, (a, b) -> case when a._id < b._id then -1 when a._id > b._id then 1 when a._id is null and b._id is not null then -1 when b._id is null and a._id is not null then 1 else cast(sign(a._row - b._row) as int) end)")
        shuffled = buckets.select("_bucket", F.size("_recs").alias("_n"), F.transform(F.shuffle(by_id, seed), lambda r: r["_rec"]).alias("_recs"))
        table = _written(shuffled, f"{shared_dir(spark)}/shard-buckets-{uuid.uuid4().hex[:12]}")
    finally:
        restore()
    # one row per bucket; runs of buckets are summed first
    counts = table.select("_bucket", F.col("_n").cast("long").alias("_n"), F.floor(F.col("_bucket") / RUN).alias("_run"))
    runs = counts.groupBy("_run").agg(F.sum("_n").alias("_of_run")).withColumn("_before", F.sum("_of_run").over(W.orderBy("_run")) - F.col("_of_run")).select("_run", "_before")
    starts = counts.withColumn("_within", F.sum("_n").over(W.partitionBy("_run").orderBy("_bucket")) - F.col("_n")).join(runs, "_run").select(F.col("_bucket").alias("_b"), (F.col("_before") + F.col("_within")).alias("_start"))
    placed = table.join(F.broadcast(starts) if n_buckets <= SMALL else starts, F.col("_bucket") == F.col("_b")).select("_start", F.posexplode("_recs").alias("_pos", "_rec"))
    return placed.select((F.col("_start") + F.col("_pos")).cast("long").alias("place"), "_rec"), total.n


def carried(payload: list[str], id_col: str) -> list[str]:
    """Names of payload columns in the plan: one that the plan has itself gets doc_ in front."""
    return [f"doc_{c}" if c in (*PLAN, id_col) else c for c in payload]


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes whole records, one folder per shard, each file in the order of its slots, and reads them: id, other columns, slot, shard."""
    placed, n = external_shuffle(docs, id_col, text_col, seed, bucket_bytes)
    # shard s has the places from floor(s n / n_shards) on
    shard = F.floor(((F.col("place") + 1) * n_shards - 1) / F.lit(max(n, 1))).cast("int")
    at = placed.withColumn("_shard", shard).withColumn("_slot", F.col("place") - F.expr(f"(_shard * {n}L) div {n_shards}"))
    other = [c for c in docs.columns if c != id_col]
    # a bucket is one row of its table, so its records come in order, for one shard after another
    named = at.select(F.col(f"_rec.`{id_col}`").alias(id_col), *[F.col(f"_rec.`{c}`").alias(new) for c, new in zip(other, carried(other, id_col), strict=True)], F.col("_slot").cast("long").alias("slot"), F.col("_shard").alias("shard"))
    return _written(named, path, "shard")


def shard_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard (null under the law `rows`), read off the written shards."""
    path = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex[:12]}"
    rows = write_shards(docs, path, id_col, text_col, n_shards, seed, bucket_bytes)
    text = F.coalesce(F.col(f"`{carried([text_col], id_col)[0]}`"), F.lit(""))
    return rows.select(
        id_col, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

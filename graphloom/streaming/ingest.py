"""Streaming: interaction counts, follow-ups, debounced paths, upserts and the job queue."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.plans.iterate import cut, forget
from graphloom.sources.sinks import replace_partitions


def counts_stream(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """uid, window, kind, n: event-time windows with late data up to the watermark."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "uid", "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "uid", "kind", "n")


def debounced(paths: DataFrame, quiet: str = "2 seconds", watermark: str = "10 seconds", key: str = "root") -> DataFrame:
    """Sessions of file events (ts, root, path) below each watched root that end after a quiet period: root, start, end, paths."""
    return paths.withWatermark("ts", watermark).groupBy(key, F.session_window("ts", quiet)).agg(F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "paths")


def follow_up_stream(events: DataFrame, seconds: float = 30.0, forget_after: float = 3600.0) -> DataFrame:
    """event_id, uid, gap: accesses within some seconds of the last other event of the session and uid.

    The state of a pair is one number; it is dropped when nothing has come for `forget_after` seconds.
    """

    def step(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        t = rows["ts"].map(pd.Timestamp.timestamp).to_numpy(float)
        access = (rows["kind"] == "access").to_numpy()
        last = np.maximum.accumulate(np.r_[state.get[0] if state.exists else -np.inf, np.where(access, -np.inf, t)])
        gap = t - last[:-1]
        hit = access & (gap <= seconds)
        if last[-1] > -np.inf:
            state.update((float(last[-1]),))
            state.setTimeoutDuration(int(forget_after * 1000))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy()[hit], "uid": key[1], "gap": gap[hit].round(6)})

    return events.groupBy("session", "uid").applyInPandasWithState(step, "event_id long, uid string, gap double", "last double", "append", "ProcessingTimeTimeout")


def latest(journal: DataFrame, key: str = "uid", order: str = "seq") -> DataFrame:
    """The last entry of each key; tombstones (deleted) remove it."""
    last = journal.groupBy(key).agg(F.max_by(F.struct(*[c for c in journal.columns if c != key]), order).alias("_r")).select(key, "_r.*")
    return last.where(~F.coalesce("deleted", F.lit(False)))


def upsert(table: DataFrame, changes: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """table with the rows of changed and removed keys replaced."""
    gone = changes.select(key)
    if removed is not None:
        gone = gone.unionByName(removed.select(key))
    return table.join(gone.distinct(), key, "left_anti").unionByName(changes)


def start_upserts(stream: DataFrame, path: str, key: str, checkpoint: str, trigger: str = "2 seconds", available_now: bool = False, buckets: int = 256):
    """Micro-batches merged into a Parquet table, partitioned by _bucket, a hash of the key.

    A batch reads and replaces only the partitions it touches. A batch that is run again leaves the same table.
    """

    def merge(batch: DataFrame, _number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), "ts").alias("_r")).select(key, "_r.*").select(*batch.columns)
        new = cut(last.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]
        if touched:
            sc = spark.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            merged = new
            if place.getFileSystem(sc._jsc.hadoopConfiguration()).exists(place):
                old = spark.read.schema(new.schema).parquet(path).where(F.col("_bucket").isin(touched))
                merged = cut(upsert(old, new, key))
            replace_partitions(merged, path, "_bucket")
            if merged is not new:
                forget(merged)
        forget(new)

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def job_queue(requests: DataFrame) -> DataFrame:
    """One job per repository from requests (repo, priority, ts, state): the least priority, requeued when asked again while running."""
    g = requests.groupBy("repo").agg(F.min("priority").alias("priority"), F.max_by("state", F.struct("ts", "state")).alias("last_state"), F.max("ts").alias("last_ts"), F.min("ts").alias("created"), F.count_if(F.col("state") == "running").alias("_run"), F.max(F.when(F.col("state") == "running", F.col("ts"))).alias("_run_ts"))
    return g.select("repo", "priority", "created", F.when(F.col("last_state").isin("done", "failed"), "pending").otherwise(F.col("last_state")).alias("state"), ((F.col("_run") > 0) & (F.col("last_ts") > F.col("_run_ts"))).alias("requeue"))


def claim_next(queue: DataFrame, now, debounce_seconds: int = 0, leases: DataFrame | None = None, lease_seconds: int = 1800) -> DataFrame:
    """The pending job of the least priority, oldest first, that is not debounced and under no live lease."""
    q = queue.where((F.col("state") == "pending") & (F.unix_timestamp("created") + debounce_seconds <= F.unix_timestamp(now)))
    if leases is not None:
        live = leases.where(F.unix_timestamp("claimed") + lease_seconds > F.unix_timestamp(now)).select("repo")
        q = q.join(live, "repo", "left_anti")
    return q.orderBy("priority", "created", "repo").limit(1)


def session_gaps(events: DataFrame, gap_seconds: int) -> DataFrame:
    """events with a session number per user: a new one after a gap."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.coalesce((S.micros("ts") - S.micros(F.lag("ts").over(w)) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    return events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w)).drop("_new")

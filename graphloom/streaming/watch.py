"""Watchers: settled file changes, and a table of a folder's rows that follows them file by file.

File events (path, ts, removed, content) settle: an event waits until nothing has come for its file for a quiet time, and a
file whose content is what it was tells nothing. The state of a file is its last digest and the event that waits, with one
timer; a removed file leaves none.

The table is kept as what each batch brought:

* files/batch=: file_path, removed, rows: one row for each file that changed;
* rows/batch=: the rows that those files now hold.

A file's rows are those of the last batch that names it, so a change deletes what the file held before and puts in
what it holds now, however its rows' keys have moved. A batch writes its own rows and nothing else; one that runs again after a
restart writes the same folders again. `compact` joins batches when most rows are dead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from graphloom.plans.iterate import exists

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLED = "path string, ts timestamp, removed boolean, content string"


class Settle(StatefulProcessor):
    """A file's last event, once the quiet time has passed, if it changes the file."""

    def __init__(self, quiet_ms: int):
        self.quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "ts long, removed boolean, content string")
        self.told = handle.getValueState("told", "digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import hashlib

        latest = None
        for part in rows:
            for ts, removed, content in zip(part["ts"], part["removed"], part["content"], strict=True):
                gone = bool(removed) if removed is not None and removed == removed else False
                text = content if isinstance(content, str) and not gone else ""
                # of events at one time the removal comes first, then texts in the order of digests, so that any order of arrival settles alike
                one = (int(pd.Timestamp(ts).value // 1_000_000), not gone, hashlib.sha256(text.encode()).hexdigest(), text)
                latest = one if latest is None else max(latest, one)
        if latest is not None:
            held = self.waits.get() if self.waits.exists() else None
            before = None if held is None else (held[0], not held[1], hashlib.sha256((held[2] or "").encode()).hexdigest())
            if before is None or latest[:3] >= before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.waits.update((latest[0], not latest[1], latest[3]))
                self.handle.registerTimer(latest[0] + self.quiet)
        yield pd.DataFrame({"path": [], "ts": [], "removed": [], "content": []}).astype({"path": str, "ts": "datetime64[us]", "removed": bool, "content": str})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import hashlib

        if self.waits.exists():
            ts, removed, content = self.waits.get()
            self.waits.clear()
            digest = "" if removed else hashlib.sha256((content or "").encode()).hexdigest()
            before = self.told.get()[0] if self.told.exists() else ""
            if removed:
                self.told.clear()
            else:
                self.told.update((digest,))
            if digest != before:
                yield pd.DataFrame({"path": [key[0]], "ts": pd.to_datetime([ts], unit="ms").astype("datetime64[us]"), "removed": [bool(removed)], "content": [None if removed else content]})


def settled(events: DataFrame, quiet_seconds: float = 2.0, watermark: str = "10 seconds") -> DataFrame:
    """path, ts, removed, content: changes of files, when their quiet time has passed by the events' own clock.

    Needs a state store with timers: the session's is set to one.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select("path", "ts", "removed", "content").withWatermark("ts", watermark)
    return rows.groupBy("path").transformWithStateInPandas(statefulProcessor=Settle(int(quiet_seconds * 1000)), outputStructType=StructType.fromDDL(SETTLED), outputMode="Append", timeMode="EventTime")


def write_batch(changes: DataFrame, path: str, number: int, parse: Callable[[DataFrame], DataFrame]) -> None:
    """A batch of settled changes into the table; parse: path, content to rows with a column file_path.

    The files are written last: a batch without them is not read.
    """
    last = changes.groupBy("path").agg(F.max_by(F.struct("removed", "content"), F.struct("ts", "removed")).alias("x")).select("path", "x.*").persist()
    try:
        if not last.isEmpty():
            rows = parse(last.where(~F.col("removed")).select("path", "content"))
            rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            last.select(F.col("path").alias("file_path"), "removed").coalesce(1).write.mode("overwrite").parquet(f"{path}/files/batch={number}")
    finally:
        last.unpersist()


def current(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all files as they are now; schema: of the rows that parse gives."""
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names
    if not exists(spark, f"{path}/files"):
        return spark.createDataFrame([], schema)
    files = spark.read.schema("file_path string, removed boolean, batch long").parquet(f"{path}/files")
    last = files.groupBy("file_path").agg(F.max("batch").alias("batch"), F.max_by("removed", "batch").alias("removed")).where(~F.col("removed")).select("file_path", "batch")
    full = (StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))).add("batch", "long")
    rows = spark.read.schema(full).parquet(f"{path}/rows")
    return rows.join(last, ["file_path", "batch"], "left_semi").select(*names)


def start(events: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame], quiet_seconds: float = 2.0, watermark: str = "10 seconds", trigger: str = "2 seconds", available_now: bool = False):
    """Follows file events: settled changes are parsed and put into the table of `current`."""
    writer = settled(events, quiet_seconds, watermark).writeStream.outputMode("append").foreachBatch(lambda batch, number: write_batch(batch, path, number, parse)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start()


def compact(spark: SparkSession, path: str, to: str, schema: StructType | str, ratio: float = 2.0) -> bool:
    """Writes the live rows of a table to a new folder as one batch, the last of it, if it holds `ratio` times as many; whether it did.

    The old folder stays for its readers; a stream goes on in the new one, whose next batch is greater.
    """
    held = spark.read.parquet(f"{path}/rows").count()
    now = current(spark, path, schema)
    if held < ratio * max(1, now.count()):
        return False
    number = spark.read.parquet(f"{path}/files").agg(F.max("batch")).first()[0]
    now.repartitionByRange("file_path").write.parquet(f"{to}/rows/batch={number}")
    now.select("file_path", F.lit(False).alias("removed")).distinct().write.parquet(f"{to}/files/batch={number}")
    return True

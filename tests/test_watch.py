"""Watchers: what a stream of file events leaves is what a batch over the last contents gives."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import watch

ROWS = "file_path string, line int, name string"
EVENTS = "path string, ts timestamp, removed boolean, content string"


def parse(files):
    lines = files.select(F.col("path").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("line", "name"))
    return lines.where("name <> ''").select("file_path", "line", "name")


class Source:
    """A folder of event files; each drop is one batch, and ends with a tick that moves the clock past all quiet times."""

    def __init__(self, spark, root):
        self.spark, self.root, self.clock, self.n = spark, root, 1_700_000_000, 0
        (root / "in").mkdir()

    def drop(self, events, tick=True):
        self.n += 1
        self.clock += 100
        rows = [(p, self.clock + dt, removed, content) for p, dt, removed, content in events]
        if tick:
            rows.append(("tick", self.clock + 90, True, None))
        df = self.spark.createDataFrame(rows, "path string, t long, removed boolean, content string").select("path", F.timestamp_seconds("t").alias("ts"), "removed", "content")
        df.coalesce(1).write.mode("append").parquet(str(self.root / "in"))

    def run(self):
        stream = self.spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(self.root / "in"))
        q = watch.start(stream, str(self.root / "table"), str(self.root / "checkpoint"), parse, quiet_seconds=2, watermark="5 seconds", available_now=True)
        assert q.awaitTermination(240)
        assert q.exception() is None

    def table(self):
        return sorted(tuple(r) for r in watch.current(self.spark, str(self.root / "table"), ROWS).collect())


def batch(files):
    return sorted((p, k, x) for p, c in files.items() for k, x in enumerate(c.split("\n")) if x)


@pytest.fixture
def source(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Source(spark, tmp_path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)


def test_stream_equals_batch_after_edits_removals_and_a_restart(source):
    files = {f"f{k}": f"a{k}\nb{k}" for k in range(12)}
    source.drop([(p, 0, False, c) for p, c in files.items()])
    source.run()
    source.drop([], tick=True)
    source.run()
    assert source.table() == batch(files)
    rng = random.Random(2)
    for step in range(2):  # each run begins anew from the checkpoint
        events = []
        for p in rng.sample(sorted(files), 4):
            files[p] = f"new{step}\n{p}" + "\nmore" * rng.randint(0, 2)  # a name moves to another line, others go
            events += [(p, 0, False, "half written"), (p, 1, False, files[p])]
        for p in rng.sample(sorted(files), 2):
            files.pop(p)
            events = [e for e in events if e[0] != p] + [(p, 1, True, None)]
        files[f"g{step}"] = "fresh"
        events.append((f"g{step}", 0, False, "fresh"))
        rng.shuffle(events)
        source.drop(events)
        source.drop([])
        source.run()
        assert source.table() == batch(files)


def test_work_grows_with_the_change(source, tmp_path):
    files = {f"f{k:03}": "x\n" * 50 for k in range(60)}
    source.drop([(p, 0, False, c) for p, c in files.items()])
    source.drop([])
    source.run()
    before = {p for p in (tmp_path / "table").rglob("*.parquet")}
    # one file changes, one is touched without a change
    files["f007"] = "y\n"
    source.drop([("f007", 0, False, "y\n"), ("f008", 0, False, files["f008"])])
    source.drop([])
    source.run()
    new = [p for p in (tmp_path / "table").rglob("*.parquet") if p not in before]
    assert before <= {p for p in (tmp_path / "table").rglob("*.parquet")}
    written = source.spark.read.parquet(*[str(p) for p in new if "/rows/" in str(p)])
    assert [tuple(r) for r in written.select("file_path", "name").collect()] == [("f007", "y")]
    assert source.table() == batch(files)


def test_a_batch_that_runs_again_and_one_that_broke_off(spark, tmp_path):
    path = str(tmp_path / "t")
    now = spark.createDataFrame([("a", 1, False, "x\ny"), ("b", 1, False, "z")], "path string, t long, removed boolean, content string").select("path", F.timestamp_seconds("t").alias("ts"), "removed", "content")
    for _ in range(2):
        watch.write_batch(now, path, 0, parse)
    want = [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]
    got = lambda p=path: sorted(tuple(r) for r in watch.current(spark, p, ROWS).collect())
    assert got() == want
    parse(spark.createDataFrame([("a", "lost")], "path string, content string")).write.parquet(f"{path}/rows/batch=1")
    assert got() == want
    for k in range(2, 5):
        watch.write_batch(now.where("path = 'a'").withColumn("content", F.lit(f"v{k}")), path, k, parse)
    watch.write_batch(now.where("path = 'b'").withColumns({"removed": F.lit(True), "content": F.lit(None).cast("string")}), path, 5, parse)
    assert got() == [("a", 0, "v4")]
    to = str(tmp_path / "u")
    assert watch.compact(spark, path, to, ROWS) and got(to) == got()
    watch.write_batch(now.where("path = 'b'"), to, 6, parse)
    assert got(to) == [("a", 0, "v4"), ("b", 0, "z")] and not watch.compact(spark, to, str(tmp_path / "v"), ROWS)


def test_an_empty_table(spark, tmp_path):
    assert watch.current(spark, str(tmp_path / "none"), ROWS).count() == 0

"""Packing of documents into token windows: best-fit decreasing over the counts of lengths.

A document is its token ids and an end id. Documents longer than a window are first cut into full windows and a
rest. Best-fit decreasing looks at nothing but lengths, and pieces of one length are alike, so it is planned on the
histogram of lengths, which has at most as many rows as a window has tokens, whatever the input: lengths are placed
from the longest down; a segment tree indexed by remaining capacity finds the tightest windows that are open; a run of windows
with the same content takes a run of pieces in one step. The plan is what one pass over all pieces, one by one, would
give, for the whole corpus at once.

Pieces learn their places by counting: each is numbered among those of its length in its task, the tasks' counts are
added up, and the number in the corpus names the window. Tokenised pieces are written to the shared folder once; nothing
is sorted, no task sees more than its own rows, and only the histogram comes to the driver.

Null and empty texts are the end id alone. Repeated rows and ids are packed as documents of their own. Very long texts are
whole documents in many windows (one call of the tokenizer takes some fifty times its text's room). An empty table gives no
rows. Only the id and the text are read, so names of other columns cannot clash. A string of a special token inside a text
is read as the tokenizer file says.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.byte_level import ByteLevel
from graphloom.llm.common import chunks, small_batches, written

WINDOW = 2048
END = 1
CHUNK = 3 << 20
#: A plan of so many rows is sent to every task; one of more rows is joined by length.
SMALL_PLAN = 1 << 17


class Capacities:
    """A segment tree over remaining capacities 0 to `most`: how many open windows have each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The least capacity, `need` at least, that an open window has."""
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1 and (k & 1 or not self.count[k + 1]):
            k >>= 1
        if k <= 1:
            return None
        k += 1
        while k < self.size:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit(lengths: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, ...]], int]:
    """(length, first, n, sequence, each, offset) for runs of pieces, and the number of windows.

    Pieces `first` to `first + n - 1` of a length lie in windows `sequence`, `sequence + 1`, ..., `each` to a window, one after
    another from `offset` on. A window that takes a piece and has room for a second is still the tightest, so it takes all
    it can hold before the next one.
    """
    tree = Capacities(window)
    open_: dict[int, list[tuple[int, int]]] = {}
    rows: list[tuple[int, ...]] = []
    windows = 0

    def put(capacity: int, at: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((at, n))
            tree.add(capacity, n)

    def fill(length: int, capacity: int, at: int, n: int, placed: int, left: int) -> int:
        """Windows at .. at + n - 1 take pieces; how many pieces they took."""
        each = capacity // length
        full = min(n, left // each)
        took = full * each
        if full:
            rows.append((length, placed, took, at, each, window - capacity))
            put(capacity - each * length, at, full)
        if full < n and took < left:
            rest = left - took
            rows.append((length, placed + took, rest, at + full, rest, window - capacity))
            put(capacity - rest * length, at + full, 1)
            took, full = left, full + 1
        put(capacity, at + full, n - full)
        return took

    for length in sorted(lengths, reverse=True):
        count = left = lengths[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = window // length
                n = -(-left // each)
                left -= fill(length, window, windows, n, count - left, left)
                windows += n
                continue
            at, n = open_[capacity].pop()
            tree.add(capacity, -n)
            left -= fill(length, capacity, at, n, count - left, left)
    return rows, windows


_READY: dict[int, ByteLevel] = {}


def _tokenizer(text: str) -> ByteLevel:
    key = hash(text)
    if key not in _READY:
        _READY[key] = ByteLevel(text)
    return _READY[key]


def encode(tokenizer: str, texts: list[str], end: int = END) -> Iterator[np.ndarray]:
    """Each text's ids and the end id; tokenizer: its file's text."""
    last = np.array([end], "<u4")
    for ids in _tokenizer(tokenizer).ids(texts):
        yield np.concatenate([ids, last])


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """A row for each full window and rest of every document, with its number among those of its length in its task.

    id_col, start, length, ids_crc32, doc_tokens, task, nth, and ids (array<long>) where asked for.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        held_text = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for t in chunks(batches, "text", CHUNK):
            which: list[int] = []
            cols: list[list[int]] = [[], [], [], [], []]
            held: list[np.ndarray] = []
            for k, ids in enumerate(encode(held_text.value, [x or "" for x in t.column("text").to_pylist()])):
                for start in range(0, len(ids), window):
                    part = ids[start : start + window]
                    n = len(part)
                    nth = seen.get(n, 0)
                    seen[n] = nth + 1
                    which.append(k)
                    for col, v in zip(cols, (start, n, zlib.crc32(part.tobytes()), len(ids), nth), strict=True):
                        col.append(v)
                    if with_ids:
                        held.append(part)
            start, n, crc, total, nth = (pa.array(c, pa.int64()) for c in cols)
            out = [t.column("id").combine_chunks().take(pa.array(which, pa.int64())), start, n, crc, total, pa.array(np.full(len(which), task), pa.int64()), nth]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
            if with_ids:
                out.append(pa.array([x.astype(np.int64) for x in held], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long" + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def packed(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids where asked for)."""
    spark = docs.sparkSession
    stored = written(pieces(docs, tokenizer_path, id_col, text_col, window, with_ids), "pieces")
    counts = written(stored.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `window` rows at most
    rows, _ = best_fit(lengths, window)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "of long, first long, n long, sequence long, each long, at long")
    before = counts.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = stored.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    inside = (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))
    placed = ranked.join(F.broadcast(plan) if len(rows) <= SMALL_PLAN else plan, inside)
    k = F.col("rank") - F.col("first")
    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + (k % F.col("each")) * F.col("length")).cast("long").alias("offset")]
    return placed.select(*out, *(["ids"] if with_ids else []))


def sequences(pieces_placed: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, ids, n_tokens of packed(..., with_ids=True): padded to the window, except where the tokens are a power of two."""
    parts = pieces_placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    whole = F.expr("n_tokens & (n_tokens - 1)") == 0
    padding = F.when(whole, F.expr("array()").cast("array<long>")).otherwise(F.array_repeat(F.lit(pad).cast("long"), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return parts.select("sequence_id", F.concat(ids, padding).alias("ids"), "n_tokens")

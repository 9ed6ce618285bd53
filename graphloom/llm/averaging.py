"""Training on all labelled rows: partitions learn on from common parameters, and what they change is averaged.

A round reads every training row. A partition goes through its rows in chunks of CHUNK bytes of text, so its memory does not depend on
how many there are; then it sends the rows of parameters that it changed. Changes are summed as integers (SCALE), weighted by the texts
of the partition, so that the result does not depend on the order in which partitions end. A parameter that few partitions touch is
averaged over those. What comes to the driver is one model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, text_bytes, written

#: Parameters in one row of what is sent.
ROW = 16
SCALE = 1 << 24
#: Texts that a partition has at least, as far as there are so many.
SHARD_ROWS = 4096
CHUNK = 16 << 20
#: Rows of parameters in one batch.
SENT = 1 << 14

_V = [f"v{k}" for k in range(2 * ROW)]
_SCHEMA = "at long, n long, " + ", ".join(f"{x} long" for x in _V)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> DataFrame:
    """text, label, draw (a hash of the id): one row for every labelled id for which usable holds, stored.

    An id that is on several rows counts once, with the least of its texts and of its labels.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.where(usable).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    once = texts.join(marks, "id").groupBy("id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    return written(once.select("text", "label", F.xxhash64(F.lit(11), "id").alias("draw")), "training-rows")


def _flat(d: dict[str, np.ndarray]) -> np.ndarray:
    x = np.concatenate([d[k].ravel() for k in sorted(d)])
    return np.pad(x, (0, -len(x) % ROW)).reshape(-1, ROW)


def _back(x: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = x.ravel()[at : at + like[k].size].reshape(like[k].shape).astype(like[k].dtype)
        at += like[k].size
    return out


def averaged_round(rows: DataFrame, count: int, m: dict, seen: dict, learn: Callable[[dict, dict, list[bytes], np.ndarray, int], None]) -> tuple[dict, dict]:
    """m and seen after one round over all rows (text, label), of which there are count.

    learn(m, seen, texts, labels, done) changes m and seen in place by a chunk of texts, after so many of the partition.
    """
    shared = rows.sparkSession.sparkContext.broadcast((m, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = tuple({k: x.copy() for k, x in d.items()} for d in shared.value)
        n = 0
        for t in chunks(batches, "text", CHUNK):
            learn(*now, text_bytes(t.column("text")), t.column("label").to_numpy().astype(np.float32), n)
            n += t.num_rows
        if not n:
            return
        change = np.concatenate([_flat(a) - _flat(b) for a, b in zip(now, shared.value, strict=True)], axis=1)
        at = np.flatnonzero(change.any(1))
        for k in range(0, len(at), SENT):
            some = at[k : k + SENT]
            whole = np.rint(change[some].astype(np.float64) * SCALE).astype(np.int64) * n
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), n)), *[pa.array(np.ascontiguousarray(x)) for x in whole.T]], names=["at", "n", *_V])

    sums = rows.select("text", "label").coalesce(max(1, count // SHARD_ROWS)).mapInArrow(run, _SCHEMA).groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in _V])
    got = sums.select("at", *[(F.col(x) / (F.col("n") * F.lit(float(SCALE)))).cast("float").alias(x) for x in _V]).toArrow()
    shared.unpersist()
    at = got.column("at").to_numpy()
    new = []
    for d, names in ((m, _V[:ROW]), (seen, _V[ROW:])):
        x = _flat(d)
        x[at] += np.stack([got.column(c).to_numpy() for c in names], 1)
        new.append(_back(x, d))
    return new[0], new[1]

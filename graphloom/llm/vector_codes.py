"""Codes for vectors: each vector is cut into parts, and a part becomes the index of its nearest codebook entry.

Components become integers, floor(scale * x). The codebook of a part position begins as that part of the rows with
the smallest ids and is bettered by Lloyd rounds: every part goes to its nearest entry (squared Euclidean distance, ties to
the lower index), then every used entry becomes the floor of its parts' mean. Assignment is Hamerly's: with each part
are kept an upper bound of the distance to its own entry and one lower bound of the distance to the second nearest. After entries
have moved, the bounds give way by how far they moved; a part is looked at only if its upper bound is not strictly
below both the lower bound and half the distance from its entry to the nearest other one, is first measured against its own
entry, and is scanned against all entries, in exact integers, only if that does not decide. Bounds are kept in doubles and
widened by more than rounding can take, so a skipped part has one nearest entry, strictly; ties are always scanned.

Rows, their codes and their bounds are a table in the shared folder, written once a round in one pass without a
shuffle; the sums of parts by entry are added up in the tasks first. Only the codebooks (parts x entries, whatever the input)
come to the driver.

Vectors that are null or empty, or hold null or non-finite components, are left out. So that all sums fit into longs, a component's integer
is held within a limit, 2^27 for 64 dimensions, far beyond the values of embeddings. Vectors take part when they have the
length of the first (smallest id) one that can be cut; others are returned with null code and error. Rows
that repeat an id are rows of their own; among them the codebook begins with the lesser vector, and null ids come last. With fewer rows than entries
the codebook is smaller. An empty table gives no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import batches_of, forget, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of an Arrow batch: bounds the table of distances, rows x entries.
ROWS = 8192
#: Bounds are widened by this share of themselves and of the distances; a double's rounding is below 2^-52.
SLACK = 1e-9
#: Tables of label sums are sent to every task up to so many rows.
SMALL = 1 << 16


def limit(dims: int) -> int:
    """Components within it keep the squared distances of a vector's parts, added up, below 2^63."""
    return int((2**63 / (8 * max(dims, 1))) ** 0.5)


def kept_rows(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (array<long>), of whole finite vectors."""
    x = F.col(vector_col)
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    scaled = F.transform(x, lambda c: F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), F.floor(c.cast("double") * float(scale)).cast("double"))).cast("long"))
    return rows.where(x.isNotNull() & (F.size(x) > 0) & ~odd).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), scaled.alias("v"))


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries; in doubles where those hold every term."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * most * most < 2**53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        d = a @ b.T
        d *= -2
        d += (a * a).sum(1)[:, None]
        d += (b * b).sum(1)
        return d.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in book], 1)


def own(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    return ((x - book[code]) ** 2).sum(1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of a tie), an upper bound of its distance, a lower one of the second nearest's."""
    d = squared(x, book)
    code = d.argmin(1)
    rows = np.arange(len(x))
    first = d[rows, code].astype(np.float64)
    d[rows, code] = np.iinfo(np.int64).max
    second = d.min(1).astype(np.float64) if len(book) > 1 else np.full(len(x), np.inf)
    return code, np.sqrt(first) * (1 + SLACK), np.sqrt(second) * (1 - SLACK)


class Moved:
    """What a codebook's last step means for bounds: how far entries moved, and half the gap to their nearest other entry."""

    def __init__(self, book: np.ndarray, before: np.ndarray):
        self.book = book
        self.by = np.sqrt(own(book, before, np.arange(len(book))).astype(np.float64)) * (1 + SLACK)
        order = np.argsort(-self.by, kind="stable")
        self.most = np.full(len(book), self.by[order[0]])  # of the entries but one's own
        self.most[order[0]] = self.by[order[1]] if len(book) > 1 else 0.0
        gaps = squared(book, book)
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        self.half = np.sqrt(gaps.min(1).astype(np.float64)) / 2 * (1 - SLACK) if len(book) > 1 else np.full(1, np.inf)


def assign(x: np.ndarray, moved: Moved, code: np.ndarray, up: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Brings codes and bounds up to date, in place; which rows were scanned."""
    up += moved.by[code]
    low -= moved.most[code]
    up *= 1 + SLACK
    low -= SLACK * np.abs(low)
    safe = np.maximum(low, moved.half[code])
    open_ = np.flatnonzero(~(up < safe))
    up[open_] = np.sqrt(own(x[open_], moved.book, code[open_]).astype(np.float64)) * (1 + SLACK)
    open_ = open_[~(up[open_] < safe[open_])]
    if len(open_):
        code[open_], up[open_], low[open_] = scan(x[open_], moved.book)
    return open_


STATE = "id long, label {label}, v array<int>, code array<int>, up array<double>, low array<double>, error long, scanned int"


def _flat(b: pa.RecordBatch, name: str, width: int, dtype) -> np.ndarray:
    return b.column(name).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), kind))


def assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None, label_type: T.DataType) -> DataFrame:
    """One pass: rows with their codes and bounds; before: the codebooks that the rows' bounds belong to, None if they have none.

    error: the squared distances to the nearest entries, over the parts. scanned: how many of a row's parts were.
    """
    parts, _, width = books.shape
    dims, most = parts * width, limit(parts * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = None if before is None else [Moved(a, b) for a, b in zip(books, before, strict=True)]
        for b in batches:
            if not b.num_rows:
                continue
            v = np.clip(_flat(b, "v", dims, np.int64), -most, most)
            x = v.reshape(-1, parts, width)
            scanned = np.zeros(len(v), np.int64)
            if moved is None:
                each = [scan(x[:, p], books[p]) for p in range(parts)]
                code, up, low = (np.stack([e[k] for e in each], 1) for k in range(3))
                scanned += parts
            else:
                code, up, low = _flat(b, "code", parts, np.int64), _flat(b, "up", parts, np.float64).copy(), _flat(b, "low", parts, np.float64).copy()
                for p in range(parts):
                    c, u, w = code[:, p].copy(), up[:, p].copy(), low[:, p].copy()
                    scanned[assign(x[:, p], moved[p], c, u, w)] += 1
                    code[:, p], up[:, p], low[:, p] = c, u, w
            error = sum(own(x[:, p], books[p], code[:, p]) for p in range(parts))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), _lists(v, pa.int32()), _lists(code, pa.int32()), _lists(up, pa.float64()), _lists(low, pa.float64()), pa.array(error, pa.int64()), pa.array(scanned, pa.int32())],
                names=["id", "label", "v", "code", "up", "low", "error", "scanned"],
            )

    return rows.mapInArrow(run, STATE.format(label=label_type.simpleString()))


def sums(state: DataFrame, parts: int, width: int, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the parts of every entry, added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x, code = _flat(b, "v", parts * width, np.int64).reshape(-1, parts, width), _flat(b, "code", parts, np.int64)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                at, first = np.unique(code[order, p], return_index=True)
                n[p, at] += np.diff(np.append(first, len(order)))
                total[p, at] += np.add.reduceat(x[order, p], first, axis=0)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), _lists(total[p, e], pa.int64())], names=["part", "entry", "n", "total"])

    got = state.select("v", "code").mapInArrow(run, "part int, entry int, n long, total array<long>")
    rows = got.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(width))).alias("total")).collect()  # parts x entries at most
    n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for r in rows:
        n[r.part, r.entry], total[r.part, r.entry] = r.n, r.total
    return n, total


def better(books: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Entries at the floor of their parts' means; unused ones where they were."""
    return np.where((n > 0)[..., None], total // np.maximum(n, 1)[..., None], books)


def fitted(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None, DataFrame]:
    """Rows with codes, bounds and errors after the rounds; the codebooks (parts, entries, components); rows that take no part."""
    spark = rows.sparkSession
    kept = written(kept_rows(rows, id_col, vector_col, label_col, scale), "vectors")
    label = kept.schema["label"].dataType
    order = (F.asc_nulls_last("id"), "v")
    first = kept.where(F.size("v") % parts == 0).orderBy(*order).select(F.size("v").alias("dims")).first()
    none = spark.createDataFrame([], STATE.format(label=label.simpleString()))
    if first is None:
        return none, None, kept
    dims = first.dims
    fits = F.size("v") == dims
    begin = kept.where(fits).orderBy(*order).limit(entries).select("v").collect()
    most = limit(dims)
    books = np.clip(np.array([r.v for r in begin], np.int64), -most, most).reshape(len(begin), parts, -1).transpose(1, 0, 2).copy()
    state, before = None, None
    with batches_of(spark, ROWS):
        for k in range(rounds + 1):
            old, state = state, written(assigned(kept.where(fits) if k == 0 else state, books, before, label), "codes")
            if old is not None:
                forget(old)
            if k < rounds:
                before, books = books, better(books, *sums(state, parts, dims // parts, len(begin)))
    return state, books, kept.where(~fits)


def coded(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", **settings: int) -> DataFrame:
    """id_col, code, error, label_error (over the rows of the label, nulls together), codebooks_sha256."""
    state, books, rest = fitted(rows, id_col, vector_col, label_col, **settings)
    text = "" if books is None else ",".join(map(str, books.reshape(-1).tolist()))
    hexes = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    every = state.select("id", "label", hexes.alias("code"), "error").unionByName(rest.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    labels = written(every.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")), "label-errors")
    n = labels.count()
    if n <= SMALL:
        out = every.join(F.broadcast(labels), F.col("label").eqNullSafe(F.col("of")), "left")
    else:  # many labels: one may still hold many rows, so its total goes to 32 places
        salted = labels.select("of", "label_error", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_to"))
        out = every.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(32)).cast("int")).join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("_salt") == F.col("_to")), "left")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """codes and the vectors that they stand for: each part's entry, scaled back."""
    book = F.array(*(F.array(*(F.array(*(F.lit(float(c) / scale) for c in entry)) for entry in part)) for part in books.tolist()))
    at = lambda p: F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.flatten(F.array(*(F.get(F.get(book, F.lit(p)), at(p)) for p in range(len(books))))))

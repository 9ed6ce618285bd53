"""Exact top-k search for the largest inner products, by norm buckets.

Vectors are put into buckets of like length (norm), BLOCK vectors each, longest first. A first pass
searches the longest bucket for every query, which gives each query a threshold: the k-th best score so
far. Queries that need candidates of like length (threshold / own length) are then put into blocks, and a second
pass lets a block meet only buckets whose greatest length can reach the least need of the block; blocks and
buckets are matched by level of length before any vector moves. Inside a bucket the local threshold on the cosine,
threshold / (query length * greatest length), decides how candidates are pruned: where it is low, by length (the
bucket is sorted; a prefix is enough), where it is high, by coordinate (the query's strongest coordinates bound, by
Cauchy-Schwarz, what the rest can add). What remains is verified by integer products, in blocks, and the
k best of each pair are merged. Nothing is dropped: a pair that is skipped cannot be among the k best,
ties included.

Components are floor(scale * x); scores are exact integers: products that doubles hold exactly are taken in
doubles, pairs with a very long vector in Python's integers. A score beyond the range of a long is given as its
limit, and such scores tie. Vectors that are null or hold null or non-finite components take no part; nor do rows
with a null id. Rows that repeat an id are candidates of their own for other queries and, as "every row but the
query's own" goes by id, not for one another; where a query's id repeats, its vector is the least in the order of
bytes. Vectors of different lengths never match. Ties go to the smaller id. Other columns are not read, so their
names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches, written

BLOCK = 8192
QUERY_BLOCK = 2048
#: Local cosine thresholds from this on prune by coordinate, so many queries at a time.
BY_COORDINATE = 0.5
FOCUS = 4
TOGETHER = 16
#: Lengths, and what queries need of them, are told apart in so many levels, at most.
LEVELS = 1024
#: Tables of levels are sent to every task when they have no more rows than this.
SMALL = 1 << 16
#: Vectors from this length on are multiplied in Python's integers.
LONG = 2.0**26
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v (binary of doubles that hold integers), norm2, dim; only whole finite vectors."""
    x = F.col(vector_col)
    whole = x.isNotNull() & F.col(id_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("x")
            off = lists.offsets.to_numpy()
            flat = np.floor(scale * lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
            parts = [flat[a:z] for a, z in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([float(p @ p) for p in parts], pa.float64()), pa.array([len(p) for p in parts], pa.int32())], names=["id", "v", "norm2", "dim"])

    return rows.where(whole).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("x")).mapInArrow(run, "id long, v binary, norm2 double, dim int")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def products(q: np.ndarray, q_norm: np.ndarray, c: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, cut to its range."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    if q_norm.max() < LONG and c_norm.max() < LONG:
        exact = np.float32 if q_norm.max() * c_norm.max() < 2**23 else np.float64
        return (q.astype(exact) @ c.T.astype(exact)).astype(np.int64)
    out = np.empty((len(q), len(c)), np.int64)
    few, many = np.flatnonzero(q_norm >= LONG), np.flatnonzero(q_norm < LONG)
    far, near = np.flatnonzero(c_norm >= LONG), np.flatnonzero(c_norm < LONG)
    if len(many) and len(near):
        out[np.ix_(many, near)] = products(q[many], q_norm[many], c[near], c_norm[near])
    for rows, columns in ((few, np.arange(len(c))), (many, far)):
        whole = [[int(x) for x in c[j]] for j in columns]
        for i in rows:
            own = [int(x) for x in q[i]]
            out[i, columns] = [min(max(sum(map(int.__mul__, own, x)), _LEAST), _MOST) for x in whole]
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, k: int) -> tuple:
    """(query id, candidate id, score) of the k best candidates of each row that reach its threshold."""
    scores[q_ids[:, None] == ids[None, :]] = _LEAST - 1
    kk = min(k, scores.shape[1])
    kth = np.partition(scores, scores.shape[1] - kk, axis=1)[:, scores.shape[1] - kk]
    r, j = np.nonzero((scores >= kth[:, None]) & (scores >= theta[:, None]) & (scores >= _LEAST))
    val = scores[r, j]
    o = np.lexsort((ids[j], -val, r))
    r, j, val = r[o], j[o], val[o]
    top = np.arange(len(r)) - np.searchsorted(r, r) < k
    return q_ids[r[top]], ids[j[top]], val[top]


def search_block(q: np.ndarray, q_ids: np.ndarray, theta: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> list[tuple]:
    """(query id, candidate id, score) of the k best candidates of each query that reach its threshold."""
    with np.errstate(over="ignore"):
        norm = np.sqrt((c * c).sum(1))
        q_norm = np.sqrt((q * q).sum(1))
    order = np.lexsort((c_ids, -norm))
    c, c_ids, norm = c[order], c_ids[order], norm[order]
    out = []
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        local = np.nan_to_num(np.where((q_norm > 0) & (norm[0] > 0), theta / (q_norm * norm[0]), -1.0), nan=-1.0)
        # by length: beyond the prefix, even a parallel vector stays under the threshold
        least = np.nan_to_num(np.where(q_norm > 0, theta / q_norm, -np.inf), nan=-np.inf)
    prefix = np.where((theta > 0) & (q_norm > 0), np.searchsorted(-norm, -least * (1 - 1e-12), side="right"), np.where((theta > 0) & (q_norm == 0), 0, len(norm)))
    strict = (local >= BY_COORDINATE) & (q_norm < LONG) & (norm[0] < LONG)
    lenient = np.flatnonzero(~strict & (prefix > 0))
    lenient = lenient[np.argsort(prefix[lenient], kind="stable")]
    for s in range(0, len(lenient), 256):
        rows = lenient[s : s + 256]
        n = int(prefix[rows].max())
        out.append(best_of(products(q[rows], q_norm[rows], c[:n], norm[:n]), c_ids[:n], q_ids[rows], theta[rows], k))
    strict = np.flatnonzero(strict & (prefix > 0))
    strict = strict[np.argsort(prefix[strict], kind="stable")]
    for s in range(0, len(strict), TOGETHER):
        # by coordinate: of each query the FOCUS strongest coordinates, and a bound on the rest
        rows = strict[s : s + TOGETHER]
        n = int(prefix[rows].max())
        may = np.zeros(n, bool)
        for i in rows:
            f = np.argsort(-np.abs(q[i]), kind="stable")[:FOCUS]
            part = c[:n, f]
            rest = np.sqrt(max(0.0, q_norm[i] ** 2 - float(q[i][f] @ q[i][f]))) * np.sqrt(np.maximum(0.0, norm[:n] ** 2 - (part**2).sum(1)))
            may |= (part @ q[i][f] + rest) * (1 + 1e-12) + 1e-6 >= theta[i]
        picked = np.flatnonzero(may)
        if len(picked):
            out.append(best_of(products(q[rows], q_norm[rows], c[picked], norm[picked]), c_ids[picked], q_ids[rows], theta[rows], k))
    return out


_PAIR = "query_id long, vec_id long, score long"


def _meet(k: int):
    def run(key, queries, candidates):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not queries.num_rows or not candidates.num_rows:
            return empty
        dim = candidates.column("dim")[0].as_py()
        got = search_block(_matrix(queries.column("v"), dim), queries.column("id").to_numpy(), queries.column("theta").to_numpy(), _matrix(candidates.column("v"), dim), candidates.column("id").to_numpy(), k)
        if not got:
            return empty
        return pa.table({n: pa.array(np.concatenate([x[i] for x in got])) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return run


def _best(found: DataFrame, k: int, queries: DataFrame) -> DataFrame:
    """The k-th best score of each query so far, a trifle less where doubles round; minus infinity for fewer."""
    ranked = found.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    kth = F.element_at("s", k).cast("double")
    theta = F.when(F.size("s") >= k, kth - F.when(F.abs(kth) > 2.0**52, F.abs(kth) * 1e-15).otherwise(0.0)).otherwise(F.lit(float("-inf")))
    return queries.join(ranked.select(F.col("query_id").alias("id"), theta.alias("theta")), "id", "left").fillna(float("-inf"), ["theta"])


def _levels(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Cuts of a column into n levels of like numbers of rows."""
    return np.unique(rows.approxQuantile(column, [i / n for i in range(1, n)], 0.2 / n)) if n > 1 else np.empty(0)


def _level(cuts: np.ndarray, column: Column) -> Column:
    """How many of the cuts lie over a value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x > column)) if len(cuts) else F.lit(0)


def _with_small(df: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """Joins a table of levels; it goes to every task if it is small, as it is unless vectors have very many lengths."""
    small = written(small, "topk-small")
    return df.join(F.broadcast(small) if small.count() <= SMALL else small, on)


def topk(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score; is_query: a condition on the column id."""
    small_batches(vectors.sparkSession)
    rows = written(quantised(vectors, id_col, vector_col, scale), "topk-vectors")
    # like lengths together: quantiles of the norm; what shares a level is dealt evenly by id
    cuts = _levels(rows, "norm2", min(max(1, math.ceil(rows.count() / block)), LEVELS))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("norm2").to_numpy()
            yield from pa.Table.from_batches([b]).append_column("level", pa.array((len(cuts) - np.searchsorted(cuts, n, side="right")).astype(np.int32))).to_batches()

    placed = rows.mapInArrow(level, "id long, v binary, norm2 double, dim int, level int")
    sizes = placed.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n"))
    placed = written(_with_small(placed, sizes, ["dim", "level"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / block))).withColumn("bucket", F.concat_ws("-", "dim", "level", "part")), "topk-buckets")
    buckets = written(placed.groupBy("bucket", "dim", "level", "part").agg(F.sqrt(F.max("norm2")).alias("longest")), "topk-lengths")
    first = buckets.groupBy("dim").agg(F.min_by("bucket", F.struct("level", "part")).alias("first"))
    asked = rows.where(is_query).groupBy("id").agg(F.min(F.struct("v", "norm2", "dim")).alias("q")).select("id", "q.v", "q.dim", F.sqrt("q.norm2").alias("length"))
    n_query = max(1, math.ceil(asked.count() / query_block))
    queries = written(_with_small(asked, first, ["dim"]).withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_query)).cast("string")), "topk-queries")
    sides = placed.select("bucket", "id", "v", "dim")

    def met(questions: DataFrame, pairs: DataFrame) -> DataFrame:
        """questions: q, id, v, theta; pairs: blocks of questions (q) with the buckets that they meet."""
        a = questions.join(pairs, "q").select(F.col("bucket").alias("ab"), F.col("q").alias("aq"), "id", "v", "theta")
        c = sides.join(pairs, "bucket").select(F.col("bucket").alias("cb"), F.col("q").alias("cq"), "id", "v", "dim")
        return a.groupBy("ab", "aq").cogroup(c.groupBy("cb", "cq")).applyInArrow(_meet(k), _PAIR)

    start = queries.select(F.concat_ws("/", "dim", "q").alias("q"), "id", "v", F.lit(float("-inf")).alias("theta"), "first")
    found = written(met(start.drop("first"), start.select("q", F.col("first").alias("bucket")).distinct()), "topk-first")
    # queries that need like lengths together
    need = F.when((F.col("theta") > 0) & (F.col("length") > 0), F.col("theta") / F.col("length") * (1 - 1e-12)).when((F.col("theta") > 0), F.lit(float("inf"))).otherwise(F.lit(0.0))
    known = written(_best(found, k, queries).withColumn("need", need), "topk-known")
    need_cuts = _levels(known.where("need < double('inf')"), "need", min(n_query, LEVELS))
    known = known.withColumn("q", F.concat_ws("/", F.col("dim"), _level(need_cuts, F.col("need")), F.col("q")))
    blocks = known.where("need < double('inf')").groupBy("q", "dim").agg(F.min("need").alias("least"))
    # a block with the levels that reach its need, then with their buckets
    reach = buckets.groupBy("dim", "level").agg(F.max("longest").alias("longest"))
    levels = reach.groupBy("dim").agg(F.collect_list(F.struct("level", "longest")).alias("levels"))
    able = _with_small(blocks, levels, ["dim"]).select("q", "dim", "least", F.explode(F.expr("filter(levels, x -> x.longest >= least)")).alias("x")).select("q", "dim", "least", F.col("x.level").alias("level"))
    pairs = able.join(buckets, ["dim", "level"]).where("longest >= least").join(first.withColumnRenamed("first", "bucket").select("bucket"), "bucket", "left_anti").select("q", "bucket")
    every = found.unionByName(met(known.select("q", "id", "v", "theta"), written(pairs, "topk-pairs")))
    best = every.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))

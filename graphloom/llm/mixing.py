"""Mixing sources to target weights: raking (iterative proportional fitting) and calibrated sampling.

Every document has a cell: its source, language and topic, each as named in the targets or `other`. The
tokens of all documents are summed by cell; there are at most as many cells as the targets' sizes multiply
to, so the cells are raked on the driver, dimension by dimension, until all marginal shares equal their
targets. A target whose value has no tokens is left out and the rest rescaled. Weights are bounded: a weight
over the bound is cut to it and the factors of the other cells make up for it, and the bound is the least
(found by bisection) under which the shares are still reached, so that as many tokens are kept as the targets
allow. A document is kept with the probability weight / bound of its cell, by a hash of its id: expected
token shares are then the targets, no document is repeated and none has a probability over 1.

A value with so few tokens that its target is over SCARCE times its share is scarce: the bound does not
follow it. Its tokens get the greatest weight (or that which reaches its target, if less), and the other
values share what it cannot fill in proportion to their targets. So a few odd rows never thin the corpus.

Topics are learnt from all texts: a text's vector counts its distinct words of LONG bytes or more by DIMS hash
classes; the mean vector of its language is taken off, so that topics do not repeat the languages, and the
directions are clustered by ROUNDS_OF_TOPICS rounds of spherical k-means over the stored vectors. All sums
are of whole numbers, so topics do not depend on how the table is split. A text without long words has topic 0.

The rows are scanned twice: once for vectors and sizes, which are stored (about 100 bytes a row), and, by `sample`,
once more to draw the rows; nothing is joined by id. Null sources and languages are `other`; null or empty
texts have no tokens. Rows with a null id are drawn by their text. Rows repeating an id are drawn alike where their
cells are. Where a target names values of which the table has none, its dimension is not raked. Targets that
contradict each other or the table are not reached: target_gap tells by how much the furthest marginal is off, and
`most_gap` makes that an error. A very long text is held whole, once, in its task. Columns of the input pass by
untouched, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import chunks, small_batches, text_bytes, written

TOPICS = 8
DIMS = 48
LONG = 6
ROUNDS_OF_TOPICS = 4
#: A direction's length in whole numbers.
UNIT = 1 << 20
SEED = "mix-1"
DIMENSIONS = ("source", "lang", "topic")
OTHER = "other"
ROUNDS = 1000
CHUNK = 4 << 20
#: More cells than this are refused: targets are lists that a person writes.
MOST_CELLS = 1 << 18
#: A value whose target is over SCARCE times its share of the tokens is scarce.
SCARCE = 4.0
#: Marginal shares are reached when none is further off than this.
CLOSE = 1e-8
#: The bound is not raised beyond this where the shares contradict each other.
MOST_WEIGHT = 64.0
HALVINGS = 12


def vector_and_size(text: bytes) -> tuple[np.ndarray, int]:
    """How many distinct long words fall on each hash class, and the number of words."""
    words = text.lower().split()
    long = [w for w in set(words) if len(w) >= LONG]
    c = np.fromiter(map(zlib.crc32, long), np.uint32, len(long)) >> np.uint32(8)
    return np.bincount((c % DIMS).astype(np.int64), minlength=DIMS), len(words)


def _whole(x: np.ndarray) -> np.ndarray:
    """Directions as whole numbers."""
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.rint(x / np.where(size > 0, size, 1) * UNIT).astype(np.int64)


class Topics:
    """The mean vectors of languages and the directions of topics."""

    def __init__(self, means: dict[str, np.ndarray], topics: int = TOPICS):
        self.means = means
        self.directions = np.random.default_rng(5).standard_normal((topics, DIMS))
        self.directions /= np.sqrt((self.directions**2).sum(1, keepdims=True))

    def residuals(self, x: np.ndarray, langs: list[str]) -> np.ndarray:
        total = x.sum(1, keepdims=True)
        share = x / np.where(total > 0, total, 1)
        rest = share - np.array([self.means.get(n, np.zeros(DIMS)) for n in langs]).reshape(-1, DIMS)
        return _whole(np.where(total > 0, rest, 0))

    def of(self, residuals: np.ndarray) -> np.ndarray:
        near = np.rint(residuals @ self.directions.T).argmax(1)  # whole numbers: a tie goes to the first
        return np.where(residuals.any(1), near, 0)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, DIMS).astype(np.float64)


def _facts(columns: tuple[str, str, str, str], targets: Mapping) -> list[Column]:
    """draw (0 to 1), _source and _lang, as the targets name them."""
    id_col, text_col, source_col, lang_col = (F.col(f"`{c}`") for c in columns)
    named = F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text_col, F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), named)), 1, 13), 16, 10).cast("double") / float(16**13)
    cell = [F.when(c.isin(*targets[d]), c).otherwise(F.lit(OTHER)).alias(f"_{d}") for d, c in (("source", source_col), ("lang", lang_col))]
    return [draw.alias("draw"), *cell]


def described(docs: DataFrame, targets: Mapping, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """id, source, lang, draw, _source, _lang, n_tokens, vector of every row, stored."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            got = [vector_and_size(x) for x in text_bytes(t.column("text"))]
            vectors = pa.array([np.minimum(x, 65535).astype(np.uint16).tobytes() for x, _ in got], pa.binary())
            yield from t.combine_chunks().drop_columns(["text"]).append_column("n_tokens", pa.array([n for _, n in got], pa.int64())).append_column("vector", vectors).to_batches()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), *_facts((id_col, text_col, source_col, lang_col), targets), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(run, f"id {kind}, source string, lang string, draw double, _source string, _lang string, n_tokens long, vector binary"), "mixing-rows")


def learn_topics(rows: DataFrame) -> Topics:
    """Clusters the vectors of described rows (all of them, in each round)."""

    def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vector"))
            total = x.sum(1, keepdims=True)
            whole = np.rint(x / np.where(total > 0, total, 1) * UNIT).astype(np.int64)
            names, at = np.unique(np.array(b.column("_lang").to_pylist(), object).astype(str), return_inverse=True)
            for k, name in enumerate(names):
                mine = (at == k) & (total[:, 0] > 0)
                yield pa.RecordBatch.from_arrays([pa.array([name] * DIMS), pa.array(range(DIMS), pa.int32()), pa.array(whole[mine].sum(0)), pa.array([int(mine.sum())] * DIMS, pa.int64())], names=["lang", "dim", "s", "n"])

    add = [F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")]
    sums = rows.select("_lang", "vector").mapInArrow(by_language, "lang string, dim int, s long, n long").groupBy("lang", "dim").agg(*add).collect()
    means: dict[str, np.ndarray] = {}
    for r in sums:
        means.setdefault(r.lang, np.zeros(DIMS))[r.dim] = float(r.s) / max(1, r.n) / UNIT
    topics = Topics(means)
    for _ in range(ROUNDS_OF_TOPICS):

        def by_topic(batches: Iterator[pa.RecordBatch], now: Topics = topics) -> Iterator[pa.RecordBatch]:
            for b in batches:
                r = now.residuals(_vectors(b.column("vector")), b.column("_lang").to_pylist())
                k = now.of(r)
                for j in np.unique(k):
                    yield pa.RecordBatch.from_arrays([pa.array([j] * DIMS, pa.int32()), pa.array(range(DIMS), pa.int32()), pa.array(r[k == j].sum(0))], names=["topic", "dim", "s"])

        got = rows.select("_lang", "vector").mapInArrow(by_topic, "topic int, dim int, s long").groupBy("topic", "dim").agg(add[0]).collect()
        after = Topics(means)
        after.directions = topics.directions.copy()
        total = np.zeros((TOPICS, DIMS))
        for r in got:
            total[r.topic, r.dim] = float(r.s)
        size = np.sqrt((total**2).sum(1))
        after.directions[size > 0] = total[size > 0] / size[size > 0][:, None]
        topics = after
    return topics


def _bounded(observed: np.ndarray, sides: list, fixed: np.ndarray, most: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weights min(most, product of a factor per value), and how far the marginals are from their shares; fixed: weights given beforehand, or nan."""
    free = np.isnan(fixed)
    w0 = np.where(free, 0.0, np.minimum(most, np.nan_to_num(fixed)))
    plan = []
    for index, share, scarce in sides:
        given = np.bincount(index, weights=observed * w0, minlength=len(share))
        left = np.where(scarce, 0.0, share)
        plan.append((index, np.where(scarce, given, left / left.sum() * (1 - given[scarce].sum())), given, np.ones(len(share))))
    product = free.astype(float)
    w = w0 + np.minimum(most, product)
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for index, share, given, _factor in plan:
            now = np.bincount(index, weights=observed * w, minlength=len(share))
            worst = max(worst, float(np.abs(now - share).max()))
            own = now - given
            # a weight at the bound may come down again, but a factor does not run away from it
            product = np.minimum(product, most * 2) * np.divide(np.maximum(share - given, 0.0), own, out=np.ones_like(share), where=own > 0)[index]
            w = w0 + np.minimum(most, product)
        if worst < 1e-12:
            break
    return w, worst


def rake(cells: Mapping[tuple[str, ...], float], targets: list[Mapping[str, float]], rounds: int = ROUNDS) -> tuple[dict[tuple[str, ...], float], float]:
    """The weight of each cell's tokens (target mass over observed mass, under the least bound that reaches the shares), and how far the furthest marginal is off."""
    keys = [k for k, v in cells.items() if v > 0]
    raked = [d for d, target in enumerate(targets) if sum(target.get(n, 0.0) for n in {k[d] for k in keys}) > 0]
    live = [k for k in keys if all(targets[d].get(k[d], 0.0) > 0 for d in raked)]
    if not live:
        return dict.fromkeys(keys, 0.0), 0.0
    observed = np.array([cells[k] for k in live], float)
    observed /= observed.sum()
    fixed = np.full(len(live), np.nan)
    sides = []
    for d in raked:
        names = sorted({k[d] for k in live})
        at = {n: i for i, n in enumerate(names)}
        index = np.array([at[k[d]] for k in live])
        share = np.array([targets[d][n] for n in names], float)
        share /= share.sum()
        has = np.bincount(index, weights=observed, minlength=len(names))
        scarce = share > SCARCE * has
        fixed = np.fmin(fixed, np.where(scarce, share / has, np.nan)[index])
        sides.append((index, share, scarce))
    high = SCARCE
    w, off = _bounded(observed, sides, fixed, high, rounds)
    while off > CLOSE and high < MOST_WEIGHT:
        high *= 2
        w, off = _bounded(observed, sides, fixed, high, rounds)
    if off <= CLOSE:
        low = 1.0
        for _ in range(HALVINGS):
            middle = math.sqrt(low * high)
            tried, gap = _bounded(observed, sides, fixed, middle, rounds)
            if gap <= CLOSE:
                w, high, off = tried, middle, gap
            else:
                low = middle
    return dict.fromkeys(keys, 0.0) | dict(zip(live, w.tolist(), strict=True)), off


def _learnt(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], columns: tuple[str, str, str, str], most_gap: float | None) -> tuple[DataFrame, Topics, dict, float]:
    """The described rows, the topics, each cell's (weight, probability), and the gap to the targets."""
    size = np.prod([len(targets[d]) + 1 for d in DIMENSIONS])
    if size > MOST_CELLS:
        raise ValueError(f"the targets span {size} cells; {MOST_CELLS} at most")
    rows = described(docs, targets, *columns)
    topics = learn_topics(rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = topics.of(topics.residuals(_vectors(b.column("vector")), b.column("_lang").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("_source"), b.column("_lang"), pa.array([_topic(k, targets) for k in topic.tolist()], pa.string()), b.column("n_tokens")], names=["source", "lang", "topic", "n"])

    cells = rows.select("_source", "_lang", "vector", "n_tokens").mapInArrow(sums, "source string, lang string, topic string, n long").groupBy(*DIMENSIONS).agg(F.sum("n").alias("n")).collect()
    weights, gap = rake({tuple(r[:3]): float(r.n) for r in cells}, [targets[d] for d in DIMENSIONS])
    if most_gap is not None and gap > most_gap:
        raise ValueError(f"the targets are not reached: a marginal share is off by {gap:.3g}")
    most = max(weights.values(), default=0.0) or 1.0
    return rows, topics, {k: (w, w / most) for k, w in weights.items()}, gap


def _topic(k: int, targets: Mapping) -> str:
    return str(k) if str(k) in targets["topic"] else OTHER


def weighted(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", most_gap: float | None = None) -> DataFrame:
    """id, source, lang, topic, n_tokens, weight, probability, selected, target_gap; targets: of `source`, `lang` and `topic`."""
    rows, topics, weights, gap = _learnt(docs, targets, (id_col, text_col, source_col, lang_col), most_gap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("_lang").to_pylist()
            topic = topics.of(topics.residuals(_vectors(b.column("vector")), langs)).tolist()
            got = [weights.get((s, n, _topic(k, targets)), (0.0, 0.0)) for s, n, k in zip(b.column("_source").to_pylist(), langs, topic, strict=True)]
            p = np.array([x[1] for x in got])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), b.column("lang"), pa.array([str(k) for k in topic], pa.string()), b.column("n_tokens"), pa.array([x[0] for x in got], pa.float64()), pa.array(p), pa.array(b.column("draw").to_numpy() < p)], names=["id", "source", "lang", "topic", "n_tokens", "weight", "probability", "selected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, source string, lang string, topic string, n_tokens long, weight double, probability double, selected boolean")
    return out.withColumn("target_gap", F.lit(gap)).withColumnRenamed("id", id_col)


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", most_gap: float | None = None) -> DataFrame:
    """The rows that are selected, whole; each row is drawn by its own cell."""
    columns = (id_col, text_col, source_col, lang_col)
    _, topics, weights, _ = _learnt(docs, targets, columns, most_gap)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            vectors = np.array([vector_and_size(x)[0] for x in text_bytes(t.column("text"))], np.float64).reshape(-1, DIMS)
            langs = t.column("_lang").to_pylist()
            topic = topics.of(topics.residuals(np.minimum(vectors, 65535), langs)).tolist()
            p = np.array([weights.get((s, n, _topic(k, targets)), (0.0, 0.0))[1] for s, n, k in zip(t.column("_source").to_pylist(), langs, topic, strict=True)])
            yield from t.select(["rest", "text"]).filter(pa.array(t.column("draw").to_numpy() < p)).combine_chunks().to_batches()

    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).cast("struct<_:int>").alias("rest"), *_facts(columns, targets), F.col(f"`{text_col}`").alias("text"))
    kind = one.schema["rest"].dataType
    drawn = one.mapInArrow(run, T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType())]))
    return drawn.select(*[F.col("text").alias(text_col) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])

"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE words, all of them, the last one shorter. A passage is encoded
as the mean of hashed embeddings of its words, word endings and repetitions, then a tanh layer; gated attention,
softmax(w . (tanh(V h) * sigmoid(U h))), weighs the passages, and the weighted representation is scored.
Only document labels are used, and only texts go into a score.

Training is numpy with Adagrad on the executors, on all labelled rows, in rounds: partitions learn on from common
parameters, which are averaged (averaging.py). Scoring reads every whole text on the
executors. Null and empty texts are one passage of one empty word. Rows without labels, or labels of one
class only, give the base rate (0.5 without any). Repeated ids take their smallest label in training;
every row is scored. A very long text is one bag, encoded in blocks of words. Other columns pass by untouched; one
named as the score is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.averaging import averaged_round, training_rows
from graphloom.llm.common import chunks, forget, small_batches, text_bytes, written

WORDS = 1 << 15
ENDINGS = 1 << 12
WIDTH = 16
HIDDEN = 16
GATES = 8
PASSAGE = 48
#: Features that training_sample brings to the driver, of all rows together.
TRAIN_BYTES = 192 << 20
#: Epochs over a chunk of texts, by round.
EPOCHS = (3, 3)
RATE = 0.05
BATCH = 32
CHUNK = 4 << 20
WORDS_AT_ONCE = 1 << 16


def encode(text: bytes) -> np.ndarray:
    """Three feature ids a word: the word's, its ending's, and whether it repeats the word before."""
    words = text.split() or [b""]
    out = np.empty((len(words), 3), np.int32)
    full = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    out[:, 0] = full & (WORDS - 1)
    out[:, 1] = (np.fromiter(map(zlib.crc32, [w[-2:] for w in words]), np.uint32, len(words)) & (ENDINGS - 1)) + WORDS
    out[:, 2] = WORDS + ENDINGS
    out[1:, 2] += full[1:] == full[:-1]
    return out


def bags(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each passage, and first passage of each document."""
    count = -(-lengths // PASSAGE)
    docs = np.r_[0, np.cumsum(count)[:-1]]
    within = np.arange(count.sum()) - np.repeat(docs, count)
    return np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], count) + within * PASSAGE, docs


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def new_model(rate: float, seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
    return {"e": (r.standard_normal((WORDS + ENDINGS + 2, WIDTH)) * 0.05).astype(np.float32), "w": f(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN, GATES), "u": f(HIDDEN, GATES), "a": f(GATES), "c": f(HIDDEN), "c0": np.array(np.log(rate / (1 - rate)), np.float32)}


def forward(m: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of documents whose words are laid end to end."""
    starts, docs = bags(lengths)
    size = np.diff(np.r_[starts, len(ids)])[:, None].astype(np.float32)
    again = np.add.reduceat(ids[:, 2] - (WORDS + ENDINGS), starts)[:, None].astype(np.float32)
    words = np.add.reduceat(m["e"].take(ids[:, 0], axis=0) + m["e"].take(ids[:, 1], axis=0), starts, axis=0)
    x = (words + (size - again) * m["e"][WORDS + ENDINGS] + again * m["e"][WORDS + ENDINGS + 1]) / size
    h = np.tanh(x @ m["w"] + m["b"])
    tv, su = np.tanh(h @ m["v"]), _sigmoid(h @ m["u"])
    s = (tv * su) @ m["a"]
    per = np.diff(np.r_[docs, len(s)])
    p = np.exp(s - np.repeat(np.maximum.reduceat(s, docs), per))
    p /= np.repeat(np.add.reduceat(p, docs), per)
    z = np.add.reduceat(p[:, None] * h, docs, axis=0)
    return z @ m["c"] + m["c0"], (starts, docs, size, again, x, h, tv, su, p, per, z)


def _sums(ids: np.ndarray, passage: np.ndarray, dp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The embeddings that words and endings name, in order, and their gradients' sums; dp has the gradient of a word of each passage."""
    flat = ids[:, :2].T.ravel()
    named = np.zeros(WORDS + ENDINGS, bool)
    named[flat] = True
    rows = np.flatnonzero(named)
    # short integers, so that numpy sorts by radix; a row's words stay in order
    short = (np.cumsum(named, dtype=np.uint16) - 1)[flat]
    order = np.argsort(short, kind="stable")
    first = np.searchsorted(short[order], np.arange(len(rows), dtype=np.uint16))
    return rows, np.add.reduceat(dp.take(np.r_[passage, passage][order], axis=0), first, axis=0)


def row_gradients(m: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients, those of the embeddings only for the rows that the words name (and the two of repetitions), and these rows."""
    logit, (starts, docs, size, again, x, h, tv, su, p, per, z) = forward(m, ids, lengths)
    g = (_sigmoid(logit) - y).astype(np.float32) / len(y)
    out = {"c": z.T @ g, "c0": g.sum()}
    dz = np.repeat(g[:, None] * m["c"], per, axis=0)
    dp = (dz * h).sum(1)
    ds = p * (dp - np.repeat(np.add.reduceat(p * dp, docs), per))
    out["a"] = (tv * su).T @ ds
    dt, du = ds[:, None] * m["a"] * su * (1 - tv * tv), ds[:, None] * m["a"] * tv * su * (1 - su)
    out["v"], out["u"] = h.T @ dt, h.T @ du
    dh = (dz * p[:, None] + dt @ m["v"].T + du @ m["u"].T) * (1 - h * h)
    out["w"], out["b"] = x.T @ dh, dh.sum(0)
    dx = (dh @ m["w"].T) / size
    rows, de = _sums(ids, np.repeat(np.arange(len(starts)), size[:, 0].astype(int)), dx)
    repeats = np.stack([((size - again) * dx).sum(0), (again * dx).sum(0)])
    return out | {"e": np.concatenate([de, repeats])}, np.r_[rows, WORDS + ENDINGS, WORDS + ENDINGS + 1]


def gradients(m: dict[str, np.ndarray], ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    out, rows = row_gradients(m, ids, lengths, y)
    de = np.zeros_like(m["e"])
    de[rows] = out["e"]
    return out | {"e": de}


def learn(m: dict[str, np.ndarray], seen: dict[str, np.ndarray], bags_of_ids: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int) -> None:
    """Adagrad; m and seen (the sums of squares) change in place."""
    r = np.random.default_rng(seed)
    for _ in range(epochs):
        order = r.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            ids = np.concatenate([bags_of_ids[i] for i in part])
            found, rows = row_gradients(m, ids, np.array([len(bags_of_ids[i]) for i in part]), labels[part])
            for name, g in found.items():
                if name == "e":
                    squares = seen[name][rows] + g**2
                    seen[name][rows] = squares
                    m[name][rows] -= RATE * g / np.sqrt(squares)
                else:
                    seen[name] += g * g
                    m[name] -= RATE * g / np.sqrt(seen[name])


def learner(epochs: int, seed: int):
    return lambda m, seen, texts, labels, done: learn(m, seen, [encode(x) for x in texts], labels, epochs, seed + done)


def scores(m: dict[str, np.ndarray], texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts, WORDS_AT_ONCE words (or one text) at a time."""
    out, held, n = [], [], 0
    for x in texts:
        held.append(encode(x))
        n += len(held[-1])
        if n >= WORDS_AT_ONCE:
            out.append(forward(m, np.concatenate(held), np.array([len(b) for b in held]))[0])
            held, n = [], 0
    if held:
        out.append(forward(m, np.concatenate(held), np.array([len(b) for b in held]))[0])
    return _sigmoid(np.concatenate(out).astype(np.float64)) if out else np.empty(0)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column, limit: int, encoder) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(features, labels, hashes) of at most limit labelled ids and TRAIN_BYTES of features; the features are encoder's int32 arrays.

    For a caller who wants a few rows on the driver; the models here learn from all of them.

    An id that is on several rows counts once, with the least of its features: rows are encoded where they lie, and only one for each id is
    sent on. The features wait in the shared folder; their sizes decide how many of them, in the order of the hashes, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([encoder(x).astype(np.int32).tobytes() for x in text_bytes(b.column("text"))], pa.binary()), b.column("label"), b.column("draw")], names=["id", "ids", "label", "draw"])

    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    few = marks.select(F.col("id").cast("string").alias("id"), "label", F.xxhash64(F.lit(11), "id").alias("draw")).orderBy("draw", "id").limit(limit)
    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id").select("id", "text", "label", "draw")
    once = picked.mapInArrow(run, "id string, ids binary, label int, draw long").groupBy("id", "label", "draw").agg(F.min("ids").alias("ids"))
    held = written(once, "training-sample")
    sizes = np.array([tuple(r) for r in held.select("draw", F.octet_length("ids").cast("long")).collect()] or [(0, 0)], np.int64)  # a row for each id: limit at most
    sizes = sizes[np.argsort(sizes[:, 0], kind="stable")]
    fits = int(np.searchsorted(np.cumsum(sizes[:, 1]), TRAIN_BYTES, side="right"))
    last = sizes[max(fits, 1) - 1, 0]
    got = held.where(F.col("draw") <= int(last)).select("ids", "label", "draw").toArrow().sort_by([("draw", "ascending"), ("ids", "ascending")])
    forget(held)
    return [np.frombuffer(x, np.int32) for x in got.column("ids").to_pylist()], got.column("label").to_numpy().astype(np.float32), got.column("draw").to_numpy()


def quality_model(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> dict[str, np.ndarray]:
    """The model learnt from all labelled rows for which usable (a condition on the id) holds."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, usable)
    count, rate, both = rows.agg(F.count(F.lit(1)), F.avg("label"), F.min("label") < F.max("label")).first()
    m = new_model(float(np.clip(rate if count else 0.5, 0.01, 0.99)), seed)
    if not both:
        m["c"][:] = 0
        if not count:
            m["c0"][...] = 0
    else:
        seen = {k: np.full_like(v, 1e-6) for k, v in m.items()}
        for k, epochs in enumerate(EPOCHS):
            m, seen = averaged_round(rows, count, m, seen, learner(epochs, seed + k))
    forget(rows)
    return m


def scored(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs and a column of scores, which takes the place of one of that name."""
    docs = docs.drop(out)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, text_col, CHUNK):
            t = t.combine_chunks()
            s = scores(shared.value, text_bytes(t.column(text_col)))
            yield from t.append_column(out, pa.array(s)).to_batches()

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))

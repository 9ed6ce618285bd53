"""Toxicity: a convolutional text classifier in numpy.

Words (A-Z lower-cased, ASCII punctuation parts them) are hashed to embeddings, each the sum of the word's and
of its first bytes', which stand for a stem that takes many endings; filters of widths 1 to 3
run over the whole text, each keeps its maximum, and the maxima are scored. The first coordinate of an
embedding starts as its smoothed log-odds in the training rows; everything is then trained with
Adagrad. Thresholds are calibrated by language on training rows that the gradients never saw; the
language is told from the text alone, by its function words. A threshold shifts the logit, so that a
score of 0.5 is the threshold of the text's language.

Training is done on the executors, on all labelled rows: log-odds are counted over all that the gradients see, partitions learn on from
common parameters, which are averaged (averaging.py), and thresholds come from all rows that are left for calibration: their logits
are counted in steps of 1/1024 between -32 and 32, and a threshold lies midway between two steps' rows. An id on several rows counts once.
Every whole text is scored. Null and empty texts get the score of no words. Without labels, or with one
class only, the score is the base rate (0 without any). A very long text is convolved whole in its task, with
some 300 bytes a word. Columns besides the id and the text are not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.averaging import averaged_round, training_rows
from graphloom.llm.common import chunks, forget, small_batches, text_bytes

VOCABULARY = 1 << 18
STEMS = 1 << 16
#: Bytes of a word that stand for its stem.
STEM = 4
WIDTH = 8
FILTERS = 12
WIDTHS = (1, 2, 3)
#: Epochs over a chunk of texts, by round.
EPOCHS = (3, 2)
RATE = 0.05
BATCH = 32
CHUNK = 4 << 20
#: Steps in one of a logit, and logits that are told apart at most.
STEPS, MOST = 1024, 32
#: Rows of a language that must be left for calibration, of each class.
LEAST = 15
#: Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that it for was with as this by are from be",
    "de": "der die und das den von zu ist mit des ein eine auf nicht",
    "fr": "le les des et un une est dans pour que qui du sur pas",
    "es": "el los las y del por con una es se para al",
}
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
PAD = VOCABULARY + STEMS


def encode(text: bytes) -> np.ndarray:
    """Two ids a word: the word's and its stem's."""
    words = text.lower().translate(_PUNCTUATION).split()
    out = np.empty((len(words), 2), np.int32)
    out[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (VOCABULARY - 1)
    out[:, 1] = (np.fromiter(map(zlib.crc32, [w[:STEM] for w in words]), np.uint32, len(words)) & (STEMS - 1)) + VOCABULARY
    return out


def _language_table() -> np.ndarray:
    """Language number (from 1) of each hashed word; words of two languages tell nothing."""
    table = np.zeros(PAD + 1, np.uint8)
    every = [w for x in FUNCTION_WORDS.values() for w in x.split()]
    for k, x in enumerate(FUNCTION_WORDS.values(), 1):
        for w in x.split():
            if every.count(w) == 1:
                table[encode(w.encode())[:, 0]] = k
    return table


_LANGUAGE = _language_table()


def _laid(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, each text followed by pads; where texts start; which words are pads of the end."""
    pads = max(WIDTHS)
    ids = np.concatenate([np.concatenate([d, np.full((pads, 2), PAD, np.int32)]) for d in docs])
    lengths = np.array([len(d) for d in docs])
    starts = np.r_[0, np.cumsum(lengths + pads)[:-1]]
    end = np.zeros(len(ids), bool)
    for j in range(1, pads):
        end[starts + lengths + j] = True  # a window may start on the first pad, so that no text is without windows
    return ids, starts, end


def languages(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    k = _LANGUAGE[ids[:, 0]]
    counts = np.stack([np.add.reduceat((k == j).astype(np.int32), starts) for j in range(len(FUNCTION_WORDS) + 1)], 1)
    counts[:, 0] = 0
    return counts.argmax(1)


def _windows(m: dict, x: np.ndarray, width: int, end: np.ndarray) -> np.ndarray:
    w = m[f"w{width}"]
    z = x @ w[0]
    for j in range(1, width):
        z[:-j] += x[j:] @ w[j]
    z[end] = -1e9
    return z


def logits(m: dict, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, starts, end = _laid(docs)
    x = m["e"][ids[:, 0]] + m["e"][ids[:, 1]]
    top = np.concatenate([np.maximum.reduceat(_windows(m, x, k, end), starts, axis=0) + m[f"b{k}"] for k in WIDTHS], 1)
    return np.maximum(top, 0) @ m["o"] + m["o0"], languages(ids, starts)


def _step(m: dict, seen: dict, name: str, g: np.ndarray, rows=...) -> None:
    seen[name][rows] += g * g
    m[name][rows] -= RATE * g / np.sqrt(seen[name][rows])


def _learn(m: dict, seen: dict, docs: list[np.ndarray], y: np.ndarray) -> None:
    ids, starts, end = _laid(docs)
    ends = np.r_[starts[1:], len(ids)]
    x = m["e"][ids[:, 0]] + m["e"][ids[:, 1]]
    tops, at = [], []
    for k in WIDTHS:
        z = _windows(m, x, k, end)
        best = np.stack([s + z[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
        at.append(best)
        tops.append(np.take_along_axis(z, best, 0) + m[f"b{k}"])
    top = np.concatenate(tops, 1)
    on = np.maximum(top, 0)
    g = ((0.5 * np.tanh(0.5 * (on @ m["o"] + m["o0"])) + 0.5) - y).astype(np.float32) / len(y)
    d = g[:, None] * m["o"] * (top > 0)
    _step(m, seen, "o", on.T @ g)
    _step(m, seen, "o0", g.sum())
    de = np.zeros_like(x)
    for n, k in enumerate(WIDTHS):
        dk = d[:, n * FILTERS : (n + 1) * FILTERS]
        dw = np.zeros_like(m[f"w{k}"])
        for j in range(k):
            p = np.minimum(at[n] + j, len(ids) - 1)
            dw[j] = np.einsum("df,dfe->ef", dk, x[p])
            np.add.at(de, p, dk[:, :, None] * m[f"w{k}"][j].T[None])
        _step(m, seen, f"w{k}", dw)
        _step(m, seen, f"b{k}", dk.sum(0))
    touched = np.flatnonzero(np.any(de, axis=1))
    rows, back = np.unique(ids[touched], return_inverse=True)
    back = back.reshape(-1, 2)
    g = np.zeros((len(rows), WIDTH), np.float32)
    for k in (0, 1):
        np.add.at(g, back[:, k], de[touched])
    g[rows == PAD] = 0
    _step(m, seen, "e", g, rows)


def bins(logit: np.ndarray, y: np.ndarray, lang: np.ndarray) -> pa.Table:
    """lang, bin, n, hits, low, high: the logits by language in steps, with the least and the greatest of each."""
    logit = logit.astype(np.float64)
    t = pa.table({"lang": lang.astype(np.int32), "bin": np.floor(np.clip(logit, -MOST, MOST) * STEPS).astype(np.int32), "hit": y.astype(np.int64), "logit": logit})
    out = t.group_by(["lang", "bin"]).aggregate([("hit", "count"), ("hit", "sum"), ("logit", "min"), ("logit", "max")])
    return out.select(["lang", "bin", "hit_count", "hit_sum", "logit_min", "logit_max"]).rename_columns(["lang", "bin", "n", "hits", "low", "high"])


def _best_threshold(b: dict[str, np.ndarray]) -> float:
    """The logit, midway between two rows of different bins, that gives the most of F1."""
    order = np.lexsort((-b["low"], -b["bin"]))
    new = np.flatnonzero(np.diff(b["bin"][order], prepend=MOST * STEPS + 1))  # a bin may come from several languages
    n, hits = (np.cumsum(np.add.reduceat(b[k][order], new)) for k in ("n", "hits"))
    low, high = np.minimum.reduceat(b["low"][order], new), np.maximum.reduceat(b["high"][order], new)
    k = int((2 * hits / (n + hits[-1])).argmax())
    return float((low[k] + high[k + 1]) / 2 if k + 1 < len(low) else low[k] - 1)


def set_thresholds(m: dict, held: pa.Table) -> None:
    """Thresholds from the bins of all rows left for calibration: by language where it has LEAST of each class, else the common one."""
    b = {k: held.column(k).to_numpy() for k in held.column_names}
    if not len(b["n"]) or not 0 < b["hits"].sum() < b["n"].sum():
        return
    m["threshold"][:] = _best_threshold(b)
    for j in range(len(m["threshold"])):
        own = {k: x[b["lang"] == j] for k, x in b.items()}
        if min(own["hits"].sum(), (own["n"] - own["hits"]).sum()) >= LEAST:
            m["threshold"][j] = _best_threshold(own)


def new_model(rate: float, seed: int = 3) -> dict:
    r = np.random.default_rng(seed)
    m = {"e": (r.standard_normal((PAD + 1, WIDTH)) * 0.1).astype(np.float32), "o": (np.abs(r.standard_normal(FILTERS * len(WIDTHS))) * 0.3).astype(np.float32), "threshold": np.zeros(len(FUNCTION_WORDS) + 1)}
    rate = float(np.clip(rate, 0.001, 0.999))
    m["o0"] = np.array(np.log(rate / (1 - rate)), np.float32)
    for k in WIDTHS:
        m[f"w{k}"] = (r.standard_normal((k, WIDTH, FILTERS)) * 0.3).astype(np.float32)
        m[f"w{k}"][:, 0] = np.abs(m[f"w{k}"][:, 0])
        m[f"b{k}"] = np.full(FILTERS, -0.5, np.float32)
    return m


def feature_counts(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Of each class, how many texts hold each feature."""
    return np.stack([np.bincount(np.concatenate([np.empty(0, np.int32), *[np.unique(d) for d, t in zip(docs, y, strict=True) if t == k]]), minlength=PAD + 1) for k in (0, 1)])


def set_odds(m: dict, held: np.ndarray, texts: np.ndarray) -> dict:
    """The first coordinate of every embedding becomes its smoothed log-odds; the sums of squares for training."""
    odds = np.log((held[1] + 0.5) / (texts[1] + 1)) - np.log((held[0] + 0.5) / (texts[0] + 1))
    m["e"][:, 0] = np.where(held[0] + held[1] >= 3, np.clip(odds, -3, 3), 0)
    m["e"][PAD] = 0
    return {k: np.full_like(v, 1e-4 if k == "e" else 1e-6) for k, v in m.items()}


def learn(m: dict, seen: dict, docs: list[np.ndarray], y: np.ndarray, epochs: int, r: np.random.Generator) -> None:
    for _ in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            _learn(m, seen, [docs[i] for i in part], y[part])


def train(docs: list[np.ndarray], y: np.ndarray, epochs: int = sum(EPOCHS), seed: int = 3) -> dict:
    """A model of texts that are at hand; every fifth is left for calibration."""
    m = new_model(y.mean() if len(y) else 0, seed)
    if len(set(y.tolist())) < 2:
        m["o"][:] = 0
        return m
    of = np.arange(len(y)) % 5 != 4
    some = [d for d, u in zip(docs, of, strict=True) if u]
    seen = set_odds(m, feature_counts(some, y[of]), np.array([(y[of] == k).sum() for k in (0, 1)]))
    learn(m, seen, some, y[of], epochs, np.random.default_rng(seed))
    rest = np.flatnonzero(~of)
    got = [(*logits(m, [docs[i] for i in rest[k : k + 256]]), y[rest[k : k + 256]]) for k in range(0, len(rest), 256)]
    if got:
        s, lang, t = (np.concatenate(x) for x in zip(*got, strict=True))
        set_thresholds(m, bins(s, t, lang))
    return m


def scores(m: dict, texts: list[bytes]) -> np.ndarray:
    s, lang = logits(m, [encode(x) for x in texts])
    return 0.5 * np.tanh(0.5 * (s.astype(np.float64) - m["threshold"][lang])) + 0.5


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each feature, by class; feature -1 counts the texts."""
    total, texts = np.zeros((2, PAD + 1), np.int64), np.zeros(2, np.int64)
    for t in chunks(batches, "text", CHUNK):
        y = t.column("label").to_numpy()
        total += feature_counts([encode(x) for x in text_bytes(t.column("text"))], y)
        texts += [(y == 0).sum(), (y == 1).sum()]
    for k in (0, 1):
        at = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.r_[texts[k], total[k][at]])], names=["feature", "label", "n"])


def _binned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            s, lang = logits(shared.value, [encode(x) for x in text_bytes(t.column("text"))])
            yield from bins(s, t.column("label").to_numpy(), lang).to_batches()

    return run


def toxicity_model(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 3) -> dict:
    """The model learnt from all labelled rows for which usable (a condition on the id) holds; a fifth of them, by a hash, calibrates it."""
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, id_col, text_col, label_col, usable)
    count, rate, both = rows.agg(F.count(F.lit(1)), F.avg("label"), F.min("label") < F.max("label")).first()
    m = new_model(rate if count else 0, seed)
    if not both:
        m["o"][:] = 0
        forget(rows)
        return m
    left = F.pmod("draw", F.lit(5)) == 4
    some = rows.where(~left)
    got = some.select("text", "label").mapInArrow(_counted, "feature int, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).toArrow()  # two rows a feature at most
    counts = np.zeros((2, PAD + 2), np.int64)
    counts[got.column("label").to_numpy(), got.column("feature").to_numpy()] = got.column("n").to_numpy()  # -1 is the last place
    seen = set_odds(m, counts[:, :-1], counts[:, -1])
    n = int(counts[:, -1].sum())
    for k, epochs in enumerate(EPOCHS):
        m, seen = averaged_round(some, n, m, seen, lambda m, seen, texts, y, done, k=k, epochs=epochs: learn(m, seen, [encode(x) for x in texts], y, epochs, np.random.default_rng([seed, k, done])))
    shared = docs.sparkSession.sparkContext.broadcast(m)
    held = rows.where(left).select("text", "label").mapInArrow(_binned(shared), "lang int, bin int, n long, hits long, low double, high double")
    set_thresholds(m, held.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow())  # a row for each step of a logit and language at most
    forget(rows)
    return m


def scored(rows: DataFrame, model: dict) -> DataFrame:
    """rows (id, text) as id, score."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            t = t.combine_chunks()
            yield from pa.table({"id": t.column("id"), "score": scores(shared.value, text_bytes(t.column("text")))}).to_batches()

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, "id long, score double")

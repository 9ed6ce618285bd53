"""Document log-likelihood under a gated recurrent language model with a class-factored softmax.

Tokens: A-Z lower-cased words (runs of anything but ASCII white space), then one end. A word is known by 59
bits of its hash and the 5-bit class of its ending. One scan stores the keys of every text, whole; the
vocabulary is counted from those of the training texts by a grouping with map-side sums. These tables grow
with the input and stay on the executors; to the driver come the words counted so often that there are at
most HEAD of them, a histogram of counts, sums per class, and the model.

The model predicts a class, then the word in its class. The MODEL_WORDS commonest words lie in CLASSES
classes of like mass and are told apart by a softmax within the class; every other word, known or not,
lies in one of TAIL classes by its ending and has there the probability (count + 1) / (N + V + 1). The
biases start at the corpus's unigram probabilities.

Training uses every token of every training text once, its end included: the texts are dealt by a hash over
ROUNDS rounds. In a round each partition deals its texts over lanes, end to end, and trains by truncated
backpropagation: windows of WINDOW steps or more, the state carried from window to window of a text and zero
at a text's start. After a round the parameters of all partitions are averaged by tokens, in a tree. Scoring
carries the state through the whole text. Gates and candidates use x / (1 + |x|) for the hyperbolic tangent.

Null texts are empty: one token, the end. Rows are told apart by place, so repeated and null ids get a
row each. A very long text is one lane: its tokens, 8 bytes each, are held at once, and its steps follow one
another. Columns besides the id and the text are not read, so their names cannot clash. With no training
text every word is unknown and N is 0. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, small_batches, text_bytes, written

MODEL_WORDS = 2048
HEAD = 1 << 18
CLASSES = 32
TAIL = 16
HIDDEN = 16
WINDOW = 32
ROUNDS = 2
LANES = 512
#: Tokens of a step of training and of scoring: windows grow longer when few lanes are left.
STEP_TOKENS, SCORE_TOKENS = LANES * WINDOW, LANES * 64
LONGEST_WINDOW = 256
#: Tokens dealt over the lanes at once.
GROUP_TOKENS = 1 << 22
LOOK_TOKENS = 1 << 19
RATE = 0.1
CHUNK = 16 << 20
#: Rows whose logits are held at once, so that they stay in the cache.
ROWS = 1024
#: Models added by one task.
FAN = 32
PARTS = 16
#: Exponents of two that a count can have, and steps in each that the histogram tells apart.
STEPS = 64
#: The end of a text; no word holds a space.
END = b" end"
_LOW = np.uint64(31)
PREFIX = 20
_SHIFT = np.uint64(64 - PREFIX)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def token_keys(text: bytes) -> np.ndarray:
    """A key for each token: 59 bits of its hash, and in the lowest 5 the class of the word's ending."""
    text = text.lower()
    words = text.split()
    words.append(END)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    h &= ~_LOW
    # the last two bytes of each word; a space before a word of one byte
    b = np.frombuffer(b" " + text + b" ", np.uint8)
    space = _SPACE[b]
    last = np.flatnonzero(space[1:] & ~space[:-1])
    before = np.where(space[last - 1], 32, b[last - 1]).astype(np.uint64) if len(last) else last.astype(np.uint64)
    h[:-1] |= (before * np.uint64(131) + b[last] * np.uint64(7) + (before >> np.uint64(3))) & _LOW
    return h


def tail_class(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(TAIL - 1)).astype(np.int32)


# --- the texts' tokens and the vocabulary


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, "text", CHUNK // 4):
        keys = [token_keys(x).tobytes() for x in text_bytes(t.column("text"))]
        yield from t.drop_columns(["text"]).append_column("keys", pa.array(keys, pa.binary())).combine_chunks().to_batches()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, "keys", CHUNK):
        u, c = np.unique(np.concatenate(_arrays(t)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["key", "c"])


def _arrays(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t.column("keys").to_pylist()]


class Vocabulary:
    """The commonest words (sorted by key) and the classes; n_tail and v_tail: tokens and distinct words by ending."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_tail: np.ndarray, v_tail: np.ndarray):
        order = np.lexsort((keys, -counts))
        words = order[:MODEL_WORDS]
        self.size = len(words)
        mass = np.cumsum(np.sqrt(counts[words]))
        cut = np.minimum((mass / (mass[-1] if len(mass) else 1) * CLASSES).astype(np.int64), CLASSES - 1)
        self.class_start = np.searchsorted(cut, np.arange(CLASSES + 1))
        tail = tail_class(keys[words])
        self.n_tail = n_tail - np.bincount(tail, weights=counts[words], minlength=TAIL).astype(np.int64)
        self.v_tail = v_tail - np.bincount(tail, minlength=TAIL)
        self.word_counts = counts[words].astype(np.float64)
        #: The class of each token number: words of the model, then tail classes.
        self.class_of = np.r_[cut, CLASSES + np.arange(TAIL)].astype(np.int32)
        by_key = np.argsort(keys)
        self.keys, self.counts = keys[by_key], counts[by_key]
        number = np.full(len(keys), -1, np.int32)
        number[words] = np.arange(len(words))
        self.number = number[by_key]
        # where the keys with the same leading bits start
        self.start = np.searchsorted(self.keys >> _SHIFT, np.arange((1 << PREFIX) + 1, dtype=np.uint64)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))
        self.tokens, self.types = int(n_tail.sum()), int(v_tail.sum())
        self.tail_log = np.log10(self.n_tail + self.v_tail + 1.0)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each token (words of the model, then tail classes), and its count (-1: not in the head)."""
        u, back = np.unique(keys, return_inverse=True)
        number, count = self._look(u)
        return number[back], count[back]

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return tail_class(keys), np.full(len(keys), -1, np.int64)
        prefix = (keys >> _SHIFT).astype(np.int32)
        at = np.minimum(self.start[prefix], len(self.keys) - 1)
        hit = self.keys[at] == keys
        left = np.flatnonzero(~hit)
        for _ in range(1, self.longest):
            left = left[at[left] + 1 < self.start[prefix[left] + 1]]
            if not len(left):
                break
            at[left] += 1
            now = self.keys[at[left]] == keys[left]
            hit[left[now]] = True
            left = left[~now]
        number = np.where(hit, self.number[at], -1)
        return np.where(number >= 0, number, self.size + tail_class(keys)).astype(np.int32), np.where(hit, self.counts[at], -1)


# --- the model


def new_model(v: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    """e: what a token adds to the gates (the last column starts a text); wh: what the state adds; c, o: classes and words, the bias last."""
    r = np.random.default_rng(seed)
    f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
    total = v.tokens + v.types + 1.0
    mass = np.r_[[v.word_counts[a:b].sum() + 1e-3 for a, b in zip(v.class_start, v.class_start[1:], strict=False)], v.n_tail + v.v_tail + 1.0]
    c, o = f(HIDDEN + 1, CLASSES + TAIL, scale=0.01), f(v.size, HIDDEN + 1, scale=0.01)
    c[-1], o[:, -1] = np.log(mass / total), np.log(np.maximum(v.word_counts, 1e-3))
    for a, b in zip(v.class_start, v.class_start[1:], strict=False):
        if b > a:
            o[a:b, -1] -= o[a:b, -1].max()
    return {"e": f(3 * HIDDEN, v.size + TAIL + 1, scale=0.3), "wh": f(3 * HIDDEN, HIDDEN, scale=0.2), "c": c, "o": o}


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += np.float32(1)
    x /= d
    return x


class Lanes:
    """Texts (arrays of numbers) dealt over lanes, end to end; the longest lane first.

    y: the tokens, lane after lane; x: the token before each (start: before a text's first); first: where texts start.
    """

    def __init__(self, texts: list[np.ndarray], start: int, most: int = LANES):
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        heap = [(0, i, []) for i in range(min(most, len(texts)))]
        for k in order:
            n, i, held = heap[0]
            held.append(k)
            heapq.heapreplace(heap, (n + len(texts[k]), i, held))
        dealt = [held for _, _, held in sorted(heap, key=lambda x: (-x[0], x[1]))]
        self.order = [k for held in dealt for k in held]
        length = np.array([len(texts[k]) for k in self.order])
        self.first = np.cumsum(length) - length
        self.size = np.array([sum(len(texts[k]) for k in held) for held in dealt])
        self.offset = np.cumsum(self.size) - self.size
        self.y = np.concatenate([texts[k] for k in self.order])
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[self.first] = start
        lane = np.searchsorted(self.offset, self.first, side="right") - 1
        step = self.first - self.offset[lane]
        by = np.lexsort((lane, step))
        self._lane, self._step = lane[by], step[by]

    def windows(self, tokens: int = STEP_TOKENS) -> Iterator[tuple[np.ndarray, np.ndarray | None, list[np.ndarray]]]:
        """(places, live, fresh): places in y by step and lane, which of them are tokens (None: all), and by step the lanes that start a text."""
        t = 0
        while t < self.size[0]:
            k = int(np.searchsorted(-self.size, -t, side="left"))  # the lanes that have a token t
            n = min(max(WINDOW, min(LONGEST_WINDOW, tokens // k)), int(self.size[0]) - t)
            steps = np.arange(t, t + n)
            places = self.offset[:k] + steps[:, None]
            live = None
            if self.size[k - 1] < t + n:
                live = steps[:, None] < self.size[:k]
                places = np.minimum(places, len(self.y) - 1)
            a, b = np.searchsorted(self._step, (t, t + n))
            cuts = np.searchsorted(self._step[a:b], steps) + a
            fresh = [self._lane[i:j] for i, j in zip(cuts, [*cuts[1:], b], strict=True)]
            yield places, live, fresh
            t += n


def run_window(m: dict, x: np.ndarray, fresh: list[np.ndarray], h: np.ndarray) -> tuple:
    """One window: x by step and lane, h (HIDDEN, lanes). Gives all states (HIDDEN, steps, lanes), the states before, gates and candidates."""
    n, k = x.shape
    g = np.take(m["e"], x.ravel(), axis=1).reshape(-1, n, k)
    states = np.empty((HIDDEN, n, k), np.float32)
    before = np.empty((HIDDEN, n, k), np.float32)
    inner = np.empty((HIDDEN, n, k), np.float32)
    zr, cand = g[: 2 * HIDDEN], g[2 * HIDDEN :]
    half = np.float32(0.5)
    for t in range(n):
        if len(fresh[t]):
            h[:, fresh[t]] = 0
        before[:, t] = h
        a = m["wh"] @ h
        inner[:, t] = a[2 * HIDDEN :]
        s = a[: 2 * HIDDEN]
        s += zr[:, t]
        squash(s)
        s *= half
        s += half
        zr[:, t] = s
        c = s[HIDDEN:] * a[2 * HIDDEN :]
        c += cand[:, t]
        squash(c)
        cand[:, t] = c
        h = h - c
        h *= s[:HIDDEN]
        h += c
        states[:, t] = h
    return states, before, zr, cand, inner


def _rows(states: np.ndarray, live: np.ndarray | None) -> np.ndarray:
    """States as rows with a one behind, step after step."""
    _, n, k = states.shape
    out = np.ones((n * k, HIDDEN + 1), np.float32)
    out[:, :HIDDEN] = states.reshape(HIDDEN, -1).T
    return out if live is None else out[live.ravel()]


class Output:
    """The softmax's weights, their biases lowered so that no logit is over zero: states lie in [-1, 1]."""

    def __init__(self, m: dict, v: Vocabulary):
        self.c = m["c"].copy()
        self.c[-1] -= (np.abs(self.c[:-1]).sum(0) + self.c[-1]).max()
        self.o = m["o"].copy()
        full = np.flatnonzero(np.diff(v.class_start))
        if len(full):
            most = np.maximum.reduceat(np.abs(self.o[:, :-1]).sum(1) + self.o[:, -1], v.class_start[full])
            self.o[:, -1] -= np.repeat(most, np.diff(v.class_start)[full])
        self.by_class = np.ascontiguousarray(self.c.T)
        #: Of classes with words to tell apart: number, first word, weights.
        self.several = [(k, v.class_start[k], self.o[v.class_start[k] : v.class_start[k + 1]]) for k in np.flatnonzero(np.diff(v.class_start) > 1)]


_LEAST = np.float32(1e-37)
_ONES = np.ones(MODEL_WORDS + CLASSES + TAIL, np.float32)


def log_probabilities(m: dict | Output, v: Vocabulary, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, for words of the model, of P(word | class); rows: states with a one behind."""
    w = m if isinstance(m, Output) else Output(m, v)
    order = np.argsort(out.astype(np.int16), kind="stable")
    rows, out = rows[order], out[order]
    cls = v.class_of[out]
    total = np.empty(len(out), np.float32)
    for a in range(0, len(rows), ROWS):
        s = rows[a : a + ROWS] @ w.c
        np.exp(s, out=s)
        total[a : a + ROWS] = s @ _ONES[: s.shape[1]]
    logit = w.by_class[cls]
    logit *= rows
    got = logit @ _ONES[: HIDDEN + 1] - np.log(np.maximum(total, _LEAST))
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    total = np.ones(cuts[-1], np.float32)
    for k, _, x in w.several:
        for at in range(cuts[k], cuts[k + 1], ROWS):
            to = min(at + ROWS, cuts[k + 1])
            s = rows[at:to] @ x.T
            np.exp(s, out=s)
            total[at:to] = s @ _ONES[: len(x)]
    logit = w.o[out[: cuts[-1]]]
    logit *= rows[: cuts[-1]]
    one = np.diff(v.class_start)[cls[: cuts[-1]]] == 1
    got[: cuts[-1]] += np.where(one, 0, logit @ _ONES[: HIDDEN + 1] - np.log(np.maximum(total, _LEAST)))
    p = np.empty(len(out), np.float32)
    p[order] = got
    return p


def document_scores(m: dict, v: Vocabulary, numbers: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of class and word for whole documents, the state carried from window to window."""
    lanes = Lanes(numbers, v.size + TAIL)
    p = np.empty(len(lanes.y), np.float32)
    h, w = np.zeros((HIDDEN, len(lanes.size)), np.float32), Output(m, v)
    for places, live, fresh in lanes.windows(SCORE_TOKENS):
        states = run_window(m, lanes.x[places], fresh, h[:, : places.shape[1]].copy())[0]
        h = states[:, -1]
        at = places.ravel() if live is None else places[live]
        p[at] = log_probabilities(w, v, _rows(states, live), lanes.y[at])
    out = np.empty(len(numbers))
    out[lanes.order] = np.add.reduceat(p.astype(np.float64), lanes.first)
    return out


def gradients(m: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, live: np.ndarray | None, fresh: list[np.ndarray], h0: np.ndarray) -> tuple[dict, np.ndarray]:
    """The mean loss's gradients over one window, and the state behind it. y: the live tokens, step after step."""
    states, before, zr, cand, inner = run_window(m, x, fresh, h0)
    n, k = x.shape
    rows = _rows(states, live)
    scale = np.float32(1 / len(y))
    order = np.argsort(y.astype(np.int16), kind="stable")
    rows, out = rows[order], y[order]
    cls = v.class_of[out]
    starts = np.flatnonzero(np.r_[True, out[1:] != out[:-1]])
    by_word = np.add.reduceat(rows, starts, axis=0)  # the sum of the states before each token
    tokens = out[starts]
    # classes
    w = Output(m, v)
    dc = np.zeros_like(w.c)
    back = np.empty_like(rows)
    for a in range(0, len(rows), ROWS):
        r = rows[a : a + ROWS]
        s = r @ w.c
        np.exp(s, out=s)
        share = np.float32(1) / np.maximum(s @ _ONES[: s.shape[1]], _LEAST)
        share = share[:, None]
        dc += (r * share).T @ s
        np.multiply(s @ w.by_class, share, out=back[a : a + ROWS])
    back -= w.by_class[cls]
    np.subtract.at(dc.T, v.class_of[tokens], by_word)
    # words in their classes
    do = np.zeros_like(m["o"])
    cuts = np.searchsorted(cls, np.arange(CLASSES + 1))
    for j, first, x_o in w.several:
        r = rows[cuts[j] : cuts[j + 1]]
        if len(r):
            s = r @ x_o.T
            np.exp(s, out=s)
            share = np.float32(1) / np.maximum(s @ _ONES[: len(x_o)], _LEAST)
            share = share[:, None]
            do[first : first + len(x_o)] = s.T @ (r * share)
            s = s @ x_o
            s *= share
            s -= w.o[out[cuts[j] : cuts[j + 1]]]
            back[cuts[j] : cuts[j + 1]] += s
    inside = (tokens < v.size) & np.isin(v.class_of[tokens], [j for j, _, _ in w.several])
    do[tokens[inside]] -= by_word[inside]
    # back through the window
    flat = np.zeros((n * k, HIDDEN), np.float32)
    flat[order if live is None else np.flatnonzero(live.ravel())[order]] = back[:, :HIDDEN]
    flat = np.ascontiguousarray(flat.T).reshape(HIDDEN, n, k)
    flat *= scale
    one, half = np.float32(1), np.float32(0.5)
    z, r = zr[:HIDDEN], zr[HIDDEN:]
    slope = one - np.abs(zr * np.float32(2) - one)
    slope *= slope
    slope *= half
    into_c = one - np.abs(cand)
    into_c *= into_c
    into_c *= one - z
    into_z = (before - cand) * slope[:HIDDEN]
    into_r = inner * slope[HIDDEN:]
    dg, dx = np.empty((3 * HIDDEN, n, k), np.float32), np.empty((HIDDEN, n, k), np.float32)
    dn = np.zeros((HIDDEN, k), np.float32)
    for t in range(n - 1, -1, -1):
        d = dn + flat[:, t]
        da = d * into_c[:, t]
        g = dg[:, t]
        np.multiply(d, into_z[:, t], out=g[:HIDDEN])
        np.multiply(da, into_r[:, t], out=g[HIDDEN : 2 * HIDDEN])
        np.multiply(da, r[:, t], out=g[2 * HIDDEN :])
        dx[:, t] = da
        dn = m["wh"].T @ g
        d *= z[:, t]
        dn += d
        if len(fresh[t]):
            dn[:, fresh[t]] = 0
    dwh = dg.reshape(3 * HIDDEN, -1) @ before.reshape(HIDDEN, -1).T
    width = m["e"].shape[1]
    dg[2 * HIDDEN :] = dx
    place, flat = x.ravel().astype(np.intp), dg.reshape(3 * HIDDEN, -1)
    de = np.empty((3 * HIDDEN, width), np.float32)
    for j in range(3 * HIDDEN):
        de[j] = np.bincount(place, weights=flat[j], minlength=width)
    return {"e": de, "wh": dwh, "c": dc * scale, "o": do * scale}, states[:, -1]


def train(m: dict, seen: dict, v: Vocabulary, texts: list[np.ndarray], lanes: int = LANES) -> None:
    """Adagrad over windows of whole texts (numbers); m and seen (the sums of squares) change in place."""
    dealt = Lanes(texts, v.size + TAIL, lanes)
    h = np.zeros((HIDDEN, len(dealt.size)), np.float32)
    for places, live, fresh in dealt.windows():
        y = dealt.y[places.ravel() if live is None else places[live]]
        g, h = gradients(m, v, dealt.x[places], y, live, fresh, h[:, : places.shape[1]].copy())
        for name, q in g.items():
            seen[name] += q * q
            m[name] -= np.float32(RATE) * q / np.sqrt(seen[name])


def new_sums(m: dict) -> dict:
    return {k: np.full(x.shape, 1e-7, np.float32) for k, x in m.items()}


_M = "part int, task long, n long, sum binary"


def _round(shared, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v = shared.value
        m, seen = ({k: x.copy() for k, x in d.items()} for d in model.value)
        n = held = 0
        texts: list[np.ndarray] = []
        for b in batches:
            keys = [np.frombuffer(x, np.uint64) for x in b.column("keys").to_pylist()]
            for some in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(np.cumsum([len(x) for x in keys]) // LOOK_TOKENS)) + 1):
                size = [len(keys[k]) for k in some]
                texts += np.split(v.look(np.concatenate([keys[k] for k in some]))[0], np.cumsum(size)[:-1])
                held += sum(size)
                if held >= GROUP_TOKENS:
                    train(m, seen, v, texts)
                    n, held, texts = n + held, 0, []
        if texts:
            train(m, seen, v, texts)
            n += held
        if n:
            vector = np.concatenate([d[k].ravel() for d in (m, seen) for k in sorted(m)]).astype(np.float64) * n
            parts = np.array_split(vector, PARTS)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([task] * PARTS, pa.int64()), pa.array([n] * PARTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["part", "task", "n", "sum"])

    return run


def _add(key, rows):
    total = None
    for x in rows.column("sum"):
        y = np.frombuffer(x.as_buffer(), np.float64)
        total = y.copy() if total is None else total + y
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "task": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "sum": pa.array([total.tobytes()], pa.binary())})


class LanguageModel:
    """A trained model: the vocabulary's head, the parameters, and the table of all words (key, c)."""

    def __init__(self, vocabulary: Vocabulary, parameters: dict, words: DataFrame):
        self.vocabulary, self.parameters, self.words = vocabulary, parameters, words


def tokens(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, training, round, keys of every row, stored."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    rows = rows.withColumn("round", F.pmod(F.xxhash64("row"), F.lit(ROUNDS)).cast("int")).select("row", "id", "training", "round", "text")
    return written(rows.mapInArrow(_tokens, "row long, id long, training boolean, round int, keys binary"), "lm-tokens")


def _head(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words counted at least as often as the least count that leaves HEAD of them at most, and twice or more."""
    # steps of the count: exact below STEPS, then STEPS in each doubling
    level = F.expr(f"if(c < {STEPS}, c, cast({STEPS} * (1 + log2(c / {STEPS})) as long))")
    steps = words.where("c > 1").select(level.alias("level")).groupBy("level").count().orderBy(F.desc("level")).collect()
    least, n = None, 0
    for r in steps:
        n += r["count"]
        if n > HEAD:
            break
        least = r.level
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    head = words.where("c > 1").where(level >= least).toArrow()
    return head.column("key").to_numpy().view(np.uint64), head.column("c").to_numpy()


def train_model(stored: DataFrame) -> LanguageModel:
    """Learns from the training rows of a table of tokens()."""
    sc = stored.sparkSession.sparkContext
    texts = stored.where("training")
    words = written(texts.select("keys").mapInArrow(_counts, "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "lm-words")
    tail = {r.p: (r.n, r.v) for r in words.groupBy(F.expr(f"key & {TAIL - 1}").cast("int").alias("p")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    n_tail, v_tail = (np.array([tail.get(k, (0, 0))[j] for k in range(TAIL)], np.int64) for j in (0, 1))
    vocabulary = Vocabulary(*_head(words), n_tail, v_tail)
    model = new_model(vocabulary)
    seen = new_sums(model)
    shared = sc.broadcast(vocabulary)
    for k in range(ROUNDS):
        held = sc.broadcast((model, seen))
        part = texts.where(F.col("round") == k).select("keys")
        sums = part.mapInArrow(_round(shared, held), _M)
        tasks = part.rdd.getNumPartitions()
        while tasks > 1:
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("part", "task").applyInArrow(_add, _M)
            tasks = math.ceil(tasks / FAN)
        got = sums.collect()
        if got:
            vector = np.concatenate([np.frombuffer(r["sum"], np.float64) / r.n for r in sorted(got, key=lambda r: r.part)]).astype(np.float32)
            at, new = 0, []
            for d in (model, seen):
                new.append({})
                for name in sorted(d):
                    new[-1][name] = vector[at : at + d[name].size].reshape(d[name].shape)
                    at += d[name].size
            model, seen = new
    return LanguageModel(vocabulary, model, words)


_S = "kind int, row long, id long, n_tokens long, n_known long, log_count double, model double, key long, times long"


def _score(shared):
    fields = [("kind", pa.int32()), ("row", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_count", pa.float64()), ("model", pa.float64()), ("key", pa.int64()), ("times", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        for t in chunks(batches, "keys", CHUNK):
            rows = t.column("row").to_numpy()
            keys = _arrays(t)
            n = np.array([len(x) for x in keys])
            flat = np.concatenate(keys)
            number, count = v.look(flat)
            first = np.cumsum(n) - n
            hit = count >= 0
            logs = np.where(hit, np.log10(np.maximum(count, 0) + 1.0), 0.0)
            in_tail = number >= v.size
            # the word within its tail class; the counts of words outside the head are added by the join
            within = np.where(in_tail, logs - v.tail_log[np.where(in_tail, number - v.size, 0)], 0.0)
            model = document_scores(m, v, np.split(number, first[1:])) / math.log(10) + np.add.reduceat(within, first)
            k = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(rows), t.column("id").combine_chunks(), pa.array(n), pa.array(np.add.reduceat(hit.astype(np.int64), first)), pa.array(np.add.reduceat(logs, first)), pa.array(model), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], schema=schema)
            rare = np.flatnonzero(~hit)
            if len(rare):
                owner = np.repeat(rows, n)[rare]
                o = np.lexsort((owner, flat[rare]))
                own, key = owner[o], flat[rare][o].view(np.int64)
                new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (key[1:] != key[:-1])])
                k = len(new)
                null = lambda ty: pa.nulls(k, ty)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(own[new]), *[null(f[1]) for f in fields[2:7]], pa.array(key[new]), pa.array(np.diff(np.r_[new, len(own)]))], schema=schema)

    return run


def score_tokens(stored: DataFrame, lm: LanguageModel) -> DataFrame:
    """id, training, n_tokens, n_known, train_tokens, base_score, score for every row of a table of tokens()."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast((lm.vocabulary, lm.parameters))
    scan = written(stored.select("row", "id", "keys").mapInArrow(_score(shared), _S), "lm-scores", "kind")
    # words outside the head, of which each row has its own few; a word that training lacks finds no partner
    rare = scan.where("kind = 1").select("row", "key", "times").join(lm.words, "key")
    per = rare.groupBy(F.col("row").alias("_row")).agg(F.sum("times").alias("_n"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_s"))
    n_tokens, v = lm.vocabulary.tokens, lm.vocabulary.types
    base = math.log10(n_tokens + v + 1)
    added = F.coalesce("_s", F.lit(0.0))
    return scan.where("kind = 0").join(per, F.col("row") == F.col("_row"), "left").select(
        "id", "n_tokens", (F.col("n_known") + F.coalesce("_n", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("log_count") + added - F.col("n_tokens") * F.lit(base)).alias("base_score"), (F.col("model") + added).alias("score"),
    )


def score_documents(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score for every row, by a model that learns from the rows where is_training holds."""
    stored = tokens(docs, is_training, id_col, text_col)
    return score_tokens(stored, train_model(stored)).withColumnRenamed("id", id_col)

"""Classifiers, language model, mixing, codec, extraction and search against brute force and held-out rows."""

import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.llm import gru_lm, html_extract, mixing, quality_mil, sentencepiece_codec, topk_search, toxicity_cnn
from graphloom.llm.common import components, crc_mod

ODD = [(1, "", "en"), (2, None, None), (3, " \t\n", "de"), (4, "word " * 40000, "en"), (None, "no id here", "fr"), (5, "same same", "en"), (5, "same same", "en"), (6, "Zürich 日本", "xx")]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(1)).withColumn("n_tokens", F.lit("clash"))


def planted(n, bad, seed=0):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        x = [rnd.choice(words) for _ in range(rnd.randrange(5, 300))]
        y = i % 3 == 0
        if y:
            bad(x, rnd)
        rows.append((i, " ".join(x), int(y)))
    return rows


def test_training_rows_are_bounded_by_ids_and_bytes(spark, monkeypatch):
    """One labelled id on 10,000 rows is one training row; features come up to the bound, in the order of the hashes."""
    docs = spark.range(10_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("some text "), F.col("id") % 5).alias("text")).unionByName(spark.createDataFrame([(k, f"text of {k} " * 10) for k in range(20, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), *((k, k % 2) for k in range(20, 60))], "doc_id long, quality int")
    take = lambda limit: quality_mil.training_sample(docs, labels, "doc_id", "text", "quality", F.lit(True), limit, quality_mil.encode)
    ids, y, draw = take(6000)
    assert len(ids) == len(set(draw.tolist())) == 41 and len(take(6)[0]) == 6
    monkeypatch.setattr(quality_mil, "TRAIN_BYTES", sum(4 * len(x) for x in ids[:9]) + 1)
    some, labels_of, order = take(6000)
    assert len(some) == 9 and order.tolist() == draw[:9].tolist() and labels_of.tolist() == y[:9].tolist()
    assert all((a == b).all() for a, b in zip(some, ids, strict=False))


def test_quality_on_held_out_rows(spark):
    def junk(x, rnd):
        k = rnd.randrange(len(x))
        x[k : k + 60] = [w + "***" for w in x[k : k + 60]] + ["BUY!!"] * 8

    rows = planted(900, junk)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, y in rows], "doc_id long, quality int")
    model = quality_mil.quality_model(docs, labels, crc_mod("doc_id", 3) != 1)
    got = {r.doc_id: r.quality_score for r in quality_mil.scored(docs, model).collect()}
    held = [(i, 1 - y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == y for i, y in held]) > 0.97


def test_quality_gradients():
    rnd = np.random.default_rng(0)
    docs = [quality_mil.encode(" ".join(f"w{rnd.integers(50)}" for _ in range(n)).encode()) for n in (3, 130, 60)]
    m = {k: v.astype(np.float64) for k, v in quality_mil.new_model(0.4).items()}
    ids, n, y = np.concatenate(docs), np.array([len(d) for d in docs]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-quality_mil.forward(m, ids, n)[0]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality_mil.gradients(m, ids, n, y)
    for name in m:
        at = np.unravel_index(np.abs(g[name]).argmax(), m[name].shape) if m[name].shape else ()
        old = m[name][at].copy()
        m[name][at] = old + 1e-5
        up = loss()
        m[name][at] = old - 1e-5
        down = loss()
        m[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_quality_steps_touch_only_rows_of_their_words():
    """A step makes nothing of the size of all embeddings, and moves every parameter as the whole gradient says."""
    docs = [quality_mil.encode(x) for x in (b"", b"one two two two three", b"four " * 130, b"one five six")]
    ids, n, y = np.concatenate(docs), np.array([len(d) for d in docs]), np.array([1, 0, 1, 0], np.float32)
    m = quality_mil.new_model(0.4)
    seen = {k: np.full_like(v, 1e-6) for k, v in m.items()}
    want = {k: v - quality_mil.RATE * g / np.sqrt(1e-6 + g * g) for (k, v), g in zip(m.items(), map(quality_mil.gradients(m, ids, n, y).get, m), strict=True)}
    tracemalloc.start()
    quality_mil.learn(m, seen, docs, y, 1, 7)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < m["e"].nbytes / 4
    for k in m:
        np.testing.assert_allclose(m[k], want[k], rtol=1e-2, atol=1e-4)


def test_toxicity_on_held_out_rows(spark):
    def insult(x, rnd):
        for w in rnd.sample(["fool", "vermin", "dolt", "cretin"], 2):
            x.insert(rnd.randrange(len(x)), w + rnd.choice(["", ",", "!"]))

    rows = planted(1500, insult, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity_cnn.toxicity_model(docs, labels, crc_mod("doc_id", 5) != 0)
    got = {r.id: r.score for r in toxicity_cnn.scored(docs.select(F.col("doc_id").alias("id"), "text"), model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == y for i, y in held]) > 0.97


@pytest.mark.parametrize("which", ["quality", "toxic"])
def test_classifiers_learn_from_every_labelled_row(spark, which):
    """Of 10,400 labelled texts the 300 of the greatest hashes are the only ones of their class; they alone tell what marks it."""
    ids = spark.range(10_400).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.desc(F.xxhash64(F.lit(11), "id")))).alias("r"))
    docs = ids.select("doc_id", F.concat(F.lit("plain words about thing "), F.col("doc_id") % 97, F.when(F.col("r") <= 300, " vermin vermin").otherwise("")).alias("text"), (F.col("r") <= 300).cast("int").alias("mark")).persist()
    labels = docs.select("doc_id", F.col("mark").alias("toxic"), (1 - F.col("mark")).alias("quality"))
    if which == "toxic":
        got = toxicity_cnn.scored(docs.select(F.col("doc_id").alias("id"), "text"), toxicity_cnn.toxicity_model(docs, labels, F.lit(True)))
    else:
        got = quality_mil.scored(docs, quality_mil.quality_model(docs, labels, F.lit(True))).select(F.col("doc_id").alias("id"), (1 - F.col("quality_score")).alias("score"))
    wrong = got.join(docs.select(F.col("doc_id").alias("id"), "mark"), "id").where("(score > 0.5) <> (mark = 1)").count()
    docs.unpersist()
    assert wrong == 0


def test_thresholds_from_bins():
    """The threshold from merged bins is the one that a sort of all rows gives, where rows of both classes share no bin."""
    r = np.random.default_rng(5)
    y = (np.arange(400) % 3 == 0).astype(int)
    s = np.unique(np.round(r.standard_normal(4000), 2))[r.permutation(400)] + y
    lang = np.arange(400) % 5
    parts = pa.concat_tables([toxicity_cnn.bins(s[k::7], y[k::7], lang[k::7]) for k in range(7)])
    m = {"threshold": np.zeros(5)}
    toxicity_cnn.set_thresholds(m, parts)

    def best(s, y):
        cuts = [(a + b) / 2 for a, b in itertools.pairwise(np.unique(s))]
        f1 = lambda c: 2 * y[s >= c].sum() / ((s >= c).sum() + y.sum())
        return max(map(f1, cuts)), f1

    for j in range(5):
        most, f1 = best(s[lang == j], y[lang == j])
        assert f1(m["threshold"][j]) == pytest.approx(most)


def test_language_of_texts():
    ids, starts, _ = toxicity_cnn._laid([toxicity_cnn.encode(x) for x in (b"the cat of that is", "der Hund und das ist".encode(), b"", b"les gens et dans", b"el gato y los con")])
    assert toxicity_cnn.languages(ids, starts).tolist() == [1, 2, 0, 3, 4]


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 1, 1), (None, 1, 1), (4, 1, None), (99, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality_mil.quality_model(odd, labels, F.lit(True))
    got = quality_mil.scored(odd.withColumn("quality_score", F.lit("clash")), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality_score <= 1 for r in got)
    t = toxicity_cnn.toxicity_model(odd, labels, F.lit(True))
    rows = odd.select(F.col("doc_id").alias("id"), "text")
    got = toxicity_cnn.scored(rows, t).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = labels.where("false")
    assert quality_mil.scored(odd.where("false"), quality_mil.quality_model(odd, none, F.lit(True))).count() == 0
    assert {r.score < 0.01 for r in toxicity_cnn.scored(rows, toxicity_cnn.toxicity_model(odd, none, F.lit(True))).collect()} == {True}


def test_toxicity_gradients(monkeypatch):
    """Along every block's gradient the mean loss changes as finite differences say."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(n)) for n in (1, 2, 5, 30, 12)] + [""]
    docs = [toxicity_cnn.encode(x.encode()) for x in texts]
    y = np.array([1, 0, 1, 0, 0, 1])
    r = np.random.default_rng(1)
    m = {"e": r.standard_normal((toxicity_cnn.PAD + 1, toxicity_cnn.WIDTH)) * 0.3, "o": r.standard_normal(toxicity_cnn.FILTERS * len(toxicity_cnn.WIDTHS)), "o0": np.array(0.2)}
    m["e"][toxicity_cnn.PAD] = 0
    for k in toxicity_cnn.WIDTHS:
        m[f"w{k}"] = r.standard_normal((k, toxicity_cnn.WIDTH, toxicity_cnn.FILTERS)) * 0.4
        m[f"b{k}"] = r.standard_normal(toxicity_cnn.FILTERS) * 0.1
    got = {}
    monkeypatch.setattr(toxicity_cnn, "_step", lambda m, seen, name, g, rows=...: got.__setitem__(name, (g, rows)))
    toxicity_cnn._learn(m, {}, docs, y)

    def loss(m):
        s = toxicity_cnn.logits(m, docs)[0]
        return float(np.mean(np.logaddexp(0, s) - y * s))

    assert set(got) == set(m)
    for name, (g, rows) in got.items():
        full = np.zeros(m[name].shape)
        full[rows] = g
        size = float(np.sqrt((full**2).sum()))
        assert size > 0
        up, down = (loss(m | {name: m[name] + h * 1e-5 * full / size}) for h in (1, -1))
        assert (up - down) / 2e-5 == pytest.approx(size, rel=1e-2), name


def test_toxicity_thresholds_by_language():
    """A language with rows enough has a threshold of its own; a score of 0.5 is the threshold of the text's language."""
    rnd = random.Random(3)
    words = {n: list(dict.fromkeys(x.split())) for n, x in toxicity_cnn.FUNCTION_WORDS.items()}
    texts, y = [], []
    for i in range(1600):
        n = list(words)[i % len(words)]
        bad = i % 3 == 0
        mild = rnd.random() < (0.5 if n == list(words)[0] else 0.02)  # in one language clean texts hold the word too
        texts.append(" ".join([rnd.choice(words[n]) for _ in range(12)] + ["awful"] * (bad or mild) + ["vile"] * bad * rnd.randrange(2)).encode())
        y.append(int(bad))
    m = toxicity_cnn.train([toxicity_cnn.encode(x) for x in texts], np.array(y), epochs=2)
    assert len(set(np.round(m["threshold"], 6).tolist())) > 1
    s, lang = toxicity_cnn.logits(m, [toxicity_cnn.encode(x) for x in texts])
    assert set(lang.tolist()) >= set(range(1, len(words) + 1))
    assert ((toxicity_cnn.scores(m, texts) >= 0.5) == (s.astype(float) >= m["threshold"][lang])).all()


def brute_base(rows, train):
    words = {k: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")] + [None] for k, (_, x) in enumerate(rows)}
    c = Counter(w for k in words if train(rows[k][0]) for w in words[k])
    n, v = sum(c.values()), len(c)
    return sorted((len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for t in words.values())


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", 40)  # so that most words are looked up in the table
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        pool = [f"{'ab'[i % 2]}{k}" for k in range(60)]
        rows.append((i, " ".join(rnd.choice(pool[: rnd.choice([5, 60])]).upper() for _ in range(rnd.randrange(0, 200)))))
    rows += [(i, t) for i, t, _ in ODD]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = gru_lm.score_documents(df, crc_mod("doc_id", 7) != 2).collect()
    want = brute_base(rows, lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2)
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 100


def vocabulary_of(words, counts):
    keys = np.unique(gru_lm.token_keys(words.encode()))
    counts = np.resize(counts, len(keys))
    tail = gru_lm.tail_class(keys)
    return gru_lm.Vocabulary(keys, counts, np.bincount(tail, weights=counts, minlength=gru_lm.TAIL).astype(np.int64), np.bincount(tail, minlength=gru_lm.TAIL))


def test_language_model_is_a_distribution():
    v = vocabulary_of(" ".join(f"w{k}" for k in range(300)), np.arange(1, 400))
    m = gru_lm.new_model(v)
    m["o"] += np.random.default_rng(1).standard_normal(m["o"].shape).astype(np.float32)
    h = np.random.default_rng(0).uniform(-1, 1, (1, gru_lm.HIDDEN + 1)).astype(np.float32)
    h[0, -1] = 1
    out = np.arange(v.size + gru_lm.TAIL)
    assert abs(np.exp(gru_lm.log_probabilities(m, v, np.repeat(h, len(out), 0), out)).sum() - 1) < 1e-4


def plain_states(m, v, doc):
    """The states before each token, one step at a time."""
    k, squash = gru_lm.HIDDEN, lambda x: x / (1 + np.abs(x))
    h, prev, out = np.zeros(k), v.size + gru_lm.TAIL, []
    for w in doc:
        x, g = m["e"][:, prev].astype(float), m["wh"].astype(float) @ h
        z, r = 0.5 + 0.5 * squash(x[:k] + g[:k]), 0.5 + 0.5 * squash(x[k : 2 * k] + g[k : 2 * k])
        n = squash(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        out.append(h)
        prev = w
    return np.array(out)


def plain_score(m, v, doc):
    """Class, then word, from plain softmaxes."""
    h = np.c_[plain_states(m, v, doc), np.ones(len(doc))]
    total = 0.0
    for x, w in zip(h, doc, strict=True):
        s, c = x @ m["c"], v.class_of[w]
        total += s[c] - np.log(np.exp(s).sum())
        if w < v.size:
            s = m["o"][v.class_start[c] : v.class_start[c + 1]] @ x
            total += s[w - v.class_start[c]] - np.log(np.exp(s).sum())
    return total


@pytest.mark.parametrize("lanes", [2, 512])
def test_state_is_carried_over_windows(lanes, monkeypatch):
    monkeypatch.setattr(gru_lm.Lanes.__init__, "__defaults__", (lanes,))
    v = vocabulary_of("a b c d e f g", [5])
    m = gru_lm.new_model(v)
    m["o"] += np.random.default_rng(3).standard_normal(m["o"].shape).astype(np.float32)
    rnd = np.random.default_rng(1)
    docs = [rnd.integers(0, v.size + gru_lm.TAIL, n).astype(np.int32) for n in (270, 3, 16, 33, 1)]
    assert np.allclose(gru_lm.document_scores(m, v, docs), [plain_score(m, v, d) for d in docs], atol=1e-2)


@pytest.mark.parametrize("lanes", [3, 512])
def test_language_model_gradients(lanes):
    """Along every block's gradient the loss of a window changes as finite differences say, texts that start and end in it included."""
    v = vocabulary_of(" ".join(f"w{k}" for k in range(300)), np.arange(1, 400))
    m = gru_lm.new_model(v)
    rnd = np.random.default_rng(2)
    m["o"] += rnd.standard_normal(m["o"].shape).astype(np.float32)
    m["c"] += rnd.standard_normal(m["c"].shape).astype(np.float32)
    texts = [rnd.integers(0, v.size + gru_lm.TAIL, n).astype(np.int32) for n in (9, 30, 4, 7, 1, 12)]
    dealt = gru_lm.Lanes(texts, v.size + gru_lm.TAIL, lanes)
    places, live, fresh = next(dealt.windows())
    y = dealt.y[places.ravel() if live is None else places[live]]
    h0 = np.zeros((gru_lm.HIDDEN, places.shape[1]), np.float32)
    assert live is not None and sum(map(len, fresh)) == len(texts)
    assert len(y) == sum(map(len, texts))  # the window holds all of them

    def loss(p):
        return -sum(plain_score(p, v, t) for t in texts) / len(y)

    g, _ = gru_lm.gradients(m, v, dealt.x[places], y, live, fresh, h0.copy())
    for name, q in g.items():
        size = float(np.sqrt((q.astype(float) ** 2).sum()))
        assert size > 0
        step = {s: m | {name: m[name].astype(float) + s * 1e-4 * q / size} for s in (1, -1)}
        assert abs((loss(step[1]) - loss(step[-1])) / 2e-4 - size) < 0.01 * size, name


def test_training_takes_every_token(spark, monkeypatch):
    # a pair that stands behind the first 64 tokens of every text, and the end after it
    rnd = random.Random(8)
    rows = [(i, " ".join([f"w{rnd.randrange(50)}" for _ in range(64)] + ["left", "right"] * 16)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored = gru_lm.tokens(df, F.lit(True)).cache()
    lm = gru_lm.train_model(stored)
    v = lm.vocabulary
    keys = [np.frombuffer(bytes(r["keys"]), np.uint64) for r in stored.collect()]
    texts = [v.look(k)[0] for k in keys]
    seen = []
    monkeypatch.setattr(gru_lm, "gradients", lambda m, v, x, y, live, fresh, h: (seen.append((y, sum(map(len, fresh)))), ({}, h))[1])
    gru_lm.train(lm.parameters, {}, v, texts)
    assert sum(len(y) for y, _ in seen) == 97 * 3000 and sum(n for _, n in seen) == 3000
    assert sum(int((y == texts[0][-1]).sum()) for y, _ in seen) == 3000  # every end is a target
    assert sorted({r["round"] for r in stored.select("round").distinct().collect()}) == list(range(gru_lm.ROUNDS))
    numbers = texts[0]
    prefix = gru_lm.document_scores(lm.parameters, v, [numbers[:64]])[0]
    whole = gru_lm.document_scores(lm.parameters, v, [numbers])[0]
    unigram = (32 * math.log(16 / 97) + math.log(1 / 97)) / 33
    assert (whole - prefix) / 33 > unigram + 0.6  # learned from what stands behind the first tokens


def test_parameters_are_averaged_in_a_tree(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a b w{i % 50} " * (i % 9)) for i in range(400)], "doc_id long, text string").repartition(9)
    stored = gru_lm.tokens(df, F.lit(True))
    first = gru_lm.train_model(stored).parameters
    monkeypatch.setattr(gru_lm, "FAN", 2)
    second = gru_lm.train_model(stored).parameters
    for name, x in first.items():
        assert np.allclose(x, second[name], atol=1e-4)


def test_head_keeps_whole_levels_of_counts(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "HEAD", 10)
    words = spark.createDataFrame([(k, c) for k, c in enumerate([9000, 800, 70, 70, 70, 5, 5, 5, 5, 3, 1, 1])], "key long, c long")
    keys, counts = gru_lm._head(words)
    assert sorted(counts.tolist()) == [3, 5, 5, 5, 5, 70, 70, 70, 800, 9000]
    monkeypatch.setattr(gru_lm, "HEAD", 8)
    assert sorted(gru_lm._head(words)[1].tolist()) == [70, 70, 70, 800, 9000]


def test_no_training_text(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    r = gru_lm.score_documents(df, F.lit(False)).collect()[0]
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
    assert gru_lm.score_documents(df.where("false"), F.lit(True)).count() == 0


def test_mixing_reaches_the_targets(spark, odd):
    rnd = random.Random(2)
    rows = [(i, " ".join(f"word{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 60))), rnd.choice("aaab"), rnd.choice(["en", "de"])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.4, "none": 0.1}, "lang": {"en": 0.3, "de": 0.7}, "topic": {str(k): 1.0 for k in range(8)}}
    got = mixing.weighted(df, targets).toPandas()
    assert got.probability.max() == pytest.approx(1) and len(got) == 4000
    mass = got.n_tokens * got.probability
    for d in ("source", "lang", "topic"):
        share = mass.groupby(got[d]).sum() / mass.sum()
        want = {k: v for k, v in targets[d].items() if k in share.index}
        for k in want:
            assert share[k] == pytest.approx(want[k] / sum(want.values()), abs=1e-6)
    taken = (got.n_tokens * got.selected).sum()
    assert taken == pytest.approx(mass.sum(), rel=0.06)
    assert mixing.sample(df, targets).count() == got.selected.sum()
    again = mixing.weighted(odd, targets).collect()
    assert len(again) == len(ODD) and mixing.weighted(odd.where("false"), targets).count() == 0
    assert mixing.sample(odd, targets).columns == odd.columns


def test_raking_equals_plain_proportional_fitting():
    """Where no value is scarce and the bound need not be low, weights are those of plain iterative proportional fitting up to the bound's search."""
    rnd = np.random.default_rng(3)
    cells = {(a, b, c): float(rnd.integers(50, 100)) for a in "xyz" for b in "pq" for c in "01"}
    targets = [{"x": 0.3, "y": 0.36, "z": 0.34}, {"p": 0.55, "q": 0.45}, {"0": 0.5, "1": 0.5}]
    w = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(500):
        for d, target in enumerate(targets):
            for name, share in target.items():
                now = sum(cells[k] * w[k] for k in cells if k[d] == name) / total
                for k in cells:
                    if k[d] == name:
                        w[k] *= share / now
    observed = np.array([cells[k] for k in cells]) / total
    sides = [(np.array([sorted(t).index(k[d]) for k in cells]), np.array([t[n] for n in sorted(t)]), np.zeros(len(t), bool)) for d, t in enumerate(targets)]
    got, off = mixing._bounded(observed, sides, np.full(len(cells), np.nan), 64.0, 1000)
    assert off < 1e-9 and np.allclose(got, [w[k] for k in cells], rtol=1e-6)
    bounded, off = mixing.rake(cells, targets)
    assert off <= mixing.CLOSE and max(bounded.values()) <= max(w.values()) * (1 + 1e-6)
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert sum(cells[k] * bounded[k] for k in cells if k[d] == name) / total == pytest.approx(share, abs=1e-6)


def test_contradicting_targets_are_told(spark):
    df = spark.createDataFrame([(i, "some words here", "ab"[i % 2], ["en", "de"][i % 2]) for i in range(40)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.2, "de": 0.8}, "topic": {str(k): 1 / 8 for k in range(8)}}
    assert mixing.weighted(df, targets).first().target_gap > 0.1
    with pytest.raises(ValueError, match="not reached"):
        mixing.sample(df, targets, most_gap=0.01)


def test_topics_are_learnt_within_languages(spark):
    """Texts about one of two subjects in each of two languages: topics part the subjects and not the languages."""
    rnd = random.Random(12)
    subjects = {(n, s): [f"{n}{s}word{k}" for k in range(30)] for n in ("en", "de") for s in "xy"}
    rows = []
    for i in range(1200):
        n, s = ("en", "de")[i % 2], "xy"[i // 2 % 2]
        rows.append((i, " ".join(rnd.choice(subjects[n, s]) for _ in range(60)), "a", n, s))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject string")
    targets = {"source": {"a": 1.0}, "lang": {"en": 0.5, "de": 0.5}, "topic": {str(k): 1.0 for k in range(8)}}
    got = mixing.weighted(df, targets).join(df.select("doc_id", "subject"), "doc_id").toPandas()
    assert len(set(got.topic)) > 1
    pure = got.groupby(["lang", "topic"]).subject.agg(lambda x: x.value_counts().max() / len(x))
    assert (pure > 0.95).all()


def test_rows_are_drawn_one_by_one(spark):
    """Null ids are drawn by their text, columns may have any names, rows that share an id are drawn by their own cells."""
    rnd = random.Random(4)
    rows = [(None, " ".join(f"word{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 60))), "ab"[i % 4 == 0], "en", i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, `_chosen` int").withColumn("draw", F.lit("x")).withColumn("rest", F.lit(1)).withColumn("a.b", F.lit(2))
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 1.0}, "topic": {str(k): 1.0 for k in range(8)}}
    want = mixing.weighted(df, targets)
    got = mixing.sample(df, targets)
    assert got.columns == df.columns
    assert 0 < got.count() == want.where("selected").count() < 400
    assert got.exceptAll(df).count() == 0


def test_one_odd_row_does_not_thin_the_mix(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"word{rnd.randrange(3000)}" for _ in range(rnd.randrange(1, 60))), rnd.choice("aaab"), rnd.choice(["en", "de"])) for i in range(4000)]
    odd_row = (4000, "word1 " * 200, None, "en")
    targets = {"source": {"a": 0.5, "b": 0.48, "other": 0.02}, "lang": {"en": 0.3, "de": 0.68, "other": 0.02}, "topic": {str(k): 1 / 8 for k in range(8)}}
    kept = []
    for more in ([], [odd_row]):
        got = mixing.weighted(spark.createDataFrame(rows + more, "doc_id long, text string, source string, lang string"), targets).toPandas()
        mass = got.n_tokens * got.probability
        kept.append(mass.sum() / got.n_tokens.sum())
        share = mass.groupby(got.lang).sum() / mass.sum()
        assert share["en"] == pytest.approx(0.3 / 0.98, abs=1e-6)
    # no marginal can be filled with more: b is a quarter of the tokens and is to be about a half
    assert kept[0] > 0.45 and kept[1] == pytest.approx(kept[0], rel=0.02)
    assert got[got.doc_id == 4000].probability.item() == pytest.approx(1)


def test_codec_parity_and_round_trip(spark, odd):
    import sentencepiece

    data = sentencepiece_codec.read_model()
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    rnd = random.Random(4)
    texts = [x or "" for _, x, _ in ODD] + ["  lead", "trail  ", "a   b     c      d", "tab\tnew\n\nline", "🙂 emoji é ñ 中文", "<s> </s> <0x41> <unk>", "\x00", "x" * 5000, "nb sp"]
    texts += ["".join(rnd.choice("abc   \n\té中.") for _ in range(rnd.randrange(200))) for _ in range(300)]
    ids = sentencepiece_codec.encode_texts(data, texts, verify_every=1)
    assert ids == reference.encode(texts) and sentencepiece_codec.decode_ids(data, ids) == reference.decode(ids) == texts
    rows = sentencepiece_codec.digests(odd).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows)
    both = sentencepiece_codec.decoded(sentencepiece_codec.encoded(odd.withColumn("token_ids", F.lit("clash"))).withColumn("decoded_text", F.lit(1))).collect()
    assert sorted(r.decoded_text for r in both) == sorted(x or "" for _, x, _ in ODD)
    assert sentencepiece_codec.encoded(odd.where("false")).count() == 0


@pytest.mark.parametrize("wrong", range(9))
def test_every_text_is_verified(monkeypatch, wrong):
    data = sentencepiece_codec.read_model()
    texts = [f"text number {k}" for k in range(9)]
    t, reference, byte_ids, model = sentencepiece_codec._ready(data)

    class Broken:
        def encode_batch_fast(self, part, **options):
            return [type("E", (), {"ids": e.ids + [0] * (x == texts[wrong])}) for x, e in zip(part, t.encode_batch_fast(part, **options), strict=True)]

    monkeypatch.setattr(sentencepiece_codec, "_ready", lambda _: (Broken(), reference, byte_ids, model))
    with pytest.raises(AssertionError, match=f"number {wrong}"):
        sentencepiece_codec.encode_texts(data, texts)


def field(number, value):
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + np.float32(value).tobytes()
    return varint(number << 3) + varint(value)


def test_codec_unigram():
    import sentencepiece

    # a model written by hand: unigram scores, byte fallback, extra white space removed
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(x, -1.0 - k / 3, 1) for k, x in enumerate(["▁al", "pha", "▁alpha", "bet", "a", "▁", "▁bet", "b", "e", "t", "alphabet", "l", "p", "h", "ga", "mma", "g", "m"])]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 1))
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    rnd = random.Random(6)
    texts = ["  alpha   bet ", "", "gamma zzz é", "alphabet alpha beta"] + ["".join(rnd.choice("alphbetgm  ") for _ in range(40)) for _ in range(200)]
    ids = sentencepiece_codec.encode_texts(data, texts, verify_every=0)
    assert ids == reference.encode(texts) and sentencepiece_codec.decode_ids(data, ids) == reference.decode(ids)


@pytest.mark.parametrize("crossing", [False, True])
def test_codec_control_and_unused_pieces(crossing):
    """Texts that hold the names of control, unknown and unused pieces, with models whose pieces do or do not span words."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("ab", -0.1, 5), ("<u>", 0.0, 4)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(x, -1.0 - k / 7, 1) for k, x in enumerate(["▁", "a", "b", "<", "s", ">", "/", "▁a", "ba", *(["a▁b"] if crossing else [])])]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(3, 1) + field(4, 0))
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    rnd = random.Random(7)
    texts = ["<s> a </s>", "<unk>", "<u>ab<u>", "ab ab", "▁a", "a▁b", ""] + ["".join(rnd.choice(["a", "b", " ", "<s>", "</s>", "<u>", "é"]) for _ in range(30)) for _ in range(200)]
    assert sentencepiece_codec.encode_texts(data, texts) == reference.encode(texts)
    assert sentencepiece_codec.decode_ids(data, [[1, *x, 2] for x in reference.encode(texts)]) == reference.decode(reference.encode(texts))
    spelled = [[5 + b for b in "▁x▁".encode()]] * 2 + reference.encode(texts[:3])
    assert sentencepiece_codec.decode_ids(data, spelled) == reference.decode(spelled)


def test_html():
    page = """<!doctype html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>A &amp; B</h1><p>First&nbsp;<b>bold
    text</b> goes on<p>x<aside>side</aside><ul><li>one<li>two</ul><div class="ad">Buy</div><form><input>Mail</form><p>Last</article>
    <section id="comments"><article><p>A reader's long comment that goes on and on and on and on.</p></article></section><footer>foot</footer></body></html>"""
    assert html_extract.main_text(page) == "A & B\n\nFirst bold text goes on\n\nx\n\none\n\ntwo\n\nLast"
    assert [html_extract.main_text(x) for x in (None, "", "<p></p>", "<script>x", "plain &lt; text")] == ["", "", "", "", "plain < text"]


def test_html_without_article():
    long = "This paragraph belongs to the content and has a good many words in it. " * 3
    menu = "".join(f"<a href=/{k}>link {k}</a><br>" for k in range(9))
    page = f"<body><div>{menu}</div><div><h2>Head</h2><p>{long}</p><p>Short.</p><p>{long}</p></div><div>{menu}</div></body>"
    assert html_extract.main_text(page) == f"Head\n\n{long.strip()}\n\nShort.\n\n{long.strip()}"


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>"), (2, None, None), (1, "u", "<p>" * 5000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got == {(1, "a", 1), (2, "", 0), (1, "deep", 4)}


LONG_TEXT = "A long paragraph of prose that says one thing after another without any markup in between it all. " * 3
CASES = {
    "container classes": (f'<div class="wrapper header-fixed"><div class="content with-sidebar"><h1>T</h1><p>{LONG_TEXT}<p>Short.<p>{LONG_TEXT}</div><div class="sidebar"><p>aside one<p>aside two</div></div>', ["T", LONG_TEXT, "Short.", LONG_TEXT]),
    "page header as container": (f'<div class="wrapper header-fixed"><p>{LONG_TEXT}</div>', [LONG_TEXT]),
    "an advert in the article": (f'<article><h1>T</h1><p>{LONG_TEXT}<div class="advert">Buy now.</div><p>Tiny.<p>{LONG_TEXT}</article>', ["T", LONG_TEXT, "Tiny.", LONG_TEXT]),
    "a list of links without a class": (f"<article><p>{LONG_TEXT}<p>Tiny.<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>{LONG_TEXT}</article>", [LONG_TEXT, "Tiny.", LONG_TEXT]),
    "a dense paragraph of links": (f"<article><p>{LONG_TEXT}<p><a href=1>{LONG_TEXT}</a><p><a href=2>{LONG_TEXT}</a></article>", [LONG_TEXT] * 3),
    "long reader comments": (f'<p>{LONG_TEXT}<div id="comments">' + f"<p>{LONG_TEXT}" * 5 + "</div>", [LONG_TEXT]),
    "a body with links around": (f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><h2>Head</h2><p>{LONG_TEXT}<p>{LONG_TEXT}<div><a href=3>Three</a></div>", ["Head", LONG_TEXT, LONG_TEXT]),
    "an inline advert": (f'<article><p>{LONG_TEXT}<span class="ad">Buy</span></p><p>{LONG_TEXT}</article>', [LONG_TEXT, LONG_TEXT]),
}


@pytest.mark.parametrize("name", CASES)
def test_density_decides(name):
    html, want = CASES[name]
    assert html_extract.main_blocks(f"<html><body>{html}</body></html>") == [x.strip() for x in want]


def test_clusters_change_the_output(monkeypatch):
    """With every line taken for dense, links, adverts and surroundings come through, or containers go."""
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: np.ones(len(lines), bool))
    changed = {n for n, (html, want) in CASES.items() if html_extract.main_blocks(f"<html><body>{html}</body></html>") != [x.strip() for x in want]}
    assert changed >= {"a list of links without a class", "a body with links around"}


def test_extraction_against_pages_built_from_known_articles(spark):
    """Whole pages with menus, notices, sidebars, comments and forms around articles: the article's blocks come back, no more and no less."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for i in range(150):
        blocks = [prose(rnd.choice([1, 3, 30, 90])) for _ in range(rnd.randrange(3, 12))] + [prose(60)]
        links = "".join(f"<li><a href=/{word()}>{word()}</a>" for _ in range(6))
        junk = [f"<nav><ul>{links}</ul></nav>", f'<div class="cookie-notice"><p>{prose(8)}</p></div>', f'<aside><p>{prose(20)}</p></aside>', f"<form><label>{word()}</label><input></form>", f'<div class="ad-slot">{prose(6)}</div>', f"<script>var x = '<p>{prose(5)}</p>'</script>"]
        tail = [f'<section id="comments"><p>{prose(30)}</p><p>{prose(40)}</p></section>', f'<div class="related-posts"><ul>{links}</ul></div>', f"<footer>{prose(9)}</footer>"]
        body = f"<h1>{blocks[0]}</h1>" + "".join(rnd.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>"]).format(x) for x in blocks[1:])
        inside = f'<div class="share-buttons"><a href=#>{word()}</a></div>' if rnd.random() < 0.5 else ""
        rnd.shuffle(junk)
        rows.append((i, "u", "<html><body>" + "".join(junk[:4]) + f"<article>{body}{inside}</article>" + "".join(tail) + "</body></html>"))
        want[i] = "\n\n".join(blocks)
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def brute_topk(rows, k):
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i in {i for i, _ in ok if i % 20 == 0}:
        q = next(v for j, v in ok if j == i)
        best = sorted((-int(q @ v), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("spread", "block", "query_block"), [(0.0, 64, 7), (2.0, 50, 4), (2.0, 8192, 2048)])
def test_topk(spark, spread, block, query_block):
    r = np.random.default_rng(5)
    base = r.standard_normal((700, 12)) * np.exp(r.standard_normal((700, 1)) * spread)
    base[100:300] = base[100]  # ties
    base[400:410] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows[60] = (60, None)
    rows[80] = (80, [1.0] * 11 + [None])
    rows[81] = (81, [1.0] * 11 + [float("nan")])
    rows[82] = (82, [1.0] * 11 + [float("inf")])
    rows.append((1000, [1.0, 2.0]))
    rows.append((None, [1.0] * 12))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = topk_search.topk(df, F.col("id") % 20 == 0, block=block, query_block=query_block)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_topk(rows, 20)


@pytest.mark.parametrize("from_cosine", [-2.0, 0.0, 0.5, 9.0])
def test_topk_pruning_by_coordinate(monkeypatch, from_cosine):
    """Whichever queries are pruned by coordinate, a block gives the same answers."""
    monkeypatch.setattr(topk_search, "BY_COORDINATE", from_cosine)
    r = np.random.default_rng(8)
    c = np.floor(64 * r.standard_normal((900, 10)) * np.exp(r.standard_normal((900, 1))))
    q = np.floor(64 * r.standard_normal((60, 10)))
    q[7] = 0
    scores = (q @ c.T).astype(np.int64)
    ids = r.permutation(2000)[:900]
    for theta in (np.full(60, -np.inf), np.sort(scores, 1)[:, -5].astype(float), np.sort(scores, 1)[:, -40].astype(float), np.full(60, 1e9)):
        got = topk_search.search_block(q, np.arange(-60, 0), theta, c, ids, 5)
        got = {tuple(int(y) for y in x) for part in got for x in zip(*part, strict=True)}
        want = {(i - 60, int(ids[j]), int(scores[i, j])) for i in range(60) for j in np.lexsort((ids, -scores[i]))[:5] if scores[i, j] >= theta[i]}
        assert got == want


def test_topk_of_very_long_vectors_and_repeated_ids(spark):
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.standard_normal(3)]) for i in range(300)]
    for i, f in ((20, 1e30), (21, 1e30), (22, -1e30), (40, 3e7), (41, 5e8), (43, 1e200)):
        rows[i] = (i, [x * f for x in rows[i][1]])
    rows += [(60, [1.0, 2.0, 3.0]), (61, [50.0, 50.0, 50.0]), (61, [50.0, 50.0, 50.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(math.floor(64 * x)) for x in v]) for i, v in rows]
    packed = lambda v: np.array(v, float).tobytes()
    queries = {}
    for i, v in whole:
        if i % 20 == 0 and (i not in queries or packed(v) < packed(queries[i])):
            queries[i] = v
    want = set()
    for i, q in queries.items():
        found = sorted((-min(max(sum(a * b for a, b in zip(q, v, strict=True)), -(2**63) + 1), 2**63 - 1), j) for j, v in whole if j != i)
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found[:20])}
    for order in (df, df.orderBy(F.desc("vec_id")).coalesce(1)):
        got = topk_search.topk(order, F.col("id") % 20 == 0, block=40, query_block=4)
        assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == want


def test_topk_empty(spark):
    assert topk_search.topk(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 20 == 0).count() == 0


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


LONG = "This is a long paragraph of the main text which goes on and on for quite a while so that it is dense. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<div class='content'><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><article><p>A teaser card about something else.</p></article>", ["Title", LONG, LONG]),
        (f"<div><p>FIRST.</p><p>{LONG}</p><p>{LONG}</p><p>LAST.</p></div><div><p>Elsewhere.</p></div>", ["FIRST.", LONG, LONG, "LAST."]),
        (f"<article><h1>One</h1><p>{LONG}</p></article><article><h2>Two</h2><p>Short one.</p></article>", ["One", LONG, "Two", "Short one."]),
        (f"<p>{LONG}</p><div class='page comments-open'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [LONG] * 4),
        (f"<article><p>{LONG}</p></article><div class='comments'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [LONG]),
        (f"<div class='main'><p>{LONG}</p></div><div id='comment-list'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>", [LONG]),
        (f"<div class='ad'>{LONG}</div><article><p>Short news.</p></article>", ["Short news."]),
    ],
)
def test_no_text_is_lost(html, want):
    assert html_extract.main_blocks(f"<html><body>{html}</body></html>") == [x.strip() for x in want]

"""Token alignment, vector codes and packing against brute force, and on awkward tables."""

import hashlib
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.llm import packing, queries, token_alignment, vector_codes

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DIR = "/root/testdata/sf0.001"
ODD = [
    (1, "plain words, twice  spaced\tand tabbed\n"), (2, None), (3, ""), (4, " "), (5, "näïve café ☃ 漢字 🙂🙂"), (5, "näïve café ☃ 漢字 🙂🙂"), (6, "<|endoftext|> and <s> </s> <0x41>"),
    (7, "a marker ▁ inside"), (None, "no id"), (8, "lengthy " * 9000), (9, "é ­ zero​width \x00 nul"), (10, "antidisestablishmentarianism"),
]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).withColumn("chunk", F.lit("x")).withColumn("links", F.lit(1))


# --- byte-level ids


@pytest.mark.parametrize("literal", [False, True])
def test_ids_by_stretch_are_the_library_s(literal):
    from graphloom.llm.byte_level import ByteLevel

    with open(A_PATH, encoding="utf-8") as f:
        t = ByteLevel(f.read(), literal)
    rng = random.Random(7)
    pool = [*"ab1Z .,'\n\t\r\x0b\x1c\x85\u00a0\u2003\u3000\u200b\u0301é漢🙂—“ſ\x00s", "'s", "'ll", "  ", " \n", "\n ", "<|endoftext|>", " the", "ing", "x" * 80]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += [r["text"] or "" for r in pq.read_table(f"{DIR}/documents.parquet", columns=["text"]).to_pylist()][:100]
    for part in (texts, texts[::-1]):  # the second time most stretches are known
        assert all(x.tolist() == t.library.encode(y, add_special_tokens=False).ids for x, y in zip(t.ids(part), part, strict=True))


# --- alignment


def spelt():
    """Both tokenizers and the bytes of their ids, from their own tables."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    shown = {}
    level = decoders.ByteLevel()
    for cp in range(0x110000):  # the characters that a byte-level decoder reads as a single low byte, or keeps
        c = chr(cp)
        if cp < 0x200:
            shown[c] = level.decode([c]).encode()
    of = token_alignment.byte_alphabet()
    assert all(shown[c] == bytes([v]) for c, v in of.items() if v < 128)
    assert sorted(of.values()) == list(range(256))
    left = {k: bytes(of[c] for c in piece) for piece, k in a.get_vocab().items() if all(c in of for c in piece)}

    def right(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    return a, b, left, right


def groups_of(x, y):
    """Groups and links of two lists of (id, bytes), by comparing every token with every token near it."""
    def spans(tokens):
        at, out = 0, []
        for k, s in tokens:
            out.append((at, at + len(s), k))
            at += len(s)
        return out

    sx, sy = spans(x), spans(y)
    links = []
    for i, (b0, e0, k) in enumerate(sx):
        j = bisect_left([e for _, e, _ in sy], b0 + 1)
        while j < len(sy) and sy[j][0] < e0:
            links.append((k, sy[j][2]))
            j += 1
    cuts = sorted({e for _, e, _ in sx} & {e for _, e, _ in sy})
    out, low = [], 0
    for c in cuts:
        out.append("|".join(",".join(str(k) for b0, e0, k in s if low <= b0 and e0 <= c) for s in (sx, sy)))
        low = c
    return out, links


def alignment_by_hand(docs):
    a, b, left, right = spelt()
    rows, counts = [], Counter()
    for i, text in docs:
        x, y = [], []
        if text:
            x = [(k, left.get(k, b"")) for k in a.encode(" " + text, add_special_tokens=False).ids]
            y = [(k, right(k)) for k in b.encode(text)]
            if not b"".join(s for _, s in x) == b"".join(s for _, s in y) == (" " + text).encode():
                x, y = [], []
        if len(x) > 3000:
            groups, links = None, None
        else:
            groups, links = groups_of(x, y)
        rows.append((i, len(x), len(y), groups, links, x, y))
    return rows, counts


def small(text):
    return text if text is None or len(text) < 4000 else text[:4000]


@pytest.mark.parametrize("source", ["odd", "tables"])
def test_alignment_by_brute_force(spark, monkeypatch, source):
    if source == "odd":
        docs = [(i, small(t)) for i, t in ODD]
    else:
        docs = [(r["doc_id"], small(r["text"])) for r in pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()][:80]
    rows, _ = alignment_by_hand(docs)
    counts = Counter(link for r in rows for link in r[4])
    top = {}
    for (x, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    want = sorted(
        (
            (r[0] is None, r[0] or 0, r[1], r[2], len(r[3]), len(r[4]), sum(counts[k] == top[k[1]] for k in r[4]), sum(counts[k] for k in r[4]), hashlib.sha256(";".join(r[3]).encode()).hexdigest() if r[1] else "")
            for r in rows
        )
    )
    df = table(spark, docs).repartition(4)
    monkeypatch.setattr(token_alignment, "CHUNK", 5000)
    got = token_alignment.alignment(df, A_PATH, B_PATH, with_groups=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.n_a)
    zero = {r.doc_id for r in got if not r.n_a}
    assert source == "tables" or zero >= {2, 3, 7} and all(r.n_links == 0 and r.groups_sha256 == "" for r in got if not r.n_a)


def test_alignment_of_a_long_text_and_of_none(spark):
    long = "Many words, and more. " * 20000
    got = token_alignment.alignment(table(spark, [(1, long)]), A_PATH, B_PATH).first()
    assert got.n_links == got.n_a + got.n_b - got.n_groups and got.n_a > 80000  # tilings of one line share that many stretches
    assert token_alignment.alignment(table(spark, []), A_PATH, B_PATH).collect() == []
    assert token_alignment.alignment(table(spark, [(1, None)]), A_PATH, B_PATH).first().n_groups == 0


def test_union_find_on_random_graphs():
    rng = random.Random(3)
    for _ in range(60):
        n_a, n_b = rng.randint(1, 30), rng.randint(1, 30)
        edges = [(rng.randrange(n_a), rng.randrange(n_b)) for _ in range(rng.randint(0, 40))]
        got = token_alignment.components(n_a, n_b, np.array([x for x, _ in edges], np.int64), np.array([y for _, y in edges], np.int64))
        least = list(range(n_a + n_b))
        for _ in least:
            for x, y in edges:
                least[x] = least[n_a + y] = min(least[x], least[n_a + y])
        assert got.tolist() == least


# --- vector codes


def codes_by_hand(rows, entries, rounds, parts=4):
    kept = [(i, [int(np.floor(1024 * np.float64(c))) for c in v], label) for i, v, label in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda j: (dist(x, book[j]), j))
    for k in range(rounds + 1):
        code = [[nearest(part(v, p), books[p]) for p in range(parts)] for _, v, _ in kept]
        if k == rounds:
            break
        for p in range(parts):
            for j in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, code, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    errors = [sum(dist(part(v, p), books[p][c[p]]) for p in range(parts)) for (_, v, _), c in zip(kept, code, strict=True)]
    by = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] += e
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((i is None, i or 0, "".join(f"{x:02x}" for x in c), e, by[label], sha) for (i, _, label), c, e in zip(kept, code, errors, strict=True))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("of", F.lit(1))


@pytest.mark.parametrize("seed", range(4))
def test_codes_by_brute_force(spark, seed):
    """Coarse components, so that ties are many, copies, odd rows, and few or many entries."""
    rng = random.Random(seed)
    coarse = seed % 2 == 0
    one = lambda: [rng.randint(-3, 3) / 1024 if coarse else rng.gauss(0, 1) for _ in range(8)]
    some = [one() for _ in range(40)]
    rows = [(k // 2 if seed == 3 else k, rng.choice(some) if rng.random() < 0.5 else one(), rng.choice([0, 1, None])) for k in range(300)]
    rows += [(1000, None, 0), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 0), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (1004, [], 1), (None, one(), None)]
    rng.shuffle(rows)
    entries = [16, 64, 256, 32][seed]
    want = codes_by_hand([(i, None if v is None else [None if c is None else np.float32(c) for c in v], label) for i, v, label in rows], entries, 4)
    got = vector_codes.coded(vectors(spark, rows).repartition(5), entries=entries).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == want


def test_bounds_spare_scans_and_stay_true(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    state, books, _ = vector_codes.fitted(df, rounds=3)
    rows = state.collect()
    assert sum(r.scanned for r in rows) < len(rows)  # of four parts each
    for r in rows[:100]:
        for p in range(4):
            d = sorted(np.sqrt(((np.array(r.v).reshape(4, -1)[p] - books[p]) ** 2).sum(1)))
            assert r.up[p] >= d[0] and r.low[p] <= d[1]


def test_codes_of_odd_tables(spark):
    assert vector_codes.coded(vectors(spark, [])).collect() == []
    assert vector_codes.coded(vectors(spark, [(1, None, 1)])).collect() == []
    got = {r.vec_id: r for r in vector_codes.coded(vectors(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 4, 1), (3, [1.0] * 7, None)])).collect()}
    assert got[1].code == "00000000" and got[1].error == 0 and got[1].label_error == 0
    assert got[2].code is None and got[3].code is None and got[3].error is None
    big = vector_codes.coded(vectors(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.5] * 8, 2)]), entries=1).collect()
    assert len(big) == 3 and all(r.error >= 0 for r in big)


def test_decoding_gives_the_entries_back(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    _, books, _ = vector_codes.fitted(df)
    got = vector_codes.decoded(vector_codes.coded(df), books).collect()
    held = {r.vec_id: r.embedding for r in df.collect() if r.embedding is not None}
    for r in got[:50]:
        assert abs(sum((np.floor(1024 * np.float64(x)) - 1024 * y) ** 2 for x, y in zip(held[r.vec_id], r.vector, strict=True)) - r.error) < 1e-3


# --- packing


def plain_best_fit(lengths, window):
    room = []
    for n in sorted(lengths, reverse=True):
        k = bisect_left(room, n)
        insort(room, (room.pop(k) if k < len(room) else window) - n)
    return sorted(window - r for r in room)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 16, 100, 2048])
    lengths = [rng.randint(1, window) if rng.random() < 0.6 else rng.randint(1, max(1, window // 5)) for _ in range(rng.choice([1, 30, 2000]))]
    lengths += [rng.randint(1, window)] * rng.choice([0, 500])
    counts = Counter(lengths)
    rows, windows = packing.best_fit(counts, window)
    used, placed = {}, Counter()
    for length, first, n, sequence, each, at in rows:
        assert first == placed[length]
        placed[length] += n
        for i in range(n):
            used.setdefault(sequence + i // each, []).append((at + i % each * length, length))
    assert placed == counts and len(used) == windows
    for parts in used.values():
        end = 0
        for at, length in sorted(parts):
            assert at == end
            end += length
        assert end <= window
    assert sorted(sum(n for _, n in p) for p in used.values()) == plain_best_fit(lengths, window)


def test_tree_finds_the_tightest():
    tree, have = packing.Capacities(50), Counter()
    rng = random.Random(1)
    for _ in range(500):
        c = rng.randint(0, 50)
        d = 1 if rng.random() < 0.5 or not have[c] else -1
        tree.add(c, d)
        have[c] += d
        need = rng.randint(0, 50)
        assert tree.tightest(need) == min((k for k, n in have.items() if n and k >= need), default=None)


@pytest.mark.parametrize("source", ["odd", "tables"])
def test_packing(spark, source):
    from tokenizers import Tokenizer

    docs = ODD if source == "odd" else [(r["doc_id"], r["text"]) for r in pq.read_table(f"{DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    rows = packing.packed(table(spark, docs).repartition(5), A_PATH, with_ids=True)
    got = rows.collect()
    t = Tokenizer.from_file(A_PATH)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 1])) for i, x in docs)
    held = {}
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) and r.start + r.length <= r.doc_tokens
        held.setdefault(r.doc_id, []).append(r)
    back = Counter()
    for i, parts in held.items():
        by_start = {}
        for r in parts:
            by_start.setdefault(r.start, []).append(tuple(r.ids))
        if len(set(by_start.get(0, []))) < len(by_start.get(0, [])):  # a repeated row
            assert all(len(x) == 2 for x in by_start.values())
            back[i, sum((by_start[s][0] for s in sorted(by_start)), ())] += 2
        else:
            back[i, sum((by_start[s][0] for s in sorted(by_start)), ())] += 1
    assert back == want
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(r.length for r in got)
    assert sorted(sum(n for _, n in p) for p in used.values()) == plain_best_fit([r.length for r in got], 2048) and len(used) <= -(-total // 2048) * 1.03 + 1
    for r in packing.sequences(rows, pad=7).collect():
        assert len(r.ids) == 2048 or len(r.ids) == r.n_tokens and bin(r.n_tokens).count("1") == 1
        assert r.ids[r.n_tokens :] == [7] * (len(r.ids) - r.n_tokens)


def test_packing_of_no_rows(spark):
    assert packing.packed(table(spark, []), A_PATH).collect() == []


def test_registered(spark):
    for name, columns in {"op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_vector_codes": "vec_id code error label_error codebooks_sha256", "op13_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset"}.items():
        got = queries.QUERIES[name](spark, DIR)
        assert set(columns.split()) <= set(got.columns) and got.count() > 0

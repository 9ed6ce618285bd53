"""Exact dedup, n-gram join and sharding against brute force, and on awkward tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, ngram_jaccard, sharding

ODD = [
    (1, "a  b\tc", "en"), (2, "a b c", None), (3, None, "de"), (4, "", None), (5, " ", "en"), (5, " ", "en"),
    (6, "one two three four five six", "en"), (7, "ONE two\nthree four five six", "en"), (None, "a b c", "en"), (8, "x " * 30000, "fr"), (9, "four words are here", "en"), (10, "Four  words are HERE", "en"),
]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("keep_id", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("shard", F.lit("x"))


def norm(x):
    return re.sub(r"[\x20\x09-\x0D]+", " ", x or "")


def stored(df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    return df.sparkSession.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("key", [F.xxhash64, lambda c: F.length(c).cast("long") % 2])
def test_exact_dedup(spark, tmp_path, key):
    df = stored(table(spark), tmp_path)
    got = exact_dedup.exact_dedup(df, key=key, capacity=2, max_depth=6).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, x, _ in ODD:
        groups.setdefault(norm(x), []).append(i)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        g = by_sha[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(x for x in g if x is not None)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(df).collect()) == sorted(r.doc_id for r in kept)


def test_what_is_kept_does_not_depend_on_how_a_scan_is_split(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 300).alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 300).alias("text")).repartition(16)
    df = stored(df, tmp_path)
    name = "spark.sql.files.minPartitionNum"
    try:
        every, left = exact_dedup.exact_dedup(df), exact_dedup.drop_copies(df)
        before = df.rdd.getNumPartitions()
        spark.conf.set(name, "1")
        again = spark.read.parquet(str(tmp_path / "t"))
        assert again.rdd.getNumPartitions() != before
        assert every.where("kept").count() == 300
        assert sorted(r.doc_id for r in left.collect()) == list(range(300))
    finally:
        spark.conf.unset(name)


def test_directory_doubles_until_nothing_is_overfull(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    pages = exact_dedup.build_index(stored(df, tmp_path), capacity=100)
    sizes = pages.groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in sizes) == 3000 and max(r["count"] for r in sizes) <= 100
    assert len({r.bucket for r in sizes}) == len(sizes) > 30


def test_buckets_follow_the_keys(spark, tmp_path):
    """Every entry lies in the bucket that its key's leading bits name; a bucket's sibling would not fit into it."""
    df = stored(spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 900).alias("text")), tmp_path)
    pages = exact_dedup.build_index(df, capacity=60).collect()
    assert len(pages) == 900 and sum(r.group_size for r in pages) == 2000
    prefixes, sizes = {}, {}
    for r in pages:
        prefixes.setdefault(r.bucket, set()).add(((r.key % (1 << 64)) >> (64 - r.depth), r.depth))
        sizes[r.bucket] = sizes.get(r.bucket, 0) + 1
    assert all(len(x) == 1 for x in prefixes.values())
    by_prefix = {x.copy().pop(): sizes[b] for b, x in prefixes.items()}
    for (prefix, depth), n in by_prefix.items():
        sibling = by_prefix.get((prefix ^ 1, depth))
        assert sibling is None or sibling + n > 60
    # in the order of the keys
    assert [p << (64 - d) for _, x in sorted(prefixes.items()) for p, d in x] == sorted(p << (64 - d) for x in prefixes.values() for p, d in x)


def test_splitting():
    loads = [(s, 3, 30) for s in range(8)] + [(9, 50, 1), (15, 1, 10**9)]
    buckets, settled = exact_dedup.split(loads, 4, 10, 10**6)
    assert not settled  # slot 9 holds 50 keys and needs more bits
    assert (9, 4, 50, 1) in buckets and (15, 4, 1, 10**9) not in buckets and (3, 2, 1, 10**9) in buckets
    assert all(n <= 10 for p, d, n, b in buckets if (p, d) != (9, 4))
    assert sum(1 << (4 - d) for _, d, _, _ in buckets) == 16  # every slot has one bucket
    assert exact_dedup.split([], 4, 10, 10) == ([(0, 0, 0, 0)], True)


def test_answers_come_through_the_directory(spark, tmp_path, monkeypatch):
    df = stored(spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 200).alias("text")), tmp_path)
    assert exact_dedup.exact_dedup(df, capacity=20).where("kept").count() == 200
    real, calls = exact_dedup.routed, []

    def wrong(rows, slots, depth):
        calls.append(depth)
        if len(calls) % 2:
            return real(rows, slots, depth)
        return real(rows, slots.withColumn("page", F.col("page") + (F.col("bucket") % 2)), depth)  # half the slots lead elsewhere

    monkeypatch.setattr(exact_dedup, "routed", wrong)
    assert 0 < exact_dedup.exact_dedup(df, capacity=20).count() < 600
    # a split that sends one key to two buckets counts its rows twice
    monkeypatch.setattr(exact_dedup, "routed", real)
    honest = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (lambda t, d, n: (t.union(t.withColumn("page", F.col("page") + 1)), d, n + 1))(*honest(*a)))
    assert exact_dedup.exact_dedup(df, capacity=20).count() > 600


@pytest.mark.parametrize("hot", [4, 4096])
def test_hot_and_colliding_keys(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", hot)
    rows = [(i, f"text  {i % 7}" if i % 2 else "the same text") for i in range(300)] + [(None, "the same text")] * 40
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), tmp_path)
    for key in (F.xxhash64, lambda c: F.lit(5).cast("long"), lambda c: F.length(c).cast("long")):
        got = exact_dedup.exact_dedup(df, key=key, capacity=3, max_depth=5).collect()
        assert len(got) == 340 and {(r.keep_id, r.group_size) for r in got} == {(0, 190)} | {(min(i for i in range(1, 300, 2) if i % 7 == k), sum(1 for i in range(1, 300, 2) if i % 7 == k)) for k in range(7)}
        assert sorted(r.doc_id for r in got if r.kept) == sorted({r.keep_id for r in got})
        assert len({(r.bucket, r.chain_pos, r.text_sha256) for r in got}) == 8
    assert len({r.chain_pos for r in exact_dedup.exact_dedup(df, key=lambda c: F.lit(5).cast("long")).collect()}) == 8  # one chain


def test_empty(spark, tmp_path):
    df = stored(table(spark, []), tmp_path)
    assert exact_dedup.exact_dedup(df).count() == 0
    assert sharding.shard_plan(df).count() == 0
    assert ngram_jaccard.jaccard_components(df).count() == 0


def words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def brute(rows, n=5, percent=80):
    sets = {}
    for i, x in rows:
        w = words(x)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for p, a in enumerate(ids):
        for b in ids[p + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 20, 60, 120]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.choice([1, 2, 6])):
            x = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 9])):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            rows.append(" ".join(x).upper() if rnd.random() < 0.2 else "  ".join(x))
    rows += rows[:5] * 12 + ["", None]
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "block", "frequent"), [(1, 4096, 32), (2, 7, 3), (3, 3, 2)])
def test_jaccard_components(spark, seed, block, frequent):
    rows = near_copies(seed)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), list_block=block, frequent_from=frequent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_jaccard_odd_rows(spark):
    df = table(spark)
    got = {(r.doc_id, r.component_id, r.n_shingles) for r in ngram_jaccard.jaccard_components(df).collect()}
    assert {(1, 1, 1), (2, 1, 1), (3, 3, 0), (6, 6, 2), (7, 6, 2), (None, None, 1), (8, 8, 1), (9, 9, 1), (10, 9, 1)} <= got
    kept = ngram_jaccard.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 8, 9, None}


def test_jaccard_repeated_ids(spark):
    """Rows that share an id are compared each with its own text, whatever their order."""
    rnd = random.Random(21)
    a, b, c = ([f"{x}{rnd.randrange(500)}" for _ in range(40)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a, "more"])), (3, " ".join([*b, "more"])), (4, " ".join(c)), (5, " ".join(c)), (5, " ".join(c)), (6, "alone"), (7, ""), (7, "seven words that are not like the rest")]
    sizes = lambda x: max(1, len(words(x)) - 4) if words(x) else 0
    want = sorted((i, len({tuple(words(x)[k : k + 5]) for k in range(sizes(x))}), {1: 1, 2: 1, 3: 1, 5: 4}.get(i, i)) for i, x in rows)
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(1 + seed)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


@pytest.mark.parametrize("batch", [1, 7, 50, 5000])
def test_lists_are_cut_from_a_stream(batch):
    """Every pair of entries of a list meets: within a block, or in two blocks of the list."""
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(batch)
    entries, i = [], 0
    for token in range(-40, 40):
        for _ in range(rnd.choice([1, 1, 2, 3, 12, 60])):
            entries.append((token, i, rnd.randrange(5, 40), rnd.randrange(3)))
            i += 1
    entries.sort(key=lambda e: (e[0], e[2], e[3], e[1]))
    cols = [np.array(x) for x in zip(*entries, strict=True)]
    batches = (pa.RecordBatch.from_arrays([pa.array(c[k : k + batch]) for c in cols], names=["token", "id", "n", "pos"]) for k in range(0, len(entries), batch))
    got = {}
    for b in ngram_jaccard._lists(10, 80)(batches):
        for r in b.to_pylist():
            assert r["block"] not in got.setdefault(r["list"], {})
            got[r["list"]][r["block"]] = r
            assert len(r["ids"]) == len(r["sizes"]) == len(r["places"]) <= 40
    for token in range(-40, 40):
        own = {e[1]: (e[2], e[3]) for e in entries if e[0] == token}
        if len(own) == 1:
            assert token not in got
            continue
        blocks = got[token]
        assert sorted(blocks) == list(range(len(blocks))) and {r["several"] for r in blocks.values()} == {len(blocks) > 1 or any(r["several"] for r in blocks.values())}
        assert {x: y for r in blocks.values() for x, y in zip(r["ids"], zip(r["sizes"], r["places"], strict=True), strict=True)} == own


def test_signatures():
    """Sets of one size whose shingle hashes collide are still told apart by their bitmaps."""
    x, y = ngram_jaccard.shingles(b"a b c d e f g"), ngram_jaccard.shingles(b"a b c d e f h")
    a, b = ngram_jaccard._signature(x, ngram_jaccard.sketch(x)), ngram_jaccard._signature(x, ngram_jaccard.sketch(y))
    assert a[:16] == b[:16] and a != b and len(x) == len(y)


def test_bounds_never_refute_linked_sets():
    rnd = random.Random(5)
    for _ in range(200):
        a = [str(rnd.random()) for _ in range(rnd.choice([5, 40, 300, 3000]))]
        b = a[:]
        for _ in range(rnd.randrange(1 + len(a) // 20)):
            b[rnd.randrange(len(b))] = "x"
        x, y = (ngram_jaccard.shingles(" ".join(z).encode()) for z in (a, b + ["q"] * rnd.randrange(9)))
        import numpy as np

        d = len(np.setxor1d(x, y))
        assert ngram_jaccard.least_difference(ngram_jaccard.sketch(x), ngram_jaccard.sketch(y)) <= d


def test_shards(spark, tmp_path):
    df = stored(table(spark, ODD * 30), tmp_path)
    got = sharding.shard_plan(df, n_shards=7, bucket_bytes=4000).collect()
    again = sharding.shard_plan(df, n_shards=7, bucket_bytes=4000).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, len((x or "").encode()) + 8, zlib.crc32((x or "").encode())) for i, x, _ in ODD * 30)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    few = sharding.shard_plan(df.limit(5), n_shards=7).collect()
    assert len(few) == 5 and {r.slot for r in few} == {0} and len({r.shard for r in few}) == 5


def test_buckets_are_sized_by_whole_records(spark, tmp_path, monkeypatch):
    """Null texts beside a wide column, and nested columns: no bucket is over twice its size."""
    made = {}
    keep = sharding._written

    def kept(df, path, *by):
        out = keep(df, path, *by)
        made[path.rsplit("/", 1)[1].rsplit("-", 1)[0]] = out
        return out

    monkeypatch.setattr(sharding, "_written", kept)
    wide = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("w" * 2000), "id").alias("other"))
    nested = wide.select("doc_id", "text", F.array(F.struct(F.col("other").alias("x"))).alias("other"))
    for df in (wide, nested):
        assert sharding.shard_plan(stored(df, tmp_path / df.schema["other"].simpleString()[:9].replace(":", "")), n_shards=5, bucket_bytes=1 << 20).count() == 4000
        sizes = [r.n for r in made["shard-buckets"].select(F.octet_length(F.to_json(F.struct("_recs"))).alias("n")).collect()]
        assert len(sizes) >= 8 and max(sizes) <= 2 << 20
    monkeypatch.setattr(sharding, "MOST_BUCKETS", 4)
    with pytest.raises(ValueError, match="at most 4"):
        sharding.shard_plan(wide, bucket_bytes=1 << 20)


def test_shards_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 4)
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    order = [r.doc_id for r in sharding.shard_plan(df, n_shards=1, bucket_bytes=20000).orderBy("slot").collect()]
    assert sorted(order) == list(range(5000))
    up = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 2300 < up < 2700
    # every tenth of the ids is spread over every tenth of the places
    tenths = [[0] * 10 for _ in range(10)]
    for place, i in enumerate(order):
        tenths[i // 500][place // 500] += 1
    assert min(map(min, tenths)) > 20 and max(map(max, tenths)) < 90


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "en") for i in range(100)], "doc_id long, text string, lang string")
    sharding.write_shards(df, str(tmp_path / "out"), n_shards=4, bucket_bytes=1000)
    clash = df.withColumn("shard", F.lit("x")).withColumn("size", F.lit(None).cast("string")).withColumn("place", F.lit(1)).withColumn("_slot", F.lit(1)).withColumn("a.b", F.lit(2))
    sharding.write_shards(clash, str(tmp_path / "clash"), n_shards=4, bucket_bytes=1000)
    assert set(spark.read.parquet(str(tmp_path / "clash")).columns) == {"shard", "slot", "doc_id", "text", "lang", "doc_shard", "doc_size", "place", "_slot", "a.b"}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and set(back.columns) == {"shard", "slot", "doc_id", "text", "lang"}
    assert back.select("doc_id", "text").exceptAll(df.select("doc_id", "text")).count() == 0
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == dict.fromkeys(range(4), 25)
    # each file is in the order of its slots
    for part in (tmp_path / "out").rglob("*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(part)).select("slot").collect()]
        assert sum(a > b for a, b in zip(slots, slots[1:], strict=False)) <= 8


def test_shard_query_against_brute_force(spark, tmp_path):
    """The contract of the query, from its rows alone, on the whole small table."""
    from graphloom.llm import queries

    dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{dir}/documents.parquet").collect()}
    got = queries.op6_sharding(spark, dir).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(x) + 8, zlib.crc32(x), "rows", None) for i, x in docs.items()}
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(24) for k in range((s + 1) * len(docs) // 24 - s * len(docs) // 24)]


def test_second_count_reaches_as_far_as_prefixes():
    """Of a set with one frequent low shingle the count takes what its prefix can reach; where all low ones are frequent, the whole set."""
    text = " ".join(f"w{k}" for k in range(4000))
    s = ngram_jaccard.shingles(text.encode())
    low = ngram_jaccard._low_part(s, 80)
    batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])

    def taken(known):
        shared = type("Shared", (), {"value": np.sort(known)})
        return np.concatenate([b.column("token").to_numpy().view(np.uint64) for b in ngram_jaccard._counted(5, 80, shared)(iter([batch]))])

    some = taken(low[:1])
    assert ngram_jaccard.prefix_length(len(s)) < len(some) < len(s) / 3 and set(some) <= set(s)
    assert set(taken(low)) == set(s) and len(taken(s[-1:])) == 0
    for share in (0.1, 0.5, 0.7):  # frequent shingles that give way leave a prefix within reach
        gone = int(share * len(low))
        assert ngram_jaccard.reach(len(s), len(low), gone, 80) * (1 - share) >= min(ngram_jaccard.prefix_length(len(s)), len(s) * (1 - share))


def test_lists_of_the_same_sets_are_kept_once(spark, monkeypatch):
    rows, seen, real = near_copies(4), [], ngram_jaccard.written

    def written(df, name, *by):
        out = real(df, name, *by)
        if name == "jaccard-lists":
            seen.append(sorted(map(tuple, (r.ids for r in out.where("not several").select("ids").collect()))))
        return out

    monkeypatch.setattr(ngram_jaccard, "written", written)
    got = ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), frequent_from=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(seen) == 1 and len(seen[0]) > 10 and len(seen[0]) == len(set(seen[0]))


def test_lists_that_go_allow_no_pair_of_their_own(spark):
    """Of sets in one order, the lists that are kept allow the same pairs as all of them; blocks of long lists stay."""
    rnd = random.Random(8)
    sets = []
    for _ in range(12):
        base = rnd.sample(range(3000), rnd.randrange(20, 60))
        sets += [sorted({*rnd.sample(base, len(base) - rnd.randrange(6)), *rnd.sample(range(3000), rnd.randrange(6))}) for _ in range(6)]
    lists = {}
    for i, s in enumerate(sets):
        for pos, token in enumerate(s):
            lists.setdefault(token, []).append((len(s), pos, i))
    rows = [(t, 0, False, *([e[k] for e in sorted(x)] for k in (2, 0, 1))) for t, x in lists.items() if len(x) > 1]
    long = [(-1, k, True, *rows[0][3:]) for k in range(3)] + [(-2, 0, True, *rows[0][3:])]
    kept = ngram_jaccard._first_lists(spark.createDataFrame(rows + long, ngram_jaccard._LISTS).repartition(7)).collect()
    assert sorted((r.list, r.block) for r in kept if r.several) == [(-2, 0), (-1, 0), (-1, 1), (-1, 2)]
    plain = [tuple(r[x.split()[0]] for x in ngram_jaccard._LISTS.split(", ")) for r in kept if not r.several]
    assert set(map(repr, plain)) < set(map(repr, rows)) and len(plain) < len(rows) / 2

    def pairs(some):
        return {tuple(p) for _, _, _, ids, n, pos in some for p in ngram_jaccard.probe(np.array(ids), np.array(n), np.array(pos), np.array(ids)).tolist()}

    assert pairs(plain) == pairs(rows) and pairs(rows)

"""The trigram index against a search of all lines."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.operators import reads as R
from graphloom.operators import trigrams as TG

PATTERNS = ["needle", "Needle|thread", "(?i)NEEDLE", "ne+dle", "n.edle", "[a-z]{4}dle", "(foo|bar)baz", "foo(bar)?baz", "zzzq", "a", "ΟΔΟΣ", "İstanbul", "(?i)ΟΔΟΣ", r"\bword\b", r"\p{Lu}eedle", "[a&&[b]]needle", "x{3}y", "naïve", "🙂🙂🙂", "ab\ncd", "(?:needle){2}", "^needle$", "(?iu)needle", "needl(e|es)"]
WORDS = ["needle", "Needle", "thread", "foobaz", "foobarbaz", "barbaz", "word", "sword", "xxxy", "naïve", "🙂🙂🙂", "ΟΔΟΣ", "οδος", "İstanbul", "needleneedle", "NEEDLE", "nedle", "]needle", "bneedle", "\n", "needles"]


def documents(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        few = rng.sample(WORDS, 2) if rng.random() < 0.2 else []
        rows.append((f"d{i:04d}", rng.choice(["src/a", "src/b", "doc"]) + f"/{i}", " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(0, 40))) + " " + " ".join(few)))
    return [*rows, ("none", "doc/none", None), ("empty", "doc/empty", ""), ("twice", "doc/t", "needle"), ("twice", "doc/t", "thread"), ("long", "doc/l", "filler " * 20000 + "needle")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "ix")
    df = spark.createDataFrame(documents(400), "uid string, file_path string, text string")
    TG.build(df, path, block_bytes=5000)
    return path, df


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plain(df, pattern):
    hit = R.lines(df, "uid", "body", "text").where(F.col("line_text").rlike(pattern))
    return sorted((r.uid, r.line) for r in hit.collect())


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_rows_as_a_full_search(spark, index, pattern):
    path, df = index
    got = R.lines(TG.matching(spark, path, pattern), "uid", "body", "text").where(F.col("line_text").rlike(pattern))
    assert sorted((r.uid, r.line) for r in got.collect()) == plain(df, pattern)


def test_search_gives_columns_and_limit(spark, index):
    path, df = index
    assert rows(TG.search(spark, path, "needle")) == rows(R.regex_search(R.lines(df, "uid", "body", "text"), "needle"))
    assert len(TG.search(spark, path, "needle", limit=3).collect()) == 3
    few = R.scoped(TG.matching(spark, path, "needle"), "src/a")
    assert {r.file_path[:5] for r in few.collect()} == {"src/a"}


def files_scanned(df, part):
    """How many files of a table the scans of a result opened, by their own count."""
    query = df._jdf.queryExecution()
    query.executedPlan().executeCollect()
    todo, n = [query.executedPlan()], 0
    while todo:
        plan = todo.pop()
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            if name == "FileSourceScanExec" and part in plan.simpleString(1000):
                n += plan.metrics().apply("numFiles").value()
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return n


def test_files_read_fall_with_selectivity(spark, index):
    path, df = index
    read = {p: files_scanned(TG.matching(spark, path, p), "/texts") for p in ("alpha", "xxxy", "zzzq", "[ab]")}
    held = df.where(F.col("text").contains("xxxy")).count()
    assert read["[ab]"] >= 15 and 0 < read["xxxy"] <= held < read["alpha"] and read["zzzq"] == 0, (read, held)


def test_a_rare_trigram_reads_few_row_groups(spark, index):
    path, _ = index
    posting = spark.read.parquet(f"{path}/postings").where(F.col("trigram") == TG.code("xxx"))
    assert "PushedFilters: [IsNotNull(trigram), EqualTo(trigram," in posting._jdf.queryExecution().toString()


def test_upsert_replaces_removes_and_adds(spark, tmp_path):
    path = str(tmp_path / "ix")
    held = {u: (u, f, t) for u, f, t in documents(120, 2) if u != "twice"}
    make = lambda d: spark.createDataFrame(list(d), "uid string, file_path string, text string")
    TG.build(make(held.values()), path, block_bytes=2000)
    rng = random.Random(4)
    for step in range(3):
        changed = {u: (u, f"new/{step}", "needle " * rng.randint(0, 2) + rng.choice(WORDS)) for u in rng.sample(sorted(held), 15)} | {f"n{step}": (f"n{step}", "new", "brand new zzzq")}
        gone = rng.sample(sorted(set(held) - set(changed)), 5)
        held = {u: x for u, x in (held | changed).items() if u not in gone}
        before = {f for f in spark.read.parquet(f"{path}/texts").inputFiles()}
        TG.upsert(spark, path, make(changed.values()), spark.createDataFrame([(u,) for u in gone], "uid string"), block_bytes=2000)
        after = set(spark.read.parquet(f"{path}/texts").inputFiles())
        assert before <= after and 1 <= len(after - before) <= 3  # only the changes are written
        assert rows(TG.live(spark, path).select("uid", "file_path", "text").where("text is not null")) == sorted(x for x in held.values() if x[2] is not None)
        for p in ("needle", "zzzq", "thread|foobaz", "[ab]"):
            assert rows(TG.search(spark, path, p)) == rows(R.regex_search(R.lines(make(held.values()), "uid", "body", "text"), p)), p
    want = {}
    for _, _, t in held.values():
        low = (t or "").lower()
        for g in {low[i : i + 3] for i in range(len(low) - 2)}:
            want[g] = want.get(g, 0) + 1
    got = {r.trigram: r.documents for r in TG.frequencies(spark, path).collect()}
    assert {k: v for k, v in got.items() if k.isascii()} == {k: v for k, v in want.items() if k.isascii()}


def test_readers_do_not_see_what_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "ix")
    make = lambda d: spark.createDataFrame(d, "uid string, text string")
    TG.build(make([("a", "needle"), ("b", "other")]), path)
    # a writer that dies before its commit has left texts and the marks of what it replaces
    late = make([("a", "nothing")]).withColumns({"ord": F.lit(0), "gen": F.lit(1), "block": F.lit(1 << 32)})
    late.write.mode("append").partitionBy("gen", "block").parquet(f"{path}/texts")
    TG.live(spark, path).where("uid = 'a'").select("block", "ord", F.lit(1).alias("gen")).write.mode("append").partitionBy("gen").parquet(f"{path}/dead")
    assert [r.uid for r in TG.search(spark, path, "needle").collect()] == ["a"]


def test_required_trigrams_never_lose_a_match():
    rng = random.Random(9)
    for _ in range(400):
        parts = [rng.choice(["abc", "d", "(ef|gh)", "i+", "j*", "[kl]", "(?:mno)?", "p{2}", ".", "qrs", "é", "(?i:TU)"]) for _ in range(rng.randint(1, 6))]
        pattern = "".join(parts)
        clauses = TG.required(pattern)
        text = "".join({"(ef|gh)": "gh", "i+": "ii", "j*": "", "[kl]": "l", "(?:mno)?": "", "p{2}": "pp", ".": "X", "(?i:TU)": "tU"}.get(p, p) for p in parts)
        assert re.search(pattern, text)
        low = text.lower()
        have = {low[i : i + 3] for i in range(len(low) - 2)}
        assert clauses is None or any(c <= have for c in clauses), (pattern, text, clauses)


def test_an_empty_index(spark, tmp_path):
    path = str(tmp_path / "ix")
    TG.build(spark.createDataFrame([], "uid string, text string"), path)
    assert TG.search(spark, path, "needle").collect() == [] and TG.search(spark, path, "[ab]").collect() == []


def test_a_worker_holds_few_texts_at_once(monkeypatch):
    """One batch of many texts is cut by their bytes, and a long text into windows; nothing is lost."""
    monkeypatch.setattr(TG, "CHUNK", 10_000)
    texts = ["é" * (k % 900) + f"text {k}" for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["ord", "low"])
    parts = list(TG._chunks(iter([batch, batch.slice(0, 0), batch.slice(5, 3)])))
    assert [x for t in parts for x in t.column("low").to_pylist()] == texts + texts[5:8]
    assert max(sum(len(x.encode()) for x in t.column("low").to_pylist()) for t in parts) < 3 * TG.CHUNK and len(parts) > 50
    long = "".join(random.Random(3).choices("abcdefgé🙂", k=5000))
    whole = TG.codes(long)
    for window in (3, 4, 1000, 4998, 4999):
        monkeypatch.setattr(TG, "WINDOW", window)
        assert (TG.codes(long) == whole).all()

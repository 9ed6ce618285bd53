"""File contents by way of the data source: folders and commits, loose and packed."""

import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from graphloom.sources import content


def git(where, *args):
    env = os.environ | {f"GIT_{x}_{y}": v for x in ("AUTHOR", "COMMITTER") for y, v in (("NAME", "t"), ("EMAIL", "t@example.org"), ("DATE", "2024-01-01T00:00:00Z"))} | {"GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(where), *args], check=True, capture_output=True, text=True, env=env).stdout


FILES = {
    "a.py": "print(1)\n", "src/b.py": "x" * 5000, "src/deep/c.md": "# c\n", "src/deep/d.py": "", "other/e.py": "e", "other/f.bin": "f\0g", "node_modules/g.py": "skipped",
    "logs/h.log": "ignored", "logs/keep.log": "kept", "src/é name.py": "ü\n", "out/i.py": "ignored folder", "src/tmp1.txt": "ignored", "tmp1.txt": "kept: the rule is anchored",
}
IGNORES = {".gitignore": "# a comment\n*.log\n!keep.log\nout/\n/src/tmp?.txt\n"}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in (FILES | IGNORES).items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    git(root, "init", "-q", "-b", "main")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    (root / "broken.py").symlink_to(root / "nowhere")
    return root


@pytest.fixture(autouse=True)
def registered(spark):
    content.register(spark)


def load(spark, root, **options):
    return spark.read.format("content").options(**options).load(str(root))


def kept():
    return {p: t for p, t in (FILES | IGNORES).items() if p not in ("node_modules/g.py", "logs/h.log", "out/i.py", "src/tmp1.txt")}


def test_working_tree(spark, tree):
    got = {r.path: r for r in load(spark, tree).collect()}
    assert {p: bytes(r.content) for p, r in got.items()} == {p: t.encode() for p, t in kept().items()}
    assert all(r.size == len(r.content) and r.sha is None and r.modified is not None for r in got.values())
    assert {r.path for r in load(spark, tree, skip="nothing,.git").collect()} == set(kept()) | {"node_modules/g.py"}
    assert git(tree, "ls-files", "-co", "--exclude-standard", "-z").replace("broken.py\0", "").count("\0") == len(kept()) + 1


def test_commit_loose_and_packed(spark, tree, tmp_path):
    tracked = {p: t for p, t in (FILES | IGNORES).items() if p in set(git(tree, "ls-files", "-z").split("\0")) and not p.startswith("node_modules")}
    (tree / "a.py").write_text("changed after the commit")
    try:
        got = {r.path: r for r in load(spark, tree, commit="main").collect()}
        assert {p: bytes(r.content).decode() for p, r in got.items()} == tracked
        assert all(r.modified is None and r.sha == git(tree, "rev-parse", f"main:{p}").strip() for p, r in got.items())
    finally:
        (tree / "a.py").write_text(FILES["a.py"])
    bare = tmp_path / "bare.git"
    git(tmp_path, "clone", "-q", "--bare", str(tree), str(bare))
    git(bare, "gc", "-q", "--prune=now")
    assert [x for x in os.listdir(bare / "objects") if len(x) == 2] == []
    for name in ("HEAD", "main", git(tree, "rev-parse", "HEAD").strip()):
        assert {r.path: bytes(r.content).decode() for r in load(spark, bare, commit=name).collect()} == tracked


def test_packs_with_deltas_and_history(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    git(root, "init", "-q", "-b", "main")
    rng = random.Random(1)
    lines = [f"line {i} {rng.random()}\n" for i in range(3000)]
    states = {}
    for k in range(6):
        for _ in range(30):
            lines[rng.randrange(len(lines))] = f"edit {rng.random()}\n"
        (root / "big.txt").write_text("".join(lines))
        (root / f"f{k}.txt").write_text(str(k))
        git(root, "add", "-A")
        git(root, "commit", "-qm", str(k))
        states[git(root, "rev-parse", "HEAD").strip()] = ("".join(lines), k + 2)
    git(root, "tag", "-a", "v1", "-m", "tagged")
    git(root, "gc", "-q", "--aggressive")
    assert "chain length" in git(root, "verify-pack", "-v", *[str(p) for p in (root / ".git/objects/pack").glob("*.idx")])
    for sha, (text, n) in states.items():
        got = {r.path: bytes(r.content).decode() for r in load(spark, root, commit=sha).collect()}
        assert got["big.txt"] == text and len(got) == n
    assert load(spark, root, commit="v1").count() == 7
    with pytest.raises(Exception, match="has no nothing"):
        load(spark, root, commit="nothing").count()


def test_filters_reach_the_planning(spark, tree):
    def planned(*filters, **options):
        r = content.ContentReader({"path": str(tree), **options})
        rest = list(r.pushFilters(list(filters)))
        return sorted(row[0] for p in r.partitions() for row in p.rows), rest

    path = ("path",)
    assert planned(StringStartsWith(path, "src/"), StringEndsWith(path, ".py")) == (["src/b.py", "src/deep/d.py", "src/é name.py"], [])
    assert planned(EqualTo(path, "src/b.py")) == (["src/b.py"], []) and planned(In(path, ("a.py", "none"))) == (["a.py"], [])
    assert planned(EqualTo(("size",), 3))[1] == [EqualTo(("size",), 3)]
    df = load(spark, tree).where(F.col("path").startswith("src/") & F.col("path").endswith(".py") & (F.col("size") > 100))
    assert [r.path for r in df.collect()] == ["src/b.py"]
    assert [r.path for r in load(spark, tree).where("path like 'src/deep/%' and path like '%.md'").collect()] == ["src/deep/c.md"]


def test_what_is_not_asked_for_is_not_opened(spark, tree, tmp_path):
    """Objects and folders outside the filters are damaged; a read that opened them would fail."""
    bare = tmp_path / "bare.git"
    git(tmp_path, "clone", "-q", "--bare", "--no-hardlinks", str(tree), str(bare))
    for spec in ("main:other", "main:a.py", "main:src/deep"):
        sha = git(tree, "rev-parse", spec).strip()
        file = bare / "objects" / sha[:2] / sha[2:]
        file.chmod(0o644)
        file.write_bytes(b"damaged")
    got = load(spark, bare, commit="main").where("path like 'src/%'")
    assert [r.path for r in got.where(F.col("path").endswith("b.py") & ~F.col("path").contains("deep")).where("path = 'src/b.py'").collect()] == ["src/b.py"]
    with pytest.raises(Exception, match="incorrect header"):
        load(spark, bare, commit="main").count()


def test_partitions_follow_sizes(spark, tree, tmp_path):
    for k in range(40):
        (tmp_path / f"{k:02}.txt").write_text("x" * 1000)
    (tmp_path / "large.txt").write_text("y" * 50000)
    df = load(spark, tmp_path, partitionBytes=5000, maxBytes=40000)
    assert df.rdd.getNumPartitions() == 9
    got = {r.path: r for r in df.collect()}
    assert len(got) == 41 and got["large.txt"].content is None and got["large.txt"].size == 50000
    r = content.ContentReader({"path": str(tree), "commit": "main", "partitionFiles": "3"})
    assert max(len(p.rows) for p in r.partitions()) == 3


def test_texts_leave_binaries_out(spark, tree):
    got = {r.path: r.text for r in content.texts(load(spark, tree)).collect()}
    assert "other/f.bin" not in got and got["src/é name.py"] == "ü\n"


def test_an_empty_tree(spark, tmp_path):
    assert load(spark, tmp_path).collect() == []

"""Shaping of context lists, traces, projects and small helpers."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import conventions as C
from graphloom.operators import derive as D
from graphloom.operators import graph as GR
from graphloom.operators import notes as N
from graphloom.operators import retrieval as RT
from graphloom.plans import answers as P
from graphloom.sources import sinks


def scored(spark, *rows):
    return spark.createDataFrame(list(rows), "uid string, score double")


def test_context_shaping(spark):
    r = scored(spark, ("a", 3.0), ("b", 2.0), ("c", 1.0))
    assert {x.uid: x.position for x in N.promote_members(r, scored(spark, ("c", 0.0))).collect()} == {"c": 1, "a": 2, "b": 3}
    links = spark.createDataFrame([("n", "b", 0.5), ("n", "c", 0.9), ("m", "a", 1.0)], "src string, dst string, confidence double")
    assert {x.uid: x.position for x in N.pin_code_links(r, links, ["n"]).collect()} == {"c": 1, "b": 2, "a": 3}
    twins = spark.createDataFrame([("h", "n", 1, 0.5), ("s", "n", 1, 0.7), ("t", "n", 2, 0.1)], "uid string, note_uid string, line int, score double")
    assert {x.uid for x in N.drop_heading_twins(twins).collect()} == {"s", "t"}
    assert [(x.kind, x.uid) for x in N.landmarks(1, k=r).collect()] == [("k", "a")]


def test_traces(spark):
    t = spark.createDataFrame([("a", None, "local"), ("b", "a", "far"), ("c", "a", "local")], "uid string, parent string, repo_uid string")
    assert [x.uid for x in N.trace_boundaries(t, ["local"]).collect()] == ["b"]
    remote = spark.createDataFrame([("x", None, "far"), ("y", "x", "far")], "uid string, parent string, repo_uid string")
    assert {(x.uid, x.parent, x.tier) for x in N.stitch(t, remote, "b").collect()} == {("a", None, "local"), ("b", "a", "local"), ("c", "a", "local"), ("x", "b", "server"), ("y", "x", "server")}


def test_repositories(spark):
    repos = spark.createDataFrame([("r1", "App", "https://h.org/o/app.git"), ("r2", "lib", "git@h.org:o/lib.git"), ("r3", "Lib", "https://h.org/p/lib")], "uid string, name string, url string")
    assert N.resolve_repositories(repos, ["app", "ssh://git@h.org/o/lib"]) == ["r1", "r2"]
    for bad in ("lib", "none"):
        with pytest.raises(ValueError):
            N.resolve_repositories(repos, [bad])
    links = spark.createDataFrame([("app", "git.example", "uses"), ("app", "r2", "uses")], "from_repo string, to_repo string, link_type string")
    assert [(x.src, x.dst) for x in D.declared_links(links, repos).collect()] == [("r1", "r2")]


def test_conventions(spark):
    rows = [("python", "main", "a/app.py", "", "function"), ("typescript", "useThing", "src/hooks/x.ts", "", "function"), ("go", "UserHandler", "h.go", "", "function"), ("rust", "x", "l.rs", "#[tokio::test]", "function"), ("java", "x", "UserController.java", "", "class"), ("sql", "main", "a.sql", "", "x"), ("typescript", "loader", "a.ts", None, "function")]
    df = spark.createDataFrame(rows, "l string, n string, p string, s string, k string")
    got = [r[0] for r in df.select(C.entry_point_kind(*[F.col(c) for c in "lnpsk"])).collect()]
    assert got == ["Main", "EventListener", "HttpHandler", "TestEntry", "HttpHandler", None, None]
    sev = spark.createDataFrame([("f(a)", "f(a, b=1)", "x.py"), ("f(a)", "f(a, b)", "x.py"), ("f(a)", "f(a, b=1)", "x.rs"), ("f(a, b)", "f(b, a)", "x.py"), ("f(a: int)", "f(a: str)", "x.py"), ("f(a: int)", "f(a: str)", "x.go"), ("f(a)", "f(b)", "x.py"), ("f(a) int", "f(a) str", "x.go"), ("f(a, b)", "f(a)", "x.py")], "a string, b string, p string")
    assert [r[0] for r in sev.select(C.signature_severity(F.col("a"), F.col("b"), F.col("p"))).collect()] == ["info", "breaking", "breaking", "breaking", "warning", "breaking", "breaking", "warning", "breaking"]


def test_query_parser():
    q = RT.parse_query('+must title:Head "two words" a AND b c')
    assert q["must"] == {"must", "a", "b"} and q["phrases"] == ["two words"] and q["fields"] == {"head": "title"} and "c" in q["terms"]
    assert RT.parse_query("(((")["terms"] == {}


def test_bodies_and_code_edges(spark):
    s = spark.createDataFrame([("u", "f.py", 2, 3), ("v", "f.py", 9, 9)], "uid string, file_path string, start_line long, end_line long")
    f = spark.createDataFrame([("f.py", "one\ntwo a\nthree\nfour")], "file_path string, text string")
    assert {r.uid: r.body for r in P.symbol_bodies(s, f, 3).collect()}["u"] == "two a\nthree"
    sym = spark.createDataFrame([("a", "x", "r"), ("b", "y", "r"), ("m", "<module>", "r"), ("o", "z", "q")], "uid string, name string, repo_uid string")
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5), ("b", "a", "CALLS", None), ("a", "m", "CALLS", 1.0), ("a", "o", "CALLS", 1.0)], "src string, dst string, rel string, confidence double")
    assert [tuple(r) for r in GR.code_edges(sym, e, ["r"]).collect()] == [("a", "b", 1.5)]


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("a", "A", "Class"), ("b", "B", "Class")], "uid string, name string, kind string")
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5)], "src string, dst string, rel string, confidence double")
    for kind in ("cypher", "graphml", "mermaid", "json", "parquet"):
        sinks.export(n, e, str(tmp_path / kind), kind, scored(spark, ("a", 1.0), ("b", 2.0)))
    with pytest.raises(ValueError):
        sinks.export(n, e, "x", "msgpack2")
    j = str(tmp_path / "journal")
    row = "uid string, seq int, embedding array<double>, deleted boolean"
    for k in range(5):
        sinks.append_journal(spark.createDataFrame([("v", k, [float(k)], False)], row), j)
    assert sinks.compact_journal(spark, j, str(tmp_path / "live"), 2.0) and not sinks.compact_journal(spark, j, str(tmp_path / "no"), 9.0)
    assert spark.read.parquet(str(tmp_path / "live")).first().embedding == [4.0]
    assert sinks.load_weights('{"version": 1, "weights": {"doc": 0.5}}') == {"doc": 0.5}
    assert sinks.load_weights('{"version": 2, "weights": {}}') is None and sinks.load_weights("{") is None


def test_taxonomy_and_features(spark):
    t = N.taxonomy(spark.createDataFrame([("t.md", "auth -> Authentication\nno arrow\n -> x\nsso -> Login")], "path string, text string"))
    assert {(r.alias, r.canonical) for r in t.collect()} == {("auth", "Authentication"), ("sso", "Login")}
    s = spark.createDataFrame([("u1", "r", "a"), ("u2", "q", "a")], "uid string, repo_uid string, name string")
    assert [r.uid for r in N.feature_seeds(s, [("q", "a")]).collect()] == ["u2"]

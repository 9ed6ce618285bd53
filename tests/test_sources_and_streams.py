"""Parsers, writers and streaming against small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.sources import parsers, sinks
from graphloom.streaming import ingest


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


NOTE = """---
title: My Note
tags: [alpha, "beta/x"]
refs:
  - One
  - Two
---
# Head
Body with [[Other#part|shown]] and #tag/sub and `[[not]]`.
%% [[hidden]] %%
## Second part
```py
# not a heading
load_table()
```
See ![[image.png]] and loadTable here, or `save_all()`.
"""


def test_markdown(spark):
    rows = parsers.markdown(files(spark, ("d/n.md", NOTE), ("e.md", ""))).collect()
    got = {(r.kind, r.name) for r in rows if r.path == "d/n.md"}
    assert {("title", "My Note"), ("heading", "Head"), ("heading", "Second part"), ("wikilink", "Other#part"), ("wikilink", "image.png"), ("tag", "alpha"), ("tag", "beta/x"), ("tag", "tag/sub"), ("frontmatter", "refs")} <= got
    assert not any(n in ("not", "hidden", "not a heading") for _, n in got)
    assert {r.line for r in rows if r.kind == "heading" and r.path == "d/n.md"} == {8, 11}
    assert [(r.kind, r.name) for r in rows if r.path == "e.md"] == [("title", "e")]
    names = {(r.name, r.extra) for r in parsers.code_mentions(files(spark, ("n.md", NOTE))).collect()}
    assert {("load_table", "code"), ("loadTable", "prose"), ("save_all", "span")} <= names


def test_diagrams(spark):
    n, e = parsers.canvas(files(spark, ("c", '{"nodes":[{"id":"1","type":"file","file":"a.md"},{"id":"2","type":"text","text":"hi"}],"edges":[{"id":"e","fromNode":"1","toNode":"2"}]}'), ("bad", "{")))
    assert n.count() == 2 and e.first().toNode == "2"
    m = parsers.mermaid(files(spark, ("m", "graph TD\nA[Start] --> B\nB -->|yes| C --> D")))
    assert {(r.src, r.dst, r.label) for r in m.collect()} == {("A", "B", ""), ("B", "C", "yes"), ("C", "D", "")}
    d = parsers.dataview(files(spark, ("d", 'TABLE file.name, due\nFROM "proj" and #x\nWHERE !done\nSORT due'), ("x", "SELECT 1"))).collect()
    assert [(r.kind, r.fields, r.source, r.condition) for r in d] == [("TABLE", "file.name, due", '"proj" and #x', "!done")]
    h = files(spark, ("h", "<html><head><title>x</title></head><body><h2>T</h2><p>a <b>b</b> &amp; <a href=\"u\">c</a></p><ul><li>x</li></ul></body></html>"))
    assert h.select(parsers.html_to_markdown("text")).first()[0] == "## T\n\na **b** & [c](u)\n\n- x"
    assert h.select(parsers.looks_like_html("text")).first()[0]


def test_specifications(spark):
    api = '{"openapi":"3.0.0","paths":{"/v1/users/{id}":{"get":{"operationId":"getUser","parameters":[{"name":"id","in":"path","required":true,"schema":{"type":"string"}}]},"post":{"operationId":"p"}}}}'
    assert {(r.verb, r.route, r.operation_id) for r in parsers.openapi(files(spark, ("a.json", api))).collect()} == {("GET", "/v1/users/{}", "getUser"), ("POST", "/v1/users/{}", "p")}
    assert [(r.operation, r.location, r.name, r.type, r.required) for r in parsers.openapi_parameters(files(spark, ("a.json", api))).collect()] == [("GET /v1/users/{}", "path", "id", "string", True)]
    pb = files(spark, ("a.proto", "package x.v1;\nservice Users {\n rpc Get(A) returns (B) { option a = 1; }\n rpc Put(A) returns (B);\n}\nservice O { rpc Z(A) returns (B); }"))
    assert {(r.service, r.method) for r in parsers.proto(pb).collect()} == {("x.v1.Users", "Get"), ("x.v1.Users", "Put"), ("x.v1.O", "Z")}
    gq = files(spark, ("s.graphql", "type Query {\n user(id: ID!): User\n all: [User]\n}\ntype User { name: String }\ntype Mutation { add(x: Int): User }"))
    assert {(r.root, r.field) for r in parsers.graphql(gq).collect()} >= {("Query", "user"), ("Query", "all")}
    mf = parsers.manifests(files(spark, ("p/package.json", '{"name":"p","dependencies":{"a":"1"},"devDependencies":{"b":"1"}}'), ("c/Cargo.toml", '[package]\nname = "c"\n[dependencies]\nserde = "1"\n'), ("g/go.mod", "module m.org/g\nrequire a.org/b v1\n"), ("requirements.txt", "numpy==1\n")))
    assert {(r.package, r.dependency) for r in mf.collect()} == {("p", "a"), ("p", "b"), ("c", "serde"), ("m.org/g", "a.org/b"), ("", "numpy")}
    log = spark.createDataFrame([("r", "a" * 40 + " 100\nx.py\ny.py\n\n" + "b" * 40 + " 1970-01-01T00:03:20Z\nx.py\n")], "repo string, text string")
    assert {(r.commit_id[0], r.epoch, r.file) for r in parsers.git_log(log).collect()} == {("a", 100.0, "x.py"), ("a", 100.0, "y.py"), ("b", 200.0, "x.py")}


def test_whole_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# X\n\ntext")
    (tmp_path / "y.txt").write_text("no")
    got = parsers.whole_files(spark, str(tmp_path), "*.md").collect()
    assert [r.text for r in got] == ["# X\n\ntext"]


def test_exports_and_snapshots(spark, tmp_path):
    n = spark.createDataFrame([("a", "it's <x>", "Class"), ("b", "B", "Class")], "uid string, name string, kind string")
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5)], "src string, dst string, rel string, confidence double")
    assert "it\\'s" in sinks.cypher(n, e).where("uid = 'a'").first().line
    sinks.write_graphml(n, e, str(tmp_path / "g"))
    import xml.etree.ElementTree as ET

    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g")).collect())
    root = ET.fromstring(text.replace('<?xml version="1.0" encoding="UTF-8"?>', ""))
    assert len(root.findall(".//{*}node")) == 2 and len(root.findall(".//{*}edge")) == 1
    sinks.write_snapshot(str(tmp_path / "s"), nodes=n, edges=e)
    assert all(r.ok for r in sinks.verify_snapshot(spark, str(tmp_path / "s")).collect())
    n.limit(1).write.mode("overwrite").parquet(str(tmp_path / "s" / "nodes"))
    assert {r.name: r.ok for r in sinks.verify_snapshot(spark, str(tmp_path / "s")).collect()} == {"nodes": False, "edges": True}
    p = str(tmp_path / "parts")
    t = spark.createDataFrame([(1, "a"), (2, "b")], "x int, repo string")
    sinks.replace_partitions(t, p, "repo")
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "x int, repo string"), p, "repo")
    assert {(r.x, r.repo) for r in spark.read.parquet(p).collect()} == {(1, "a"), (9, "b")}
    ids, es = sinks.indexed(n, e)
    assert {(r.uid, r.id) for r in ids.collect()} == {("a", 0), ("b", 1)} and es.first().dst_id == 1
    hit = spark.createDataFrame([("a", "r", "f.py", 3, "breaking", 0.9), ("b", "r", "g.py", 4, "info", 0.1)], "uid string, repo_uid string, file_path string, start_line long, severity string, impact_score double")
    assert sinks.impact_comment(hit).first().comment.splitlines()[1].startswith("- **breaking** `a`")
    assert '"level":"error"' in sinks.sarif(hit).where("uid = 'a'").first().result


def stream(spark, tmp_path, rows, schema, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp, session string, uid string, kind string"


def events(n=200):
    import random

    rnd = random.Random(8)
    return [(i, T0 + dt.timedelta(seconds=rnd.randrange(2000)), rnd.choice("st"), rnd.choice("uv"), rnd.choice(["access", "shown", "seed"])) for i in range(n)]


def test_follow_ups_stream_equals_batch(spark, tmp_path):
    batch = {(r.event_id, r.uid, round(r.gap, 6)) for r in A.follow_ups(spark.createDataFrame(events(), EVENT)).collect()}
    got = {(r.event_id, r.uid, round(r.gap, 6)) for r in run(ingest.follow_up_stream(stream(spark, tmp_path, events(), EVENT, "e")), "fu")}
    assert got == batch and batch


def test_counts_stream_equals_batch(spark, tmp_path):
    df = ingest.counts_stream(stream(spark, tmp_path, events(), EVENT, "c"))
    got = sum(r.n for r in run(df, "counts", "complete"))
    assert got == 200


def test_debounce(spark, tmp_path):
    rows = [(T0 + dt.timedelta(seconds=s), "r", p) for s, p in ((0, "a"), (1, "b"), (10, "c"), (11, "c"))]
    got = run(ingest.debounced(stream(spark, tmp_path, rows, "ts timestamp, root string, path string", "d")), "deb", "complete")
    assert sorted(tuple(r.paths) for r in got) == [("a", "b"), ("c",)]


def test_upserts(spark, tmp_path):
    rows = [("k1", T0, 1), ("k1", T0 + dt.timedelta(seconds=5), 2), ("k2", T0, 3)]
    s = stream(spark, tmp_path, rows, "k string, ts timestamp, v int", "u")
    ingest.start_upserts(s, str(tmp_path / "out"), "k", str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("k1", 2), ("k2", 3)}
    before = {x.parent.name: x.name for x in (tmp_path / "out").rglob("*.parquet")}
    more = stream(spark, tmp_path, [("k2", T0 + dt.timedelta(seconds=9), 4)], "k string, ts timestamp, v int", "u2")
    ingest.start_upserts(more, str(tmp_path / "out"), "k", str(tmp_path / "ck2"), available_now=True).awaitTermination(120)
    assert {(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("k1", 2), ("k2", 4)}
    after = {x.parent.name: x.name for x in (tmp_path / "out").rglob("*.parquet")}
    assert set(before) == set(after) and sum(before[k] != after[k] for k in before) == 1  # one partition was replaced


def test_messages_are_packed(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "x" * 300, 5, -7, 2.5, True, None), ("b", "é", 70000, -(2**40), 0.0, False, "z")], "uid string, name string, n long, m long, f double, t boolean, o string")
    edges = spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, rel string")
    sinks.export(nodes, edges, str(tmp_path / "out"), "msgpack")

    def read(b, at):
        k = b[at]
        if k < 0x80 or k >= 0xE0:
            return (k if k < 0x80 else k - 256), at + 1
        if k in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[k], at + 1
        if k >> 4 == 8:
            out, at = {}, at + 1
            for _ in range(k & 15):
                name, at = read(b, at)
                out[name], at = read(b, at)
            return out, at
        if k >> 5 == 5 or k in (0xD9, 0xDA, 0xDB):
            w = {0xD9: 1, 0xDA: 2, 0xDB: 4}.get(k, 0)
            n, at = (int.from_bytes(b[at + 1 : at + 1 + w]) if w else k & 31), at + 1 + w
            return b[at : at + n].decode(), at + n
        import struct

        return (struct.unpack(">d", b[at + 1 : at + 9])[0] if k == 0xCB else struct.unpack(">q", b[at + 1 : at + 9])[0]), at + 9

    got = [read(bytes(r.packed), 0)[0] for r in spark.read.parquet(str(tmp_path / "out/nodes")).collect()]
    assert sorted(got, key=lambda x: x["uid"]) == [r.asDict() for r in nodes.orderBy("uid").collect()]
    assert read(bytes(spark.read.parquet(str(tmp_path / "out/edges")).first().packed), 0)[0] == {"src": "a", "dst": "b", "rel": "CALLS"}


def test_deadline(spark):
    from graphloom.operators import reads

    assert len(reads.within_deadline(spark.range(5), 60)) == 5
    slow = spark.range(10**13).selectExpr("sum(id % 7)")
    with pytest.raises(TimeoutError):
        reads.within_deadline(slow, 1.5)


def test_journal_and_queue(spark):
    j = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", True)], "uid string, seq int, v string, deleted boolean")
    assert [(r.uid, r.v) for r in ingest.latest(j).collect()] == [("a", "y")]
    t = lambda s: T0 + dt.timedelta(seconds=s)
    req = spark.createDataFrame([("r1", 2, t(0), "pending"), ("r1", 1, t(5), "pending"), ("r2", 0, t(1), "running"), ("r2", 3, t(9), "pending"), ("r3", 1, t(2), "done")], "repo string, priority int, ts timestamp, state string")
    q = ingest.job_queue(req)
    got = {r.repo: (r.priority, r.state, bool(r.requeue)) for r in q.collect()}
    assert got == {"r1": (1, "pending", False), "r2": (0, "pending", True), "r3": (1, "pending", False)}
    assert ingest.claim_next(q, F.lit(t(60))).first().repo == "r2"
    lease = spark.createDataFrame([("r2", t(50))], "repo string, claimed timestamp")
    assert ingest.claim_next(q, F.lit(t(60)), leases=lease).first().repo == "r1"

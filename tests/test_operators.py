"""Operators on small graphs whose answers are known."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import derive as D
from graphloom.operators import graph as GR
from graphloom.operators import joins as J
from graphloom.operators import reads as R
from graphloom.operators import retrieval as RT
from graphloom.plans import answers as P

EDGES = "src string, dst string, rel string, confidence double, evidence string"


def edges(spark, rows, rel="CALLS"):
    return spark.createDataFrame([(a, b, rel, float(c), "") for a, b, c in rows], EDGES)


def nodes(spark, uids, **more):
    rows = [(u, u, more.get("kind", "Function"), "r", "src/a.py", 1, 2, "f()", False, "public") for u in uids]
    return spark.createDataFrame(rows, "uid string, name string, kind string, repo_uid string, file_path string, start_line long, end_line long, signature string, is_entry_point boolean, visibility string")


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(column).collect()]


def test_modularity_of_two_triangles(spark):
    e = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 0.1)]
    und = spark.createDataFrame([(a, b, float(w)) for a, b, w in e], "a string, b string, weight double")
    parts = spark.createDataFrame([(x, x in "abc") for x in "abcdef"], "uid string, community boolean")
    assert A.modularity(und, parts).first()[0] == pytest.approx(2 * (3 / 6.1 - 0.25))
    assert A.modularity(und, parts.withColumn("community", F.lit(1))).first()[0] == pytest.approx(0)
    found = {r.uid: r.community for r in GR.communities(und).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d"}


def brandes(pairs):
    adj = {}
    for a, b in pairs:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order, pred = {s: 0}, {s: 1.0}, [], {}
        queue = [s]
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] = sigma.get(w, 0) + sigma[v]
                    pred.setdefault(w, []).append(v)
        delta = dict.fromkeys(adj, 0.0)
        for w in reversed(order):
            for v in pred.get(w, []):
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w] / 2
    return out


def test_betweenness(spark):
    barbell = [("A", "B"), ("B", "C"), ("A", "C"), ("C", "X"), ("X", "D"), ("D", "E"), ("E", "F"), ("D", "F")]
    got = {r.uid: r.betweenness for r in GR.betweenness(edges(spark, [(a, b, 1) for a, b in barbell])).collect()}
    assert got == pytest.approx(brandes(barbell)) and max(got, key=got.get) == "X"
    rnd = random.Random(3)
    pairs = {tuple(sorted(rnd.sample("abcdefghijkl", 2))) for _ in range(18)}
    got = {r.uid: r.betweenness for r in GR.betweenness(edges(spark, [(a, b, 1) for a, b in pairs])).collect()}
    assert got == pytest.approx(brandes(pairs))


def plain_rank(n, es, start, d, k):
    out = {}
    for a, _, w in es:
        out[a] = out.get(a, 0) + w
    s = dict(start)
    for _ in range(k):
        lost = sum(v for u, v in s.items() if u not in out)
        new = {u: (1 - d) * start[u] + d * lost * start[u] for u in n}
        for a, b, w in es:
            new[b] += d * s[a] * w / out[a]
        s = new
    return s


def test_ranks(spark):
    n, es = "abcd", [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.5), ("a", "c", 0.25)]
    g = spark.createDataFrame(es, "src string, dst string, weight double")
    ns = nodes(spark, n)
    got = {r.uid: r.score for r in GR.pagerank(ns, g, 0.85, 30, 0.0).collect()}
    assert got == pytest.approx(plain_rank(n, es, dict.fromkeys(n, 0.25), 0.85, 30)) and sum(got.values()) == pytest.approx(1)
    warm = GR.pagerank(ns, g, 0.85, 30, 0.0, warm=spark.createDataFrame(list(got.items()), "uid string, score double"))
    assert {r.uid: r.score for r in warm.collect()} == pytest.approx(got, abs=1e-4)
    ppr = {r.uid: r.score for r in GR.personalized_pagerank(ns, g, ["a"], 0.85, 30, 0.0).collect()}
    want = plain_rank(n, es, {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}, 0.85, 30)
    assert ppr == pytest.approx({k: v for k, v in want.items() if v > 1e-4}) and "d" not in ppr
    assert GR.personalized_pagerank(ns, g, ["nobody"], 0.85, 3).count() == 0


def test_scope_weights(spark):
    e = edges(spark, [("a", "b", 1)]).union(edges(spark, [("a", "c", 0.5)], "USES")).union(edges(spark, [("a", "x", 1), ("b", "c", 0)]))
    got = {(r.src, r.dst): r.weight for r in GR.scope_graph(nodes(spark, "abc"), e, "code", "analyze-impact").collect()}
    assert got == pytest.approx({("a", "b"): 2.0, ("b", "a"): 0.6, ("a", "c"): 0.25, ("c", "a"): 0.075})


def brute_impact(es, target, depth, least):
    best = {}
    nodes_ = {x for a, b, _ in es for x in (a, b)}
    conf = {(a, b): c for a, b, c in es}
    for u in nodes_ - {target}:
        for k in range(1, depth + 1):
            for mid in itertools.permutations(nodes_ - {u, target}, k - 1):
                path = (u, *mid, target)
                p = 1.0
                for x, y in zip(path, path[1:], strict=False):
                    p *= conf.get((x, y), 0)
                if p >= least and p > best.get(u, 0):
                    best[u] = p
    return best


def test_impact(spark):
    rnd = random.Random(1)
    es = [(a, b, rnd.choice([0.5, 0.8, 0.9, 1.0])) for a in "abcdef" for b in "abcdef" if a != b and rnd.random() < 0.4]
    for depth in (1, 2, 3):
        got = {r.uid: r.impact_score for r in GR.impact(edges(spark, es), "a", depth).collect()}
        assert got == pytest.approx(brute_impact(es, "a", depth, 0.1))
    assert GR.impact(edges(spark, es), "z").count() == 0
    two = {r.uid: r.impact_score for r in GR.impact_many(edges(spark, es), nodes(spark, "ab"), 2, 0.0).collect()}
    for u, s in two.items():
        assert s == pytest.approx(max(brute_impact(es, t, 2, 0.1).get(u, 0) for t in "ab"))


def test_widest_paths_and_dead_code(spark):
    es = [("main", "b", 0.9), ("b", "c", 0.4), ("main", "d", 0.6), ("d", "c", 0.55), ("x", "y", 1.0), ("c", "weak", 0.2)]
    got = {r.uid: r.path_confidence for r in GR.widest_paths(edges(spark, es), nodes(spark, ["main"])).collect()}
    assert got == pytest.approx({"main": 1, "b": 0.9, "d": 0.6, "c": 0.55, "weak": 0.2})
    dead = {r.uid: (r.path_confidence, r.confidence) for r in GR.dead_code(nodes(spark, ["main", "b", "c", "d", "x", "y", "weak"]), edges(spark, es)).collect()}
    assert dead == {"x": (None, "low"), "y": (None, "low"), "weak": (0.2, "medium")}


def test_walks(spark):
    e = edges(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "a", 1)])
    assert {r.uid: r.depth for r in GR.bfs(e, nodes(spark, "a"), 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert sorted((r.path, r.hops) for r in GR.paths_between(e, "a", "d").collect()) == [("a>c>d", 2)]
    assert {(r.uid, r.parent, r.depth) for r in GR.flow_tree(e, "a", 5).collect()} == {("a", None, 0), ("b", "a", 1), ("c", "a", 1), ("d", "c", 2)}
    loops = edges(spark, [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "c", 1), ("e", "e", 1), ("d", "f", 1), ("c", "b2", 1)])
    assert {r.members for r in GR.cycles(loops).collect()} == {"a,b", "c,d", "e"}
    assert GR.cycles(edges(spark, [("a", "b", 1)])).count() == 0


def test_as_of_takes_the_latest_free_selection(spark):
    rnd = random.Random(4)
    sel = [(i, rnd.choice("xy"), rnd.randrange(50)) for i in range(40)]
    tru = [(100 + i, rnd.choice("xy"), rnd.randrange(50)) for i in range(40)]
    free, want = {i for i, _, _ in sel}, {}
    for t, k, ts in sorted(tru, key=lambda x: (x[2], x[0])):
        hit = max(((s_ts, i) for i, s_k, s_ts in sel if i in free and s_k == k and s_ts <= ts), default=None)
        if hit:
            want[t] = hit[1]
            free.remove(hit[1])
    got = J.as_of(spark.createDataFrame(tru, "truth_id long, k string, ts int"), spark.createDataFrame(sel, "selection_id long, k string, ts int"), "k")
    assert {r.truth_id: r.selection_id for r in got.collect()} == want


def test_link_ladder(spark):
    notes = spark.createDataFrame([("n1", "a/x.md", "X"), ("n2", "b/x.md", "Other"), ("n3", "b/y.md", "Why"), ("n4", "c/z.md", "Why"), ("n5", "a/src.md", "Src")], "uid string, file_path string, title string")
    links = spark.createDataFrame([("n5", "x"), ("n5", "y"), ("n5", "b/x.md"), ("n5", "Why"), ("n5", "nothing"), ("n4", "Other")], "src string, target string")
    got = {(r.src, r.target, r.dst): (r.confidence, r.candidates) for r in J.resolved_links(links, notes).collect()}
    assert got == {("n5", "x", "n1"): (0.95, 1), ("n5", "y", "n3"): (1.0, 1), ("n5", "b/x.md", "n2"): (1.0, 1), ("n5", "Why", "n3"): (0.5, 2), ("n5", "Why", "n4"): (0.5, 2), ("n4", "Other", "n2"): (1.0, 1)}
    lost = J.unresolved_links(links, J.resolved_links(links, notes))
    assert [(r.src, r.target) for r in lost.collect()] == [("n5", "nothing")]
    assert {(r.target, r.severity) for r in J.broken_links(J.resolved_links(links, notes), lost).collect()} == {("x", "low_confidence"), ("Why", "ambiguous"), ("nothing", "unresolved")}


def test_scalars(spark):
    v = lambda c, rows, kind="string": values(spark, c, rows, kind)
    assert v(S.slugify("x"), ["Hello, World!", "a--b  c_d", "Über uns"]) == ["hello-world", "a-b-c-d", "über-uns"]
    assert v(S.normalize_http_path("x"), ["/v1/users/{id}/", "v1//users/:userId", "/v1/users/<u>", "/v1/users/${uid}", "/"]) == ["/v1/users/{}"] * 4 + ["/"]
    assert v(S.is_distinctive("x"), ["load_table", "loadTable", "screen", "TIMEOUT", "_x", "Processor"]) == [True, True, False, False, False, False]
    assert v(S.split_identifier("x"), ["HTTPServerError", "my_mod::loadTable"]) == ["http server error", "my mod load table"]
    assert v(S.iso_epoch("x"), ["1970-01-02", "1970-01-01T00:01:00Z", "1970-01-01T01:00:00+01:00", "junk", None]) == [86400.0, 60.0, 0.0, 0.0, 0.0]
    assert v(S.is_test_file("x"), ["a/tests/x.py", "x_test.go", "test_a.py", "a/contest.py", "FooTest.java", "foo.spec.ts", "src/x.rs"]) == [True, True, True, False, True, True, False]
    assert v(S.language("x"), ["a.tsx", "b/c.py", "Makefile", "x.SV", "m.svh"]) == ["typescript", "python", None, None, "systemverilog"]
    assert v(S.changed_file_class("x"), ["README.md", "a.py", "Dockerfile", ".github/x.py", "a.bin", "x.yaml"]) == ["documentation", "source", "execution", "execution", "unknown", "execution"]
    assert v(S.edge_type("x"), ["depends-on", "Caused by", "related", "foo bar"]) == ["DEPENDS_ON", "CAUSED_BY", "RELATES_TO", "FOO_BAR"]
    assert v(S.tag_matches("x", "#Project"), ["project", "project/x", "projects"]) == [True, True, False]
    assert v(S.path_factor("x"), ["tests/a.py", "src/test/x.test.ts", "contests/a.py"]) == pytest.approx([0.3, 0.09, 1.0])
    assert v(S.ranking_prior("x", [("**/*.md", 0.5), ("docs/**", 2.0)]), ["a/b.md:12", "docs/x.md", "x.py"]) == [0.5, 2.0, None]
    assert v(S.missing_anchor("x"), ["Note#part", "Note", "#part", "Note#"]) == ["part", None, None, None]
    assert v(S.normalized_repo_key("x"), ["https://u:p@Host.org/A/B.git/", "git@host.org:a/b.git", "ssh://git@host.org/a/b"]) == ["host.org/a/b"] * 3
    assert v(S.parameter_count("x"), ["f()", "f(a)", "f(a, b)"]) == [0, 1, 2]
    assert v(S.frontmatter_refs("x", "k"), ['{"k": "a"}', '{"k": ["a", "b"]}', "{}"]) == [["a"], ["a", "b"], []]
    assert v(S.max_edit_distance("x"), [2, 3, 5], "int") == [0, 1, 2]
    assert v(S.activity_multiplier("x"), [None, 0.5, 0.0, 1.0, 9.0], "double") == pytest.approx([1.0, 1.0, 0.4, 1.6, 1.6])
    assert v(S.uid_kind("x"), ["sym:1", "note:2", "zz:3"]) == ["Symbol", "Note", None]
    assert v(S.process_name(F.lit("Main"), "x", F.lit("app/cmd/main.go")), ["main"]) == ["cmd::main"]


def test_regex_and_trigrams(spark):
    docs = spark.createDataFrame([("a", "foo bar\nbaz 12"), ("b", "FOO\nbar"), ("c", "nothing")], "uid string, text string")
    lines = R.lines(docs, "uid", "body", "text")
    assert [tuple(r) for r in R.regex_search(lines, r"ba[rz]").orderBy("uid", "line").collect()] == [("a", "body", 1, 5, "bar"), ("a", "body", 2, 1, "baz"), ("b", "body", 2, 1, "bar")]
    assert R.required_trigrams("abcd|xyz") == [{"abc", "bcd"}, {"xyz"}]
    assert R.required_trigrams("a.*b") is None and R.required_trigrams("ab?c") is None
    with pytest.raises(ValueError):
        R.check_pattern("x" * 5000)
    rnd = random.Random(2)
    rows = [(str(i), "".join(rnd.choice("abcx ") for _ in range(30))) for i in range(300)]
    df = spark.createDataFrame(rows, "uid string, text string")
    for p in ("abc(x|c)ab", "(abc|cab)x", "abc+", "a[bc]xab", "x{2}abc"):
        few = {r.uid for r in R.trigram_candidates(df, "uid", "text", p).collect()}
        assert {r.uid for r in df.where(F.col("text").rlike(p)).collect()} <= few


def test_name_search_and_limits(spark):
    s = nodes(spark, ["Parse", "parse", "parser", "do_parse", "other"])
    assert [(r.uid, r.tier) for r in R.name_search(s, "Parse", 10).collect()] == [("Parse", 3), ("parse", 2), ("parser", 1), ("do_parse", 0)]
    assert R.name_search(s, "parse", 1).first().total == 4
    with pytest.raises(ValueError):
        R.name_search(s, "x", 10_001)
    assert [r.name for r in R.did_you_mean(s, "prser").collect()] == ["parser", "Parse", "parse"]


def test_name_search_counts_all_hits(spark):
    """More hits than any cut: all are counted."""
    s = spark.range(100_003).select(F.concat(F.lit("name"), "id").alias("uid")).withColumns({"name": F.col("uid"), "kind": F.lit("Function"), "file_path": F.lit("src/a.py")})
    assert R.name_search(s, "name", 2).first().total == 100_003


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query string, uid string, rank int")
    judged = spark.createDataFrame([("q", "b", 3), ("q", "z", 1)], "query string, uid string, grade int")
    import math

    r = A.ranking_metrics(ranked, judged, 2).first()
    assert r.mrr == 0.5 and r.precision == 0.5
    assert r.ndcg == pytest.approx((7 / math.log2(3)) / (7 / math.log2(2) + 1 / math.log2(3)))


def test_fusion(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "uid string, score double")
    got = {r.uid: (round(r.score, 9), r.sources) for r in RT.rrf({"x": f(("a", 2.0), ("b", 1.0)), "y": f(("b", 9.0))}).collect()}
    assert got == {"a": (round(1 / 61, 9), "x"), "b": (round(1 / 62 + 1 / 61, 9), "x+y")}
    assert RT.expand_query("fix auth now", {"authentication": ["auth", "a"], "login": ["sso"]}) == "fix auth now authentication"
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0]), ("d", [1.0])], "uid string, embedding array<double>")
    assert [(r.uid, round(r.score, 6)) for r in RT.vector_search(vec, [1.0, 0.0], 5).collect()] == [("a", 1.0), ("c", 0.707107), ("b", 0.0)]
    assert RT.vector_search(vec, [0.0, 0.0], 5).count() == 0


def test_derivations(spark):
    c = spark.createDataFrame([("c1", "GET", "/users/{id}"), ("c2", "POST", "/users")], "uid string, verb string, path string")
    h = spark.createDataFrame([("s1", "get", "/users/:x/"), ("s2", "GET", "/users")], "symbol_uid string, verb string, path string")
    assert {tuple(r) for r in D.match_handlers(h, c).collect()} == {("s1", "c1", 1.0), ("s2", "c1", 0.8)}
    types = spark.createDataFrame([("a", "T", 0.85)], "var string, type string, confidence double")
    got = {r.var: round(r.confidence, 6) for r in D.propagate_types(types, spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "var string, source string")).collect()}
    assert got == {"a": 0.85, "b": 0.8075, "c": 0.767125}
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib/c"), ("src/a.ts", "@/d"), ("src/a.ts", "react")], "from_file string, specifier string")
    files = spark.createDataFrame([("src/b.ts",), ("lib/c/index.ts",), ("src/d.js",)], "file string")
    assert {(r.specifier, r.file) for r in D.resolve_specifiers(imports, files, {"@/": "src/"}).collect()} == {("./b", "src/b.ts"), ("../lib/c", "lib/c/index.ts"), ("@/d", "src/d.js")}
    base = spark.createDataFrame([("o", "200"), ("o", "404"), ("p", "201")], "operation string, code string")
    head = spark.createDataFrame([("o", "2XX"), ("p", "400")], "operation string, code string")
    assert {(r.operation, r.code, r.change, r.severity) for r in J.response_diff(base, head).collect()} == {("o", "404", "removed", "info"), ("p", "201", "removed", "breaking"), ("o", "2XX", "added", "info"), ("p", "400", "added", "info")}


def test_seeds_and_context(spark):
    s, e = nodes(spark, ["sym:a", "sym:b", "sym:c"]), edges(spark, [("sym:a", "sym:b", 1.0)])
    assert P.seeds(s, e, ["sym:b", "sym:a", "sym:b", "missing"]) == ["sym:b", "sym:a"]
    got = P.code_context(s, e, ["sym:a"], 5)
    assert [r.uid for r in got.collect()] == ["sym:a", "sym:b"]


def test_repeated_and_empty(spark):
    none = edges(spark, [])
    assert A.hubs(none, nodes(spark, "ab"), ["Function"], 5).count() == 0
    assert GR.pagerank(nodes(spark, "ab"), spark.createDataFrame([], "src string, dst string, weight double"), iterations=2).count() == 2
    assert J.strongest(J.neighbours(edges(spark, [("a", "b", 0.5), ("a", "b", 0.9)]), nodes(spark, "ab"), "b", "in", ["CALLS"])).first().confidence == 0.9
    assert json.loads("{}") == {}


def test_forward_push_is_near_the_walk(spark):
    """All residual together bounds how far a score is from the walk's, and a fine threshold leaves little."""
    rnd = random.Random(5)
    rows = sorted({(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(120)})
    graph = spark.createDataFrame([(a, b, 1.0 + (i % 3)) for i, (a, b) in enumerate(rows) if a != b], "src string, dst string, weight double")
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(40)] + [("alone",)], "uid string")
    exact = {r.uid: r.score for r in GR.personalized_pagerank(nodes, graph, ["n1", "n2"], 0.8, 80, 0.0, floor=0.0).collect()}
    for epsilon in (1e-2, 1e-5):
        got = {r.uid: r.score for r in GR.forward_push(nodes, graph, ["n1", "n2"], 0.8, epsilon).collect()}
        left = 1 - sum(got.values())
        assert 0 <= left + 1e-9 and all(-1e-6 <= exact.get(u, 0.0) - s <= left + 1e-6 for u, s in got.items())
    assert left < 0.01
    assert GR.forward_push(nodes, graph, ["nobody"]).count() == 0


def test_paths_have_no_greatest_length(spark):
    chain = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", 1.0 - k / 100) for k in range(54)], "src string, dst string, confidence double")
    got = {r.uid: r.path_confidence for r in GR.widest_paths(chain, spark.createDataFrame([("n000",)], "uid string")).collect()}
    assert len(got) == 55 and got["n054"] == pytest.approx(0.47)

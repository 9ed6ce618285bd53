"""Ranks, walks, reachability, communities and the answers composed of them."""

from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import budget as BU
from graphloom.operators import graph as GR
from graphloom.plans import answers as P
from graphloom.queries.joined import RESOLVED, resolved
from graphloom.registry import given, query

_WEIGHT = "CASE rel WHEN 'CALLS' THEN 1.0 WHEN 'EXTENDS_SYM' THEN 0.9 WHEN 'IMPORTS' THEN 0.7 WHEN 'USES' THEN 0.5 WHEN 'MEMBER_OF' THEN 0.2 END::DOUBLE"
_SCOPE = f"""SELECT src, dst, sum(w) AS weight FROM (SELECT src, dst, confidence * {_WEIGHT} AS w FROM edges WHERE rel <> 'CROSS_REPO_LINK' AND confidence > 0
    UNION ALL SELECT dst, src, confidence * {_WEIGHT} * 0.3 FROM edges WHERE rel <> 'CROSS_REPO_LINK' AND confidence > 0) GROUP BY src, dst"""
_STEP = "SELECT g.src, g.dst, g.weight / o.t AS share FROM g JOIN (SELECT src, sum(weight) AS t FROM g GROUP BY src) o ON o.src = g.src"


def _rounds(start: str, damping: float, k: int, tolerance: float = 0.0) -> dict[str, str]:
    """k rounds, unrolled; with a tolerance, scores stand still from a multiple of CHECK_EVERY rounds on whose last moved none by as much."""
    parts = {"g": _SCOPE, "step": _STEP, "s0": f"SELECT *, false AS done FROM ({start})"}
    for i in range(k):
        new = f"""SELECT s.uid, s.p, s.score AS old, s.done, {1 - damping} * s.p + {damping} * (SELECT coalesce(sum(score), 0) FROM s{i} WHERE uid NOT IN (SELECT src FROM step)) * s.p + {damping} * coalesce(m.gain, 0) AS score
            FROM s{i} s LEFT JOIN (SELECT t.dst, sum(x.score * t.share) AS gain FROM s{i} x JOIN step t ON t.src = x.uid GROUP BY t.dst) m ON m.dst = s.uid"""
        look = f"max(abs(score - old)) OVER () < {tolerance}" if tolerance and (i + 1) % GR.CHECK_EVERY == 0 else "false"
        parts[f"s{i + 1}"] = f"SELECT uid, p, CASE WHEN done THEN old ELSE score END AS score, done OR {look} AS done FROM ({new})"
    return parts


@query(given("symbols", "edges", **_rounds("SELECT uid, 1.0::DOUBLE / (SELECT count(*) FROM symbols) AS p, 1.0::DOUBLE / (SELECT count(*) FROM symbols) AS score FROM symbols", 0.85, 20, 1e-6)) + "SELECT uid, round(score, 10) AS score FROM s20")
def pagerank(t):
    s = t.symbols
    return GR.pagerank(s, GR.scope_edges(t.edges), back=model.REVERSE_WEIGHT).withColumn("score", F.round("score", 10))


_SEEDS = "SELECT uid, CASE WHEN uid IN ('sup:1', 'part:5') THEN 0.5 ELSE 0 END::DOUBLE AS p, CASE WHEN uid IN ('sup:1', 'part:5') THEN 0.5 ELSE 0 END::DOUBLE AS score FROM symbols"


@query(given("symbols", "edges", **_rounds(_SEEDS, 0.85, 20, 1e-6)) + "SELECT uid, round(score, 9) AS power_score, true AS agrees FROM s20")
def forward_push(t):
    """Every node's score by power iteration, and whether pushing down to the threshold comes within 1e-4 of it."""
    s, seeds = t.symbols, ["sup:1", "part:5"]
    g = GR.scope_edges(t.edges)
    pushed = GR.forward_push(s, g, seeds, back=model.REVERSE_WEIGHT).withColumnRenamed("score", "pushed")
    power = GR.personalized_pagerank(s, g, seeds, 0.85, floor=-1.0, back=model.REVERSE_WEIGHT)
    return power.join(pushed, "uid", "left").select("uid", F.round("score", 9).alias("power_score"), (F.abs(F.col("score") - F.coalesce("pushed", F.lit(0.0))) <= 1e-4).alias("agrees"))


@query(given("symbols", "edges", **_rounds(_SEEDS, 0.75, 20, 1e-6)) + "SELECT uid, round(score, 10) AS score FROM s20 WHERE score > 0.0001 OR p > 0")
def personalized_pagerank(t):
    s = t.symbols
    return GR.personalized_pagerank(s, GR.scope_edges(t.edges), ["sup:1", "part:5"], 0.75, back=model.REVERSE_WEIGHT).withColumn("score", F.round("score", 10))


@query(given("symbols", "edges", **_rounds(_SEEDS, 0.75, 20, 1e-6)) + """, m AS (SELECT max(start_line) AS top FROM symbols WHERE kind = 'Class' AND start_line <= 500)
    SELECT s.uid, round(s.score * (1 + 0.05 * coalesce(c.start_line, 0)::DOUBLE / (SELECT top FROM m)), 10) AS score FROM s20 s LEFT JOIN symbols c ON c.uid = s.uid AND c.kind = 'Class' AND c.start_line <= 500 WHERE s.score > 0""")
def interaction_rerank(t):
    s = t.symbols
    memory = s.where("kind = 'Class' and start_line <= 500").select("uid", F.col("start_line").cast("double").alias("score"))
    plain = GR.personalized_pagerank(s, GR.scope_edges(t.edges), ["sup:1", "part:5"], 0.75, floor=0.0, back=model.REVERSE_WEIGHT)
    return GR.rerank_by_interaction(plain, memory).where("score > 0").withColumn("score", F.round("score", 10))


@query(given("symbols", "edges", **_rounds(_SEEDS, 0.75, 20, 1e-6)) + """SELECT uid, round(score, 10) AS score FROM s20 WHERE score > 0.0001 OR p > 0
    UNION ALL (SELECT uid, round(score, 10) FROM s20 WHERE NOT (score > 0.0001 OR p > 0) AND round(score, 10) > 0 ORDER BY round(score, 10) DESC, uid LIMIT 25)""")
def below_floor_tail(t):
    s = t.symbols
    walk = GR.personalized_pagerank(s, GR.scope_edges(t.edges), ["sup:1", "part:5"], 0.75, floor=0.0, back=model.REVERSE_WEIGHT).withColumn("score", F.round("score", 10)).where("score > 0")
    return GR.bound_below_floor(walk, ["sup:1", "part:5"], 25)


@query(given("symbols", "edges", g=_SCOPE) + "SELECT src, dst, round(weight, 9) AS weight FROM g")
def scope_graph(t):
    return GR.scope_graph(t.symbols, t.edges).withColumn("weight", F.round("weight", 9))


_IMPACT = "('CALLS', 'IMPORTS', 'EXTENDS_SYM', 'IMPLEMENTS_SYM', 'INCLUDES_SYM', 'CROSS_REPO_LINK')"


def _impact(start: str, depth: int, min_confidence: float, min_score: float, data_depth: int = 0) -> dict[str, str]:
    parts = {"b0": start}
    for k in range(1, depth + 1):
        rel = f"(rel IN {_IMPACT}" + (" OR rel IN ('USES', 'ACCESSES'))" if k <= data_depth else ")")
        parts[f"b{k}"] = f"""SELECT uid, max(s) AS s, min_by(d, (-s, d)) AS d FROM (SELECT uid, s, d FROM b{k - 1} UNION ALL
            SELECT e.src, max(b.s * e.confidence), {k} FROM edges e JOIN b{k - 1} b ON b.uid = e.dst WHERE {rel} AND e.confidence >= {min_confidence} GROUP BY e.src HAVING max(b.s * e.confidence) >= {min_score}) GROUP BY uid"""
    return parts


@query(given("edges", **_impact("SELECT 'sup:3' AS uid, 1.0::DOUBLE AS s, 0 AS d", 3, 0.0, 0.1)) + "SELECT uid, round(s, 9) AS impact_score, CAST(d AS INTEGER) AS depth FROM b3 WHERE uid <> 'sup:3'")
def impact(t):
    return GR.impact(t.edges, "sup:3", 3).select("uid", F.round("impact_score", 9).alias("impact_score"), "depth")


@query(given("edges", **_impact("SELECT 'part:7' AS uid, 1.0::DOUBLE AS s, 0 AS d", 2, 0.05, 0.05, 1)) + "SELECT uid, round(s, 9) AS impact_score, CAST(d AS INTEGER) AS depth FROM b2 WHERE uid <> 'part:7'")
def impact_with_data_edges(t):
    return GR.impact(t.edges, "part:7", 2, 0.05, 0.05, 1).select("uid", F.round("impact_score", 9).alias("impact_score"), "depth")


_CHANGED = "SELECT uid, 1.0::DOUBLE AS s, 0 AS d FROM symbols WHERE file_path IN ('nation3/supplier.java', 'nation7/supplier.java')"
_FILES = ["nation3/supplier.java", "nation7/supplier.java"]


@query(given("symbols", "edges", **_impact(_CHANGED, 3, 0.0, 0.1)) + "SELECT b.uid, round(b.s, 9) AS impact_score, CASE WHEN b.s >= 0.5 THEN 'breaking' WHEN b.s >= 0.25 THEN 'warning' ELSE 'info' END AS severity FROM b3 b JOIN symbols USING (uid) WHERE d > 0")
def blast_radius(t):
    return P.blast_radius(t.symbols, t.edges, _FILES)[0].select("uid", F.round("impact_score", 9).alias("impact_score"), "severity")


@query(given("symbols", "edges", **_impact(_CHANGED, 3, 0.0, 0.1)) + """, a AS (SELECT b.uid, is_entry_point FROM b3 b JOIN symbols USING (uid) WHERE d > 0), c AS (SELECT DISTINCT repo_uid FROM symbols WHERE uid IN (SELECT uid FROM a) OR file_path IN ('nation3/supplier.java', 'nation7/supplier.java'))
    SELECT count(*) AS affected, (SELECT count(*) FROM c) AS clusters, CASE x WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT 1), a,
    (SELECT (SELECT CASE WHEN count(*) < 10 THEN 0 WHEN count(*) < 50 THEN 1 WHEN count(*) < 200 THEN 2 ELSE 3 END FROM a) + (SELECT CASE WHEN bool_or(is_entry_point) THEN 1 ELSE 0 END FROM a) + (SELECT CASE WHEN count(*) > 3 THEN 1 ELSE 0 END FROM c) AS x) GROUP BY x""")
def blast_radius_summary(t):
    s = t.symbols
    return P.blast_radius(s, t.edges, _FILES, s.select("uid", F.col("repo_uid").alias("community")))[1].select("affected", "clusters", "risk")


@query(given("symbols", "edges", **_impact(_CHANGED, 3, 0.3, 0.1)) + "SELECT file_path, CAST(min(d) AS INTEGER) AS tier, round(max(s), 9) AS score, count(*) AS symbols FROM b3 JOIN symbols USING (uid) WHERE d > 0 AND regexp_matches(file_path, '(^|/)tests/|_test\\.go$') GROUP BY file_path")
def affected_tests(t):
    return P.affected_tests(t.symbols, t.edges, _FILES).withColumn("score", F.round("score", 9))


def _bfs(start: str, hop: str, depth: int) -> dict[str, str]:
    parts = {"v0": start}
    for k in range(1, depth + 1):
        parts[f"v{k}"] = f"SELECT uid, min(d) AS d FROM (SELECT uid, d FROM v{k - 1} UNION ALL SELECT {hop}, {k} FROM edges e JOIN v{k - 1} v ON {'e.src' if hop == 'e.dst' else 'e.dst'} = v.uid WHERE v.d = {k - 1} AND e.rel IN ('CALLS', 'IMPORTS', 'CROSS_REPO_LINK')) GROUP BY uid"
    return parts


@query(given("edges", **_bfs("SELECT uid, 0 AS d FROM (VALUES ('cust:1'), ('sup:2')) AS x(uid)", "e.dst", 3)) + "SELECT uid, CAST(d AS INTEGER) AS depth FROM v3")
def forward_reach(t):
    seeds = t.spark.createDataFrame([("cust:1",), ("sup:2",)], "uid string")
    return GR.bfs(t.edges, seeds, 3, model.PROCESS_RELATIONS)


def _budget(seeds: str, depth: int, steps: int) -> dict[str, str]:
    """Levels of a walk with a budget: what each node costs, where its steps begin, and which of its ways out are looked at."""
    parts = {"e": f"SELECT DISTINCT src, dst FROM edges WHERE rel IN ({', '.join(repr(r) for r in model.PROCESS_RELATIONS)})", "deg": "SELECT src, count(*) AS n FROM e GROUP BY src", "v0": seeds, "u0": "SELECT 0 AS u, false AS cut"}
    for k in range(depth + 1):
        n = "coalesce(n, 0)" if k < depth else "0"
        parts[f"c{k}"] = f"SELECT uid, 1 + {n} AS cost, sum(1 + {n}) OVER (ORDER BY uid) - 1 - {n} AS st FROM v{k} LEFT JOIN deg ON src = uid WHERE d = {k}"
        parts[f"x{k}"] = f"SELECT e.dst, st + row_number() OVER (PARTITION BY src ORDER BY dst) AS place FROM c{k} JOIN e ON e.src = uid"
        parts[f"v{k + 1}"] = f"SELECT uid, d FROM v{k} UNION ALL SELECT DISTINCT dst, {k + 1} FROM x{k}, u{k} WHERE u + place < {steps} AND {k} < {depth} AND dst NOT IN (SELECT uid FROM v{k})"
        parts[f"u{k + 1}"] = f"SELECT least({steps}, u + coalesce((SELECT sum(cost) FROM c{k}), 0)) AS u, cut OR u + coalesce((SELECT sum(cost) FROM c{k}), 0) > {steps} AS cut FROM u{k}"
    return parts


@query(given("edges", **_budget("SELECT uid, 0 AS d FROM (VALUES ('cust:1'), ('sup:2'), ('cust:9')) AS x(uid)", 4, 150)) + "SELECT uid, CAST(d AS INTEGER) AS depth, CAST(u AS BIGINT) AS steps, cut AS truncated FROM v4, u5")
def bounded_reach(t):
    seeds = t.spark.createDataFrame([("cust:1",), ("sup:2",), ("cust:9",)], "uid string")
    got = BU.bounded_reach(t.edges, seeds, 4, 150)
    return got.nodes.select("uid", "depth", F.lit(got.steps).cast("long").alias("steps"), F.lit(got.truncated).alias("truncated"))


_ENTRY = "SELECT uid, name FROM symbols WHERE is_entry_point OR uid NOT IN (SELECT dst FROM edges WHERE rel = 'CALLS')"


@query(given("symbols", "edges") + _ENTRY)
def entry_points(t):
    return P.entry_points(t.symbols, t.edges).select("uid", "name")


@query(given("symbols", "edges", p0="SELECT uid AS entry, uid, 0 AS d FROM symbols WHERE is_entry_point", p1="SELECT entry, uid, min(d) AS d FROM (SELECT * FROM p0 UNION ALL SELECT p.entry, e.dst, 1 FROM p0 p JOIN edges e ON e.src = p.uid WHERE e.rel IN ('CALLS', 'IMPORTS', 'CROSS_REPO_LINK')) GROUP BY entry, uid",
    p2="SELECT entry, uid, min(d) AS d FROM (SELECT * FROM p1 UNION ALL SELECT p.entry, e.dst, 2 FROM p1 p JOIN edges e ON e.src = p.uid WHERE p.d = 1 AND e.rel IN ('CALLS', 'IMPORTS', 'CROSS_REPO_LINK')) GROUP BY entry, uid") + "SELECT entry, count(*) AS members, CAST(max(d) AS INTEGER) AS depth FROM p2 GROUP BY entry")
def process_traces(t):
    return P.processes(t.symbols, t.edges, 2, t.symbols.where("is_entry_point"))


@query(given("symbols", "edges", **_bfs("SELECT uid, 0 AS d FROM symbols WHERE file_path IN ('nation3/supplier.java', 'nation7/supplier.java')", "e.src", 2)) + f", en AS ({_ENTRY}) SELECT uid AS entry, en.name, CAST(d AS INTEGER) AS depth FROM en JOIN v2 USING (uid)")
def change_impact(t):
    return P.change_impact(t.symbols, t.edges, _FILES, 2)


_WIDE = {"e2": "SELECT src, dst, max(c) AS c FROM (SELECT src, dst, confidence AS c FROM edges UNION ALL SELECT dst, src, confidence FROM edges WHERE rel = 'MEMBER_OF') GROUP BY src, dst", "w0": "SELECT uid, 1.0::DOUBLE AS w FROM symbols WHERE is_entry_point OR regexp_matches(file_path, '(^|/)tests/|_test\\.go$')"}
for _k in range(1, 9):
    _WIDE[f"w{_k}"] = f"SELECT uid, max(w) AS w FROM (SELECT uid, w FROM w{_k - 1} UNION ALL SELECT e.dst, max(least(x.w, e.c)) FROM e2 e JOIN w{_k - 1} x ON x.uid = e.src GROUP BY e.dst) GROUP BY uid"


@query(given("symbols", "edges", **_WIDE) + """, dead AS (SELECT s.*, w FROM symbols s LEFT JOIN w8 USING (uid) WHERE (w IS NULL OR w < 0.5) AND kind NOT IN ('Interface', 'TypeAlias', 'Enum', 'Module')),
    mem AS (SELECT src FROM edges WHERE rel = 'MEMBER_OF' AND dst IN (SELECT uid FROM dead WHERE kind = 'Class'))
    SELECT uid, round(w, 9) AS path_confidence, CASE WHEN w IS NOT NULL THEN 'medium' WHEN visibility = 'public' THEN 'low' ELSE 'medium' END AS confidence FROM dead WHERE uid NOT IN (SELECT src FROM mem)""")
def dead_code(t):
    return GR.dead_code(t.symbols, t.edges).withColumn("path_confidence", F.round("path_confidence", 9))


@query(given("edges", e="SELECT DISTINCT src, dst FROM edges WHERE rel IN ('CALLS', 'IMPORTS', 'USES')", f1="SELECT dst AS u, 'cust:1>' || dst AS p FROM e WHERE src = 'cust:1' AND dst NOT IN ('part:9', 'cust:1')",
    f2="SELECT e.dst AS u, min_by(f.p, e.src) || '>' || e.dst AS p FROM f1 f JOIN e ON e.src = f.u WHERE e.dst NOT IN ('part:9', 'cust:1') AND e.dst NOT IN (SELECT u FROM f1) GROUP BY e.dst",
    o="SELECT 'cust:1>part:9' AS path, 1 AS hops FROM e WHERE src = 'cust:1' AND dst = 'part:9' UNION ALL SELECT p || '>part:9', 2 FROM f1 JOIN e ON src = u AND dst = 'part:9' UNION ALL SELECT p || '>part:9', 3 FROM f2 JOIN e ON src = u AND dst = 'part:9'") + "SELECT path, CAST(hops AS INTEGER) AS hops FROM o ORDER BY hops, path LIMIT 10")
def paths_between(t):
    return GR.paths_between(t.edges.where("rel in ('CALLS', 'IMPORTS', 'USES')"), "cust:1", "part:9", 3, 10)


@query(given("edges", f0="SELECT 'cust:5' AS uid, CAST(NULL AS VARCHAR) AS parent, 0 AS depth", f1="SELECT * FROM f0 UNION ALL SELECT e.dst, min(e.src), 1 FROM edges e WHERE e.src = 'cust:5' AND e.dst <> 'cust:5' GROUP BY e.dst",
    f2="SELECT * FROM f1 UNION ALL SELECT e.dst, min(e.src), 2 FROM edges e JOIN f1 f ON f.uid = e.src AND f.depth = 1 WHERE e.dst NOT IN (SELECT uid FROM f1) GROUP BY e.dst") + "SELECT uid, parent, CAST(depth AS INTEGER) AS depth FROM f2")
def flow_tree(t):
    return GR.flow_tree(t.edges, "cust:5", 2)


def _note_graph(t):
    return resolved(t).where("src <> dst").select("src", "dst").distinct()


@query(RESOLVED + """, g AS (SELECT DISTINCT src, dst FROM resolved WHERE src <> dst), r AS (WITH RECURSIVE w(a, b) AS (SELECT src, dst FROM g UNION SELECT w.a, g.dst FROM w JOIN g ON g.src = w.b) SELECT a, b FROM w),
    s AS (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) SELECT DISTINCT min(b) AS component, string_agg(b, ',' ORDER BY b) AS members FROM s GROUP BY a""")
def note_cycles(t):
    return GR.cycles(_note_graph(t))


def _undirected(t):
    e = t.edges.where("rel in ('IMPORTS', 'MEMBER_OF', 'CROSS_REPO_LINK')")
    return e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("confidence").alias("weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight"))


@query()
def communities(t):
    return GR.communities(_undirected(t))


@query()
def topic_clusters(t):
    """Clusters of notes by their links: size and the title of the most linked note."""
    links = _note_graph(t)
    found = GR.communities(links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().withColumn("weight", F.lit(1.0)))
    degree = links.groupBy(F.col("dst").alias("uid")).agg(F.count(F.lit(1)).alias("n"))
    j = found.join(degree, "uid", "left").join(t.notes.select("uid", "title"), "uid")
    return j.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.max_by("title", F.struct(F.coalesce("n", F.lit(0)), "uid")).alias("label"))


_UND = given("symbols", "edges", u="SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(confidence) AS weight FROM edges WHERE rel IN ('IMPORTS', 'MEMBER_OF', 'CROSS_REPO_LINK') GROUP BY ALL", c="SELECT uid, repo_uid AS community FROM symbols")


@query(_UND + """, m AS (SELECT sum(weight) AS m FROM u), d AS (SELECT community, sum(weight) AS d FROM (SELECT a AS uid, weight FROM u UNION ALL SELECT b, weight FROM u) JOIN c USING (uid) GROUP BY 1),
    l AS (SELECT x.community, sum(weight) AS l FROM u JOIN c x ON x.uid = a JOIN c y ON y.uid = b WHERE x.community = y.community GROUP BY 1)
    SELECT round(sum(coalesce(l, 0) / m - pow(d / (2 * m), 2)), 9) AS modularity FROM d LEFT JOIN l USING (community), m""")
def modularity(t):
    return A.modularity(_undirected(t), t.symbols.select("uid", F.col("repo_uid").alias("community"))).select(F.round("modularity", 9).alias("modularity"))


@query(_UND + """, bo AS (SELECT a, b, weight FROM u UNION ALL SELECT b, a, weight FROM u) SELECT x.community, round(coalesce(sum(weight) FILTER (x.community = y.community), 0) / sum(weight), 9) AS cohesion FROM bo JOIN c x ON x.uid = a LEFT JOIN c y ON y.uid = b GROUP BY 1""")
def cohesion(t):
    return A.cohesion(_undirected(t), t.symbols.select("uid", F.col("repo_uid").alias("community"))).withColumn("cohesion", F.round("cohesion", 9))


@query(given("symbols") + "SELECT repo_uid AS community, count(*) FILTER (is_entry_point) AS affected, count(*) AS total FROM symbols GROUP BY 1 HAVING count(*) FILTER (is_entry_point) > 0")
def affected_clusters(t):
    s = t.symbols
    return A.affected_clusters(s.select("uid", F.col("repo_uid").alias("community")), s.where("is_entry_point"))


@query()
def betweenness(t):
    e = t.edges.where("rel in ('IMPORTS', 'MEMBER_OF')")
    return GR.betweenness(e, 500).withColumn("betweenness", F.round("betweenness", 6))


@query()
def bridges(t):
    """The ten nodes most walks pass, with the repositories around them."""
    e = t.edges.where("rel in ('IMPORTS', 'MEMBER_OF')")
    top = GR.betweenness(e, 500).orderBy(F.desc("betweenness"), "uid").limit(10)
    both = e.select("src", "dst").union(e.select("dst", "src")).union(top.select("uid", "uid"))
    around = both.toDF("uid", "other").join(F.broadcast(top), "uid").join(t.symbols.select(F.col("uid").alias("other"), "repo_uid"), "other")
    return around.groupBy("uid", "betweenness").agg(F.array_join(F.array_sort(F.collect_set("repo_uid")), ",").alias("repos")).withColumn("betweenness", F.round("betweenness", 6))


@query()
def code_context(t):
    return P.code_context(t.symbols, t.edges, ["sup:3", "red_widget"], 20).withColumn("score", F.round("score", 8))


@query(given("symbols", "edges") + """, d AS (SELECT dst AS uid, count(*) AS n FROM edges WHERE rel = 'USES' GROUP BY dst), f AS (SELECT repo_uid, file_path, max(CASE WHEN kind IN ('Function', 'Method') THEN coalesce(n, 0)::DOUBLE END) AS best, sum(length(name)) AS tokens FROM symbols LEFT JOIN d USING (uid) GROUP BY ALL)
    SELECT repo_uid, file_path, best, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY repo_uid ORDER BY best IS NULL, best DESC, repo_uid, file_path) AS r FROM f) WHERE r <= 300""")
def repo_map(t):
    score = t.edges.where("rel = 'USES'").groupBy(F.col("dst").alias("uid")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return P.repo_map(t.symbols, score, 300).select("repo_uid", "file_path", "best", "tokens")


@query(given("symbols", "edges") + """, d AS (SELECT uid, sum(i)::BIGINT AS a, sum(1 - i)::BIGINT AS b FROM (SELECT src AS uid, 0 AS i FROM edges UNION ALL SELECT dst, 1 FROM edges) GROUP BY uid)
    SELECT uid, lower(kind) || ' ' || name || ' in ' || file_path || ': ' || a || ' in, ' || b || ' out, ' || CASE WHEN a >= 3 * b THEN 'sink' WHEN b >= 3 * a THEN 'orchestrator' ELSE 'bridge' END AS summary FROM symbols JOIN d USING (uid)""")
def symbol_summaries(t):
    ends = t.edges.select(F.explode(F.array(F.struct(F.col("src").alias("uid"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("uid"), F.lit(1).alias("i")))).alias("x"))
    return P.summaries(t.symbols, ends.groupBy("x.uid").agg(F.sum("x.i").alias("in_degree"), F.sum(1 - F.col("x.i")).alias("out_degree")))


@query(given("symbols", "edges", **_impact(_CHANGED, 2, 0.0, 0.1)) + "SELECT uid, CASE WHEN s >= 0.5 THEN 'error' WHEN s >= 0.25 THEN 'warning' ELSE 'note' END AS level FROM b2 JOIN symbols USING (uid) WHERE d > 0")
def sarif_report(t):
    from graphloom.sources.sinks import sarif

    out = sarif(P.blast_radius(t.symbols, t.edges, _FILES, max_depth=2)[0])
    return out.select("uid", F.get_json_object("result", "$.level").alias("level"))


@query(given("symbols", "edges") + """SELECT 'CREATE (:Symbol {uid: ''' || uid || ''', name: ''' || name || ''', kind: ''' || kind || '''});' AS line FROM symbols
    UNION ALL SELECT 'MATCH (a {uid: ''' || src || '''}), (b {uid: ''' || dst || '''}) CREATE (a)-[:' || rel || ' {confidence: ' || confidence || '}]->(b);' FROM edges""")
def cypher_export(t):
    from graphloom.sources.sinks import cypher

    return cypher(t.symbols, t.edges).select("line")


@query(given("symbols", "edges") + """SELECT '<node id="' || uid || '"><data key="name">' || name || '</data><data key="kind">' || kind || '</data></node>' AS line FROM symbols
    UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="rel">' || rel || '</data></edge>' FROM edges""")
def graphml_export(t):
    from graphloom.sources.sinks import graphml

    return graphml(t.symbols, t.edges).select("line")


@query(given("symbols", "edges") + """, b AS (SELECT uid, name FROM symbols WHERE kind = 'Class' ORDER BY start_line DESC, uid LIMIT 20)
    SELECT regexp_replace(uid, '[^A-Za-z0-9]', '_', 'g') || '["' || name || '"]' AS line FROM b UNION ALL SELECT DISTINCT regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' -->|' || rel || '| ' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') FROM edges WHERE src IN (SELECT uid FROM b) AND dst IN (SELECT uid FROM b)""")
def mermaid_export(t):
    from graphloom.sources.sinks import mermaid

    s = t.symbols.where("kind = 'Class'")
    return mermaid(s, t.edges, s.select("uid", F.col("start_line").cast("double").alias("score")), 20).select("line")


@query(given("symbols", "edges") + """, r AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS id FROM symbols) SELECT a.id AS src_id, b.id AS dst_id, rel FROM edges JOIN r a ON a.uid = src JOIN r b ON b.uid = dst""")
def indexed_graph(t):
    from graphloom.sources.sinks import indexed

    return indexed(t.symbols, t.edges)[1].select("src_id", "dst_id", "rel")

"""Joins, anti-joins, link resolution, diffs, unions, windows and statistics."""

from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import joins as J
from graphloom.operators import reads as R
from graphloom.registry import given, query

G = given("symbols", "edges")


@query(G + "SELECT s.uid, s.name, e.rel, round(e.confidence, 9) AS confidence FROM edges e JOIN symbols s ON s.uid = e.src WHERE e.dst = 'sup:3' AND e.rel = 'CALLS'")
def callers(t):
    return J.neighbours(t.edges, t.symbols, "sup:3", "in", ["CALLS"]).select("uid", "name", "rel", F.round("confidence", 9).alias("confidence"))


@query(G + "SELECT s.uid, e.rel FROM edges e JOIN symbols s ON s.uid = e.src WHERE e.dst = 'sup:3' AND e.rel IN ('CALLS', 'IMPORTS', 'EXTENDS_SYM')")
def references_to(t):
    return J.neighbours(t.edges, t.symbols, "sup:3", "in", ["CALLS", "IMPORTS", "EXTENDS_SYM"]).select("uid", "rel")


@query(G + "SELECT s.uid, min(e.rel) AS rel, round(max(e.confidence), 9) AS confidence FROM edges e JOIN symbols s ON s.uid = e.dst WHERE e.src = 'sup:5' AND e.rel IN ('CALLS', 'IMPORTS', 'CROSS_REPO_LINK') GROUP BY s.uid")
def callees_strongest(t):
    return J.strongest(J.neighbours(t.edges, t.symbols, "sup:5", "out", model.PROCESS_RELATIONS)).select("uid", "rel", F.round("confidence", 9).alias("confidence"))


@query(G + """, h AS (SELECT DISTINCT s.uid, s.name, s.visibility FROM edges e JOIN symbols s ON s.uid = e.dst WHERE e.src = 'sup:4' AND e.rel = 'USES' AND s.uid <> 'part:4')
    SELECT uid, name, 'USES' AS rel, (SELECT count(*) FROM h WHERE visibility <> 'public') AS hidden FROM h WHERE visibility = 'public' ORDER BY uid LIMIT 15""")
def bounded_flow(t):
    return J.bounded_flow(t.edges, t.symbols, "sup:4", 15, ["USES"], ["part:4"], F.col("visibility") == "public")


@query(G + "SELECT DISTINCT s.file_path FROM edges e JOIN symbols s ON s.uid = e.src JOIN symbols d ON d.uid = e.dst WHERE d.repo_uid = 'nation:2' AND d.file_path = 'nation2/supplier.java' AND s.file_path <> d.file_path AND e.rel IN ('CALLS', 'IMPORTS')")
def files_referencing_file(t):
    return J.files_referencing(t.edges, t.symbols, "nation:2", "nation2/supplier.java", ["CALLS", "IMPORTS"])


RESOLVED = given("notes", "links") + """, raw AS (SELECT DISTINCT src, target, lower(target) AS key FROM links),
    n AS (SELECT uid, lower(replace(file_path, '.md', '')) AS path, lower(replace(split_part(file_path, '/', 2), '.md', '')) AS stem, lower(title) AS title, split_part(file_path, '/', 1) AS folder FROM notes),
    st AS (SELECT *, count(*) OVER (PARTITION BY stem) AS ns, count(*) OVER (PARTITION BY title) AS nt FROM n),
    hit AS (SELECT raw.src, raw.target, n.uid AS dst, 0 AS tier, 1.0::DOUBLE AS base FROM raw JOIN n ON key = path
            UNION ALL SELECT raw.src, raw.target, st.uid, 1, 1.0 FROM raw JOIN st ON key = stem AND ns = 1
            UNION ALL SELECT raw.src, raw.target, st.uid, 2, 0.95 FROM raw JOIN n s ON s.uid = raw.src JOIN st ON key = st.stem AND ns > 1 AND st.folder = s.folder
            UNION ALL SELECT raw.src, raw.target, st.uid, 3, 1.0 FROM raw JOIN st ON key = title AND nt = 1
            UNION ALL SELECT raw.src, raw.target, st.uid, 4, 1.0 FROM raw JOIN st ON key = title AND nt > 1),
    best AS (SELECT DISTINCT src, target, dst, base FROM (SELECT *, min(tier) OVER (PARTITION BY src, target) AS m FROM hit) WHERE tier = m),
    resolved AS MATERIALIZED (SELECT src, target, dst, base / count(*) OVER (PARTITION BY src, target) AS confidence, count(*) OVER (PARTITION BY src, target) AS candidates FROM best),
    unresolved AS MATERIALIZED (SELECT DISTINCT src, target FROM links EXCEPT SELECT src, target FROM resolved),
    linked AS (SELECT src AS uid FROM resolved WHERE src <> dst UNION SELECT dst FROM resolved WHERE src <> dst)
"""


def resolved(t):
    return J.resolved_links(t.links, t.notes)


@query(RESOLVED + "SELECT src, target, dst, confidence, candidates FROM resolved")
def wikilink_resolution(t):
    return resolved(t)


@query(RESOLVED + "SELECT src, target FROM unresolved")
def unresolved_links(t):
    return J.unresolved_links(t.links, resolved(t))


@query(RESOLVED + "SELECT DISTINCT src, target, confidence FROM resolved WHERE dst = 'note:8' AND src <> dst")
def backlinks(t):
    return J.backlinks(resolved(t), "note:8")


@query(RESOLVED + """SELECT src, target, min(confidence) AS confidence, count(DISTINCT dst) AS candidates, CASE WHEN count(DISTINCT dst) > 1 THEN 'ambiguous' ELSE 'low_confidence' END AS severity FROM resolved WHERE confidence < 1 GROUP BY src, target
    UNION ALL SELECT src, target, 0.0, 0, 'unresolved' FROM unresolved""")
def broken_links(t):
    r = resolved(t)
    return J.broken_links(r, J.unresolved_links(t.links, r))


@query(RESOLVED + "SELECT uid, title, file_path FROM notes WHERE uid NOT IN (SELECT uid FROM linked) AND file_path LIKE 'src1%' AND NOT (lower(file_path) LIKE '%note7%' OR lower(title) LIKE '%note7%') AND lower(title) <> 'x.md'")
def orphan_documents(t):
    return J.orphans(t.notes, resolved(t), ["note7", "x.md"], "src1")


@query(RESOLVED + """SELECT (SELECT count(*) FROM notes) AS total_notes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM resolved)) AS note_edges, (SELECT count(*) FROM unresolved) AS unresolved,
    CAST(0 AS BIGINT) AS ambiguous, CAST(0 AS BIGINT) AS low_confidence, (SELECT count(*) FROM notes WHERE uid NOT IN (SELECT uid FROM linked)) AS orphans,
    round((SELECT count(*) FROM (SELECT DISTINCT src, dst FROM resolved))::DOUBLE / (SELECT count(*) FROM notes), 9) AS avg_outdegree""")
def document_statistics(t):
    r = resolved(t)
    return A.document_statistics(t.notes, r, J.unresolved_links(t.links, r), J.orphans(t.notes, r)).withColumn("avg_outdegree", F.round("avg_outdegree", 9))


@query(G + "SELECT e.src, e.dst, e.rel FROM edges e WHERE e.src IN (SELECT uid FROM symbols WHERE repo_uid = 'nation:1') AND e.dst IN (SELECT uid FROM symbols WHERE repo_uid = 'nation:1') ORDER BY 1, 2, 3 LIMIT 2000")
def induced_subgraph(t):
    return J.induced(t.edges, t.symbols.where("repo_uid = 'nation:1'").select("uid"), 2000).select("src", "dst", "rel")


@query(G + "SELECT DISTINCT CASE WHEN a.repo_uid = 'nation:4' THEN b.repo_uid ELSE a.repo_uid END AS repo_uid FROM edges e JOIN symbols a ON a.uid = e.src JOIN symbols b ON b.uid = e.dst WHERE a.repo_uid <> b.repo_uid AND 'nation:4' IN (a.repo_uid, b.repo_uid)")
def repos_sharing_edges(t):
    return J.repos_sharing_edges(t.edges, t.symbols, "nation:4")


_ONE = given("symbols") + ", o AS (SELECT name, repo_uid, min(uid) AS uid FROM symbols WHERE length(name) >= 6 AND regexp_matches(name, '^[A-Za-z0-9_]+$') GROUP BY ALL)"


@query(_ONE + "SELECT a.name, a.repo_uid AS repo_a, b.repo_uid AS repo_b, a.uid AS uid_a, b.uid AS uid_b, CASE WHEN s.kind = r.kind THEN 'high' ELSE 'medium' END AS confidence FROM o a JOIN o b ON a.name = b.name AND a.repo_uid < b.repo_uid JOIN symbols s ON s.uid = a.uid JOIN symbols r ON r.uid = b.uid")
def symbol_link_discovery(t):
    return J.shared_names(t.symbols)


@query(given("symbols") + """, n AS (SELECT DISTINCT name, repo_uid FROM symbols WHERE length(name) >= 3 AND NOT (length(name) <= 6 AND regexp_matches(name, '^[a-z0-9]+$'))),
    few AS (SELECT name FROM n GROUP BY name HAVING count(*) <= greatest(3, ceil((SELECT count(DISTINCT repo_uid) FROM symbols) * 0.3)))
    SELECT a.repo_uid AS repo_a, b.repo_uid AS repo_b, count(*) AS shared, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM n a JOIN n b ON a.name = b.name AND a.repo_uid < b.repo_uid WHERE a.name IN (SELECT name FROM few) GROUP BY 1, 2 HAVING count(*) >= 2""")
def repo_link_suggestions(t):
    return J.repo_links(t.symbols)


@query(given("symbols") + """SELECT DISTINCT s.repo_uid, p.repo_uid AS package_repo, 'vendor/' || s.name AS dependency, p.name AS package FROM symbols s JOIN symbols p ON s.name = p.name AND s.repo_uid <> p.repo_uid WHERE s.kind = 'Function' AND p.kind = 'Function' AND p.start_line < 500""")
def dependency_links(t):
    d = t.symbols.where("kind = 'Function'").select("repo_uid", F.concat(F.lit("vendor/"), "name").alias("dependency")).distinct()
    p = t.symbols.where("kind = 'Function' and start_line < 500").select(F.col("repo_uid").alias("package_repo"), F.col("name").alias("package")).distinct()
    return J.dependency_links(d, p)


@query(given("contracts") + "SELECT uid, repo_uid, 'declared_not_implemented' AS drift FROM contracts WHERE declared AND NOT implemented UNION ALL SELECT uid, repo_uid, 'implemented_not_declared' FROM contracts WHERE implemented AND NOT declared")
def contract_drift(t):
    c = t.contracts
    return J.contract_drift(c.where("declared"), c.where("implemented"), c.where("implemented"))


@query(given("symbols") + "SELECT i.uid FROM symbols i WHERE i.kind = 'Method' AND EXISTS (SELECT 1 FROM symbols o WHERE o.kind = 'Method' AND o.repo_uid = i.repo_uid AND o.file_path = i.file_path AND i.start_line > o.start_line - 3 AND i.end_line <= o.end_line + 4 AND i.uid <> o.uid)")
def contained_bindings(t):
    wide = t.symbols.where("kind = 'Method'").select("repo_uid", "file_path", F.lit("Outer").alias("kind"), (F.col("start_line") - 3).alias("start_line"), (F.col("end_line") + 4).alias("end_line"), "uid")
    inner = t.symbols.where("kind = 'Method'").select("repo_uid", "file_path", F.lit("Inner").alias("kind"), "start_line", "end_line", "uid")
    got = J.contained_bindings(wide.unionByName(inner), ["Inner"], ["Outer"]).select("repo_uid", "file_path", "uid")
    # every method lies in its own widened span; keep those that lie in another one's
    others = inner.alias("i").join(wide.alias("o"), (F.col("i.repo_uid") == F.col("o.repo_uid")) & (F.col("i.file_path") == F.col("o.file_path")) & (F.col("i.uid") != F.col("o.uid")) & (F.col("i.start_line") > F.col("o.start_line")) & (F.col("i.end_line") <= F.col("o.end_line")), "left_semi")
    return got.join(others.select("uid"), "uid", "left_semi").select("uid")


@query(given("notes") + "SELECT uid, CAST(line AS BIGINT) AS line, CAST(line / 10 AS BIGINT) * 10 + 1 AS start_line FROM (SELECT uid, doc_id % 57 AS line FROM notes) WHERE line % 10 BETWEEN 1 AND 5" .replace("line / 10", "line // 10"))
def mentions_in_sections(t):
    points = t.notes.select("uid", (F.col("doc_id") % 57).cast("long").alias("line"))
    spans = t.notes.select("uid", F.explode(F.array(*[F.lit(k * 10 + 1).cast("long") for k in range(6)])).alias("start_line")).withColumn("end_line", F.col("start_line") + 4)
    return J.point_in_span(points, spans, "uid").select("uid", "line", "start_line")


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
    e AS (SELECT user_id, ts, 0 AS side, event_id AS id FROM s UNION ALL SELECT user_id, ts, 1, event_id FROM t),
    a AS (SELECT *, sum(CASE side WHEN 0 THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, side, id) AS d FROM e),
    b AS (SELECT *, least(0, coalesce(min(d) OVER (PARTITION BY user_id ORDER BY ts, side, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low, CASE side WHEN 0 THEN d ELSE d + 1 END AS level FROM a),
    c AS (SELECT *, (SELECT max((x.ts, x.id)) FROM b x WHERE x.user_id = b.user_id AND x.side = 0 AND x.level = b.level AND (x.ts, 0, x.id) <= (b.ts, b.side, b.id)) AS m FROM b WHERE side = 1 AND d >= low)
    SELECT id AS truth_id, m[2] AS selection_id FROM c WHERE m IS NOT NULL""")
def as_of_match(t):
    e = t.events
    truths = e.where("event_type = 'purchase'").select(F.col("event_id").alias("truth_id"), "user_id", "ts")
    chosen = e.where("event_type = 'view'").select(F.col("event_id").alias("selection_id"), "user_id", "ts")
    return J.as_of(truths, chosen, "user_id")


_DIFF = given("symbols") + """, old AS (SELECT repo_uid || '/' || uid AS key, name, kind, file_path, signature, visibility FROM symbols WHERE kind = 'Function' AND start_line % 7 <> 0),
    new AS (SELECT repo_uid || '/' || CASE WHEN start_line % 13 = 0 THEN 'x' || uid ELSE uid END AS key, CASE WHEN start_line % 13 = 0 THEN 'new_' || name ELSE name END AS name, kind, file_path, CASE WHEN start_line % 11 = 0 THEN 'def(a, b)' ELSE signature END AS signature,
        CASE WHEN start_line % 17 = 0 THEN 'private' WHEN start_line % 19 = 0 THEN 'public' ELSE visibility END AS visibility FROM symbols WHERE kind = 'Function' AND start_line % 6 <> 0)
"""


def versions(t):
    s = t.symbols.where("kind = 'Function'")
    n = F.col("start_line")
    old = s.where(n % 7 != 0).select(F.concat("repo_uid", F.lit("/"), "uid").alias("key"), "name", "kind", "file_path", "signature", "visibility")
    moved = n % 13 == 0
    new = s.where(n % 6 != 0).select(F.concat("repo_uid", F.lit("/"), F.when(moved, F.concat(F.lit("x"), "uid")).otherwise(F.col("uid"))).alias("key"), F.when(moved, F.concat(F.lit("new_"), "name")).otherwise(F.col("name")).alias("name"), "kind", "file_path", F.when(n % 11 == 0, "def(a, b)").otherwise(F.col("signature")).alias("signature"), F.when(n % 17 == 0, "private").when(n % 19 == 0, "public").otherwise(F.col("visibility")).alias("visibility"))
    return old, new


@query(_DIFF + """, b AS (SELECT * FROM old WHERE visibility = 'public'), fresh AS (SELECT * FROM new WHERE key NOT IN (SELECT key FROM old)), gone AS (SELECT * FROM b WHERE key NOT IN (SELECT key FROM new)),
    ren AS (SELECT DISTINCT g.key FROM gone g JOIN fresh f ON g.file_path = f.file_path AND g.signature = f.signature AND g.name <> f.name)
    SELECT b.key, 'signature_changed' AS change FROM b JOIN new USING (key) WHERE b.signature <> new.signature UNION ALL SELECT b.key, 'visibility_reduced' FROM b JOIN new USING (key) WHERE new.visibility <> 'public'
    UNION ALL SELECT key, 'renamed' FROM ren UNION ALL SELECT key, 'removed' FROM gone WHERE key NOT IN (SELECT key FROM ren)""")
def public_api_diff(t):
    return J.api_diff(*versions(t))


@query(_DIFF + """, p AS (SELECT o.key, o.signature AS a, n.signature AS b, o.visibility = 'public' AS x, n.visibility = 'public' AS y FROM old o JOIN new n USING (key)),
    l AS (SELECT *, row_number() OVER (PARTITION BY kind, np ORDER BY key) AS r FROM (SELECT *, CASE WHEN signature = 'def(a, b)' THEN 2 ELSE 1 END AS np FROM old WHERE key NOT IN (SELECT key FROM new))),
    m AS (SELECT *, row_number() OVER (PARTITION BY kind, np ORDER BY key) AS r FROM (SELECT *, CASE WHEN signature = 'def(a, b)' THEN 2 ELSE 1 END AS np FROM new WHERE key NOT IN (SELECT key FROM old)))
    SELECT key, 'signature_changed' AS change FROM p WHERE a <> b UNION ALL SELECT key, CASE WHEN y THEN 'export_added' ELSE 'export_removed' END FROM p WHERE x <> y
    UNION ALL SELECT coalesce(l.key, m.key), CASE WHEN m.key IS NULL THEN 'removed' WHEN l.key IS NULL THEN 'added' ELSE 'renamed' END FROM l FULL JOIN m ON l.kind = m.kind AND l.np = m.np AND l.r = m.r""")
def atomic_symbol_diff(t):
    return J.symbol_diff(*versions(t))


_PAR = """WITH base AS (SELECT p_type AS operation, CASE WHEN p_size % 2 = 0 THEN 'query' ELSE 'path' END AS location, p_brand AS name, CASE WHEN min(p_size) > 3 THEN 'string' ELSE 'integer' END AS type, max(p_size) > 40 AS required FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL),
    head AS (SELECT p_type AS operation, CASE WHEN p_size % 2 = 0 THEN 'query' ELSE 'path' END AS location, p_brand AS name, CASE WHEN min(p_size) > 4 THEN 'string' ELSE 'integer' END AS type, max(p_size) > 44 AS required FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL)
"""


@query(_PAR + """, j AS (SELECT operation, location, name, CASE WHEN h.type IS NULL THEN 'removed' WHEN b.type IS NULL THEN CASE WHEN h.required THEN 'added_required' ELSE 'added_optional' END WHEN b.type <> h.type THEN 'type_changed' WHEN h.required AND NOT b.required THEN 'now_required' WHEN b.required AND NOT h.required THEN 'now_optional' END AS change FROM base b FULL JOIN head h USING (operation, location, name))
    SELECT *, CASE WHEN change IN ('added_optional', 'now_optional') THEN 'info' ELSE 'breaking' END AS severity FROM j WHERE change IS NOT NULL""")
def openapi_parameter_diff(t):
    def side(drop, low, high):
        p = t.part.where(F.col("p_partkey") % drop != 0)
        return p.groupBy(F.col("p_type").alias("operation"), F.when(F.col("p_size") % 2 == 0, "query").otherwise("path").alias("location"), F.col("p_brand").alias("name")).agg(F.when(F.min("p_size") > low, "string").otherwise("integer").alias("type"), (F.max("p_size") > high).alias("required"))

    return J.parameter_diff(side(3, 3, 40), side(4, 4, 44))


@query(given("symbols", "notes", "links") + "SELECT count(*) AS added, 0::BIGINT AS removed FROM (SELECT DISTINCT src, target FROM links WHERE src LIKE '%3')")
def link_reconcile(t):
    new = t.links.select("src", "target").distinct()
    got = J.reconcile(new.where(~F.col("src").endswith("3")), new, ["src", "target"])
    return got.agg(F.count_if(F.col("action") == "add").alias("added"), F.count_if(F.col("action") == "remove").alias("removed"))


@query(given("symbols") + "SELECT uid AS key, kind, CASE WHEN start_line % 2 = 0 THEN CASE WHEN start_line % 3 = 0 THEN 'both' ELSE 'local' END ELSE 'server' END AS tier FROM symbols WHERE start_line % 2 = 0 OR start_line % 3 = 0")
def two_tier_union(t):
    s = t.symbols.select(F.col("uid").alias("key"), "kind", "start_line")
    return J.federated_union(s.where("start_line % 2 = 0"), s.where("start_line % 3 = 0")).select("key", "kind", "tier")


# --- statistics


@query(G + """, own AS (SELECT uid FROM symbols WHERE kind IN ('Class', 'Method', 'Function')), e AS (SELECT src, dst FROM edges WHERE src IN (SELECT uid FROM own) AND dst IN (SELECT uid FROM own)),
    d AS (SELECT uid, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS uid, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY uid)
    SELECT uid, in_degree, out_degree, in_degree + out_degree AS total_degree, (SELECT count(*) FROM d) AS candidate_total FROM d ORDER BY total_degree DESC, uid LIMIT 10""")
def hubs(t):
    return A.hubs(t.edges, t.symbols, ["Class", "Method", "Function"], 10)


@query(G + """, d AS (SELECT uid, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS uid, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY uid)
    SELECT uid, CASE WHEN n_in = 0 AND n_out = 0 THEN 'isolated' WHEN n_in >= 3 * n_out THEN 'sink' WHEN n_out >= 3 * n_in THEN 'orchestrator' ELSE 'bridge' END AS role FROM d""")
def hub_roles(t):
    ends = t.edges.select(F.explode(F.array(F.struct(F.col("src").alias("uid"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("uid"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.uid").agg(F.sum("x.i").alias("n_in"), F.sum(1 - F.col("x.i")).alias("n_out")).select("uid", S.hub_role("n_in", "n_out").alias("role"))


@query(given("commits") + """, t AS (SELECT file, count(*) AS total FROM commits GROUP BY file), o AS (SELECT * FROM commits WHERE file IN (SELECT file FROM t WHERE total >= 2)),
    p AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS n FROM o a JOIN o b ON a.commit_id = b.commit_id AND a.file < b.file GROUP BY ALL HAVING count(*) >= 2)
    SELECT file_a, file_b, n, x.total AS total_a, y.total AS total_b, round(n / (x.total + y.total - n), 9) AS confidence FROM p JOIN t x ON x.file = file_a JOIN t y ON y.file = file_b WHERE n / (x.total + y.total - n) >= 0.03""")
def cochange(t):
    return A.cochange(t.commits, 2, 0.03).withColumn("confidence", F.round("confidence", 9))


NOW = 1_000_000_000.0


@query(given("commits") + f""", n AS (SELECT commit_id, count(*) AS n FROM commits GROUP BY 1), cut AS (SELECT quantile_disc(n, 0.9) AS c FROM n),
    k AS (SELECT file, commit_id, epoch(authored) AS e, row_number() OVER (PARTITION BY file ORDER BY authored DESC, commit_id DESC) AS r FROM commits WHERE commit_id IN (SELECT commit_id FROM n WHERE n <= (SELECT c FROM cut)))
    SELECT file, round(avg(exp(-greatest(0, ({NOW} - e) / 86400) / 180)), 9) AS score FROM k WHERE r <= 20 GROUP BY file""")
def recency_scores(t):
    return A.recency(t.commits, NOW).withColumn("score", F.round("score", 9))


@query(given("commits") + ", n AS (SELECT commit_id, count(*) AS n FROM commits GROUP BY 1) SELECT CAST(quantile_disc(n, 0.9) AS BIGINT) AS cutoff FROM n")
def bulk_cutoff(t):
    return A.bulk_cutoff(t.commits)


@query(given("tags") + """, d AS (SELECT DISTINCT note_uid, tag, lower(tag) = 'size' OR lower(tag) LIKE 'size/%' AS hit FROM tags), f AS (SELECT DISTINCT note_uid FROM d WHERE hit)
    SELECT 'size' AS tag, 'focus' AS role, count(*) AS n FROM f UNION ALL SELECT 'size', 'exact', count(DISTINCT note_uid) FROM d WHERE lower(tag) = 'size'
    UNION ALL SELECT tag, CASE WHEN hit THEN 'descendant' ELSE 'co_occurring' END, count(*) FROM d WHERE note_uid IN (SELECT note_uid FROM f) AND lower(tag) <> 'size' GROUP BY tag, hit""")
def tag_graph(t):
    return A.tag_graph(t.tags, "#size")


@query(given("tags") + ", d AS (SELECT DISTINCT note_uid, tag FROM tags) SELECT a.tag, b.tag AS other, count(*) AS n FROM d a JOIN d b ON a.note_uid = b.note_uid AND a.tag <> b.tag AND NOT starts_with(b.tag, a.tag || '/') GROUP BY ALL")
def tag_graph_all(t):
    return A.tag_pairs(t.tags)


@query(given("interactions") + """, c AS (SELECT uid, count(*) FILTER (kind = 'access') AS a, count(*) FILTER (kind = 'seed') AS q, count(*) FILTER (kind = 'used') AS u, count(*) FILTER (kind = 'shown') AS s, count(*) FILTER (kind = 'terminal') AS t, count(DISTINCT session) AS ns, max(ts) AS last FROM interactions GROUP BY uid)
    SELECT uid, round(greatest(ln(1 + 0.3 * a + 0.5 * q + 1.0 * u + 0.1 * s + 1.5 * t) * exp(-0.05 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(last)) / 86400e6), CASE WHEN ns >= 3 THEN 0.1 ELSE 0.0 END), 9) AS score FROM c""")
def interaction_scores(t):
    return A.decay_scores(t.interactions, F.lit("2024-02-01").cast("timestamp")).select("uid", F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session, 'k' || (event_id % 3) AS uid, CASE WHEN event_type = 'view' THEN 'access' ELSE 'shown' END AS kind FROM events),
    w AS (SELECT *, max(CASE WHEN kind <> 'access' THEN epoch_us(ts) END) OVER (PARTITION BY session, uid ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
    SELECT event_id, uid, round((epoch_us(ts) - last) / 1e6, 6) AS gap FROM w WHERE kind = 'access' AND (epoch_us(ts) - last) / 1e6 <= 20000""")
def follow_ups(t):
    e = t.events.select("event_id", "ts", F.col("user_id").cast("string").alias("session"), F.concat(F.lit("k"), F.col("event_id") % 3).alias("uid"), F.when(F.col("event_type") == "view", "access").otherwise("shown").alias("kind"))
    return A.follow_ups(e, 20000).withColumn("gap", F.round("gap", 6))


_RANK = """WITH q AS (SELECT vec_id, label, vec_id % 20 AS query FROM embeddings), r AS (SELECT query, vec_id, label, row_number() OVER (PARTITION BY query ORDER BY vec_id * 37 % 101, vec_id) AS rank FROM q), g AS (SELECT *, CASE WHEN label = query % 10 THEN 2 WHEN label % 5 = query % 5 THEN 1 ELSE 0 END AS grade FROM r),
    i AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, vec_id) AS ir FROM g)
    SELECT 'q' || query AS query, round(CASE WHEN sum(CASE WHEN ir <= 5 THEN (pow(2, grade) - 1) / log2(ir + 1) ELSE 0 END) > 0 THEN sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN ir <= 5 THEN (pow(2, grade) - 1) / log2(ir + 1) ELSE 0 END) ELSE 0 END, 9) AS ndcg,
        round(coalesce(1.0::DOUBLE / min(CASE WHEN grade >= 1 THEN rank END), 0), 9) AS mrr, round(count(*) FILTER (rank <= 5 AND grade >= 1) / least(5, count(*))::DOUBLE, 9) AS precision FROM i GROUP BY query"""


@query(_RANK)
def ranking_metrics(t):
    from pyspark.sql import Window as W

    e = t.embeddings.select(F.col("vec_id").alias("v"), "label", (F.col("vec_id") % 20).alias("q"))
    ranked = e.select(F.concat(F.lit("q"), "q").alias("query"), F.format_string("%08d", "v").alias("uid"), F.row_number().over(W.partitionBy("q").orderBy(F.col("v") * 37 % 101, "v")).alias("rank"))
    grade = F.when(F.col("label") == F.col("q") % 10, 2).when(F.col("label") % 5 == F.col("q") % 5, 1).otherwise(0)
    judged = e.select(F.concat(F.lit("q"), "q").alias("query"), F.format_string("%08d", "v").alias("uid"), grade.alias("grade"))
    return A.ranking_metrics(ranked, judged, 5).select("query", *[F.round(c, 9).alias(c) for c in ("ndcg", "mrr", "precision")])


@query(given("symbols") + "SELECT uid, CAST(running AS BIGINT) AS running FROM (SELECT uid, sum(length(name)) OVER (ORDER BY start_line DESC, uid) AS running FROM symbols WHERE kind = 'Function') WHERE running <= 2000")
def token_budget(t):
    s = t.symbols.where("kind = 'Function'").withColumn("size", F.length("name"))
    return A.within_budget(s, "size", 2000, F.desc("start_line"), F.col("uid")).select("uid", "running")


@query(G + "SELECT dst AS uid, src FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src) AS r FROM edges WHERE rel = 'CALLS') WHERE r = 1")
def best_caller(t):
    e = t.edges.where("rel = 'CALLS'")
    return A.best_per_key(e, "dst", F.desc("confidence"), F.col("src")).select(F.col("dst").alias("uid"), "src")


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 7200 * 1000000::BIGINT THEN 1 ELSE 0 END AS n FROM events)
    SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM e""")
def sessions(t):
    from graphloom.streaming.ingest import session_gaps

    return session_gaps(t.events, 7200).select("event_id", "session_no")


@query("""WITH j AS (SELECT event_id % 50 AS repo, event_id AS seq, value, event_type = 'error' AS deleted FROM events), l AS (SELECT repo, max_by(value, seq) AS value, max_by(deleted, seq) AS deleted FROM j GROUP BY repo) SELECT repo, value FROM l WHERE NOT deleted""")
def journal_replay(t):
    from graphloom.streaming.ingest import latest

    j = t.events.select((F.col("event_id") % 50).alias("repo"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("deleted"))
    return latest(j, "repo", "seq").select("repo", "value")


_JOBS = """WITH r AS (SELECT 'r' || (user_id % 30) AS repo, CAST(event_id % 5 AS INTEGER) AS priority, ts, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state FROM events),
    q AS (SELECT repo, min(priority) AS priority, min(ts) AS created, max_by(state, ts) AS last, max(ts) AS last_ts, max(ts) FILTER (state = 'running') AS run FROM r GROUP BY repo)
    SELECT repo, priority, CASE WHEN last IN ('done', 'failed') THEN 'pending' ELSE last END AS state, run IS NOT NULL AND last_ts > run AS requeue FROM q"""


@query(_JOBS)
def job_queue(t):
    from graphloom.streaming.ingest import job_queue as queue

    state = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("pending")
    r = t.events.select(F.concat(F.lit("r"), F.col("user_id") % 30).alias("repo"), (F.col("event_id") % 5).cast("int").alias("priority"), "ts", state.alias("state"))
    return queue(r).select("repo", "priority", "state", F.coalesce("requeue", F.lit(False)).alias("requeue"))

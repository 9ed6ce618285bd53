"""Edges derived from facts, lint, projects, diagnostics."""

from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators import aggregates as A
from graphloom.operators import annotations as AN
from graphloom.operators import derive as D
from graphloom.operators import graph as GR
from graphloom.operators import joins as J
from graphloom.operators import scopes as SC
from graphloom.queries.joined import RESOLVED, resolved
from graphloom.registry import given, query


@query(given("symbols") + """, f AS (SELECT DISTINCT file_path FROM symbols), i AS (SELECT DISTINCT 'parts/main.py' AS from_file, './' || lower(p_type) AS specifier, 'parts/' || lower(p_type) || '.py' AS file FROM part UNION SELECT 'parts/main.py', '@t/' || lower(p_type), 'tests/' || lower(p_type) || '.py' FROM part)
    SELECT from_file, specifier, file FROM i WHERE file IN (SELECT file_path FROM f)""")
def import_resolution(t):
    kinds = t.part.select(F.lower("p_type").alias("k")).distinct()
    imports = kinds.select(F.lit("parts/main.py").alias("from_file"), F.explode(F.array(F.concat(F.lit("./"), "k"), F.concat(F.lit("@t/"), "k"))).alias("specifier"))
    return D.resolve_specifiers(imports, t.symbols.select(F.col("file_path").alias("file")), {"@t/": "tests/"})


_MEN = "SELECT DISTINCT 'note:' || d.doc_id AS note_uid, replace(p.p_name, ' ', '_') AS name, d.doc_id % 2 = 0 AS in_code FROM documents d JOIN part p ON p.p_partkey = d.doc_id"


@query(given("symbols", m=_MEN) + """, n AS (SELECT name, count(DISTINCT (repo_uid, file_path)) AS k FROM symbols GROUP BY name)
    SELECT note_uid, uid, round(CASE kind WHEN 'Function' THEN 0.9 WHEN 'Method' THEN 0.7 ELSE 0.8 END * CASE WHEN in_code THEN 1.0 ELSE 0.85 END::DOUBLE / k, 9) AS confidence FROM m JOIN symbols USING (name) JOIN n USING (name)""")
def mention_links(t):
    m = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id")).select(F.concat(F.lit("note:"), "doc_id").alias("note_uid"), F.translate("p_name", " ", "_").alias("name"), (F.col("doc_id") % 2 == 0).alias("in_code")).distinct()
    return D.resolve_mentions(m, t.symbols, 9)


@query(given("symbols", "edges") + """, k0 AS (SELECT uid AS var, name AS type, 0.85::DOUBLE AS c FROM symbols WHERE kind = 'Class' AND start_line % 3 = 0), a AS (SELECT src AS var, dst AS source FROM edges WHERE rel IN ('IMPORTS', 'CALLS')),
    k1 AS (SELECT * FROM k0 UNION ALL SELECT a.var, max_by(type, (c, type)), max(c) * 0.95 FROM a JOIN k0 ON k0.var = a.source WHERE a.var NOT IN (SELECT var FROM k0) GROUP BY a.var),
    k2 AS (SELECT * FROM k1 UNION ALL SELECT a.var, max_by(type, (c, type)), max(c) * 0.95 FROM a JOIN k1 ON k1.var = a.source WHERE a.var NOT IN (SELECT var FROM k1) GROUP BY a.var) SELECT var, type, round(c, 9) AS confidence FROM k2""")
def type_propagation(t):
    calls = t.symbols.where("kind = 'Class' and start_line % 3 = 0").select(F.col("uid").alias("var"), F.col("name").alias("target"))
    known = D.constructor_types(calls, t.symbols)
    a = t.edges.where("rel in ('IMPORTS', 'CALLS')").select(F.col("src").alias("var"), F.col("dst").alias("source"))
    return D.propagate_types(known, a, 2).withColumn("confidence", F.round("confidence", 9))


_TYPED = ", typed AS (SELECT DISTINCT r.src, r.dst, CASE WHEN n.doc_id % 4 = 1 THEN 'SUPERSEDES' WHEN n.doc_id % 4 = 2 THEN 'DEPENDS_ON' ELSE 'RELATES_TO' END AS rel FROM resolved r JOIN notes n ON n.uid = r.src WHERE candidates = 1 AND r.src <> r.dst AND n.doc_id % 4 <> 0)"


def typed(t, r):
    key = F.when(F.col("doc_id") % 4 == 1, "supersedes").when(F.col("doc_id") % 4 == 2, "depends-on").otherwise("See also")
    refs = t.links.distinct().join(t.notes.select(F.col("uid").alias("src"), "doc_id"), "src").where("doc_id % 4 <> 0").select("src", "target", key.alias("key"))
    return D.typed_note_edges(refs, r)


@query(RESOLVED + _TYPED + "SELECT src, dst, rel FROM typed")
def typed_note_edges(t):
    return typed(t, resolved(t)).select("src", "dst", "rel")


@query(RESOLVED + """, g AS (SELECT DISTINCT src, dst FROM resolved WHERE src <> dst),
    p AS (WITH RECURSIVE w(first, last, path) AS (SELECT src, dst, [src, dst] FROM g WHERE dst > src UNION ALL SELECT w.first, g.dst, list_append(w.path, g.dst) FROM w JOIN g ON g.src = w.last WHERE g.dst > w.first AND NOT list_contains(w.path, g.dst) AND len(w.path) < 7) SELECT * FROM w)
    SELECT DISTINCT CAST(len(path) AS INTEGER) AS length, array_to_string(list_sort(path), ',') AS members FROM p JOIN g ON g.src = p.last AND g.dst = p.first""")
def supersession_cycles(t):
    """Cycles of at most 7 notes that lead to one another."""
    return GR.elementary_cycles(resolved(t).where("src <> dst"), 7)


_NOW = 1_704_067_200.0
_EPOCH = "epoch(CAST(replace(replace(modified_at, 'T', ' '), 'Z', '') AS TIMESTAMP))"


@query(RESOLVED + _TYPED + f""", s AS (SELECT * FROM typed WHERE rel = 'SUPERSEDES')
    SELECT 'stale' AS category, uid FROM notes WHERE note_kind = 'idea' AND ({_NOW} - {_EPOCH}) / 86400 > 90 UNION ALL SELECT 'orphan', uid FROM notes WHERE uid NOT IN (SELECT uid FROM linked)
    UNION ALL SELECT DISTINCT 'broken', src FROM unresolved UNION ALL SELECT DISTINCT 'low_confidence', src FROM resolved WHERE confidence < 1 UNION ALL SELECT DISTINCT 'supersession_chain', a.src FROM s a JOIN s b ON b.src = a.dst
    UNION ALL SELECT DISTINCT 'contradiction', a.src FROM s a JOIN s b ON b.src = a.dst AND b.dst = a.src UNION ALL SELECT 'schema_drift', uid FROM notes WHERE note_kind IS NULL OR title IS NULL OR title = ''""")
def memory_lint(t):
    r = resolved(t)
    return D.memory_lint(t.notes, typed(t, r), r, J.unresolved_links(t.links, r), J.orphans(t.notes, r), _NOW)


@query(RESOLVED + f"SELECT dst AS uid, count(DISTINCT src) AS ideas FROM resolved WHERE src IN (SELECT uid FROM notes WHERE note_kind = 'idea') AND dst IN (SELECT uid FROM notes WHERE note_kind = 'log' AND ({_NOW} - {_EPOCH}) / 86400 > 14) GROUP BY dst HAVING count(DISTINCT src) >= 1")
def consolidation(t):
    return D.consolidation(t.notes, resolved(t), _NOW, 1)


@query(RESOLVED + _TYPED + """, a AS (SELECT dst AS uid, 1 AS depth FROM typed WHERE src = 'note:5' UNION SELECT src, 1 FROM typed WHERE dst = 'note:5'), b AS (SELECT t.dst AS uid, 2 AS depth FROM a JOIN typed t ON t.src = a.uid UNION SELECT t.src, 2 FROM a JOIN typed t ON t.dst = a.uid)
    SELECT uid, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE uid <> 'note:5' GROUP BY uid""")
def memory_related(t):
    from graphloom.operators.graph import bfs

    e = typed(t, resolved(t))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "confidence"))
    return bfs(both, t.spark.createDataFrame([("note:5",)], "uid string"), 2).where("depth > 0")


@query(given("symbols", "notes") + "SELECT 'p' || n_nationkey AS project, s.uid, 'symbol' AS kind FROM nation JOIN symbols s ON s.repo_uid = 'nation:' || n_nationkey WHERE n_nationkey < 5 UNION SELECT 'p' || n_nationkey, uid, 'note' FROM nation JOIN notes ON split_part(file_path, '/', 1) = 'src' || n_nationkey WHERE n_nationkey < 5")
def project_members(t):
    p = t.nation.where("n_nationkey < 5").select(F.concat(F.lit("p"), "n_nationkey").alias("project"), F.concat(F.lit("nation:"), "n_nationkey").alias("repo_uid"), F.concat(F.lit("src"), "n_nationkey").alias("folder"))
    return D.project_members(p, t.symbols, t.notes)


@query(given("notes") + ", f AS (SELECT split_part(file_path, '/', 1) AS project, doc_id FROM notes) SELECT project, count(*) AS notes FROM f WHERE project IN (SELECT project FROM f WHERE doc_id % 50 = 7) GROUP BY project")
def implicit_projects(t):
    n = t.notes.select(F.concat(F.lit("projects/"), F.substring_index("file_path", "/", 1), F.lit("/"), F.when(F.col("doc_id") % 50 == 7, "README.md").otherwise(F.substring_index("file_path", "/", -1))).alias("file_path"))
    return D.implicit_projects(n, "projects")


@query(given("symbols") + """, e AS (SELECT uid, repo_uid AS label, start_line::DOUBLE AS score, lower(name) = 'red_widget' AS exact FROM symbols WHERE name LIKE '%red%'), g AS (SELECT label, count(*) AS entries, bool_or(exact) AS exact, max(score) AS score FROM e GROUP BY label)
    SELECT label, entries, CAST(row_number() OVER (ORDER BY exact DESC, score DESC, label) AS INTEGER) AS position FROM g""")
def investigate_domains(t):
    from graphloom.plans.answers import investigate

    hits = t.symbols.where(F.col("name").contains("red")).select("uid", "name", F.col("repo_uid").alias("label"), F.col("start_line").cast("double").alias("score"))
    return investigate(hits, "red_widget").select("label", "entries", "position")


@query("""WITH s AS (SELECT 'sha' || (o_orderkey // 2) AS sha, o_orderkey AS id, o_custkey % 7 AS a FROM orders), p AS (SELECT x.id AS t, y.id AS s, x.a AS f, y.a AS g FROM s x JOIN s y ON x.sha = y.sha AND x.id % 2 = 1 AND y.id % 2 = 0)
    SELECT count(*) AS n_joined, round(avg((f = g)::INT::DOUBLE), 9) AS file_recall, round(avg((f = g)::INT::DOUBLE), 9) AS change_recall, round(avg(1.0::DOUBLE / 7), 9) AS breadth FROM p""")
def selection_evaluation(t):
    """Odd orders are what failed, even ones what was selected for the same change."""
    o = t.orders.select(F.concat(F.lit("sha"), F.expr("o_orderkey div 2")).alias("sha"), "o_orderkey", F.array((F.col("o_custkey") % 7).cast("string")).alias("files"))
    joined = o.where("o_orderkey % 2 = 1").select("sha", F.col("o_orderkey").alias("truth_id"), F.col("files").alias("failed")).join(o.where("o_orderkey % 2 = 0").select("sha", F.col("files").alias("selected")), "sha").withColumn("total", F.lit(7))
    return A.selection_report(joined).select("n_joined", *[F.round(c, 9).alias(c) for c in ("file_recall", "change_recall", "breadth")])


@query(given("symbols", "edges") + "SELECT s.uid, s.name FROM edges e JOIN symbols s ON s.uid = e.src WHERE e.rel = 'MEMBER_OF' AND e.dst = 'nation:3'")
def members(t):
    return J.neighbours(t.edges, t.symbols, "nation:3", "in", ["MEMBER_OF"]).select("uid", "name")


@query(given("edges") + "SELECT dst AS uid, rel, round(confidence, 9) AS confidence FROM edges WHERE src = 'sup:5' AND rel IN ('CALLS', 'IMPORTS', 'EXTENDS_SYM', 'CROSS_REPO_LINK') AND confidence >= 0.5")
def outgoing_impact_edges(t):
    from graphloom import model

    return t.edges.where((F.col("src") == "sup:5") & F.col("rel").isin(*model.IMPACT_RELATIONS) & (F.col("confidence") >= 0.5)).select(F.col("dst").alias("uid"), "rel", F.round("confidence", 9).alias("confidence"))


_SEC = ", sec AS (SELECT uid AS note_uid, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS body FROM notes), s AS (SELECT * FROM sec WHERE trim(body) <> '')"


@query(given("notes") + _SEC + "SELECT note_uid, CAST(count(*) FILTER (regexp_matches(body, '^#{1,6} ')) AS BIGINT) AS headings, CAST(count(*) FILTER (NOT regexp_matches(body, '^#{1,6} ')) AS BIGINT) AS sections FROM s GROUP BY note_uid")
def structure_counts(t):
    from graphloom.operators.notes import structure_counts as counts

    return counts(t.notes)


@query(given("notes") + _SEC + "SELECT 'sec:' || note_uid || ':' || line AS uid, note_uid FROM s WHERE note_uid IN (SELECT uid FROM notes WHERE modified_at >= '2024-08-01T00:00:00Z')")
def sections_modified_since(t):
    from graphloom.operators.notes import sections_modified_since as since

    return since(t.notes, "2024-08-01")


@query(RESOLVED.replace("WITH notes", f"WITH tags AS ({__import__('graphloom.adapters', fromlist=['oracle']).oracle('tags')}), notes", 1) + """, sec AS (SELECT uid AS note_uid, unnest(string_split(text, chr(10))) AS body FROM notes) SELECT rel, count(*) AS n FROM (SELECT 'NOTE_HAS_SECTION' AS rel FROM sec WHERE trim(body) <> '' UNION ALL SELECT 'NOTE_TAGGED_WITH' FROM (SELECT DISTINCT * FROM tags) UNION ALL SELECT 'WIKILINK_TO_NOTE' FROM resolved) GROUP BY rel""")
def vault_typed_edges(t):
    from graphloom.operators.notes import note_edges

    return note_edges(t.notes, t.tags, resolved(t)).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query()
def unified_rank(t):
    """Personalised rank over notes, tags and code together, around a note."""
    from graphloom.operators import graph as GR
    from graphloom.operators.notes import note_edges
    from graphloom.plans.iterate import cut

    r = resolved(t)
    mention = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id")).select(F.concat(F.lit("note:"), "doc_id").alias("src"), F.concat(F.lit("part:"), "p_partkey").alias("dst"), F.lit(0.85).alias("confidence"))
    every = cut(note_edges(t.notes, t.tags, cut(r), mention).unionByName(t.edges.select("src", "dst", "rel", "confidence")))
    nodes = cut(every.select(F.explode(F.array("src", "dst")).alias("uid")).distinct())
    return GR.personalized_pagerank(nodes, GR.scope_edges(every, "unified"), ["note:1"], 0.75, back=model.REVERSE_WEIGHT).withColumn("score", F.round("score", 8))


@query(given("symbols") + """SELECT s.uid, round(s.start_line * greatest(0.4, least(1.6, coalesce(1 + 1.2 * (a.s - 0.5), 1.0)))::DOUBLE, 6) AS score FROM symbols s LEFT JOIN (SELECT uid, (end_line % 10)::DOUBLE / 10 AS s FROM symbols WHERE kind = 'Function') a USING (uid) ORDER BY score DESC, uid LIMIT 30""")
def top_by_rank_and_activity(t):
    from graphloom.functions import scalar as S

    s = t.symbols
    activity = s.where("kind = 'Function'").select("uid", (F.col("end_line") % 10 / F.lit(10.0)).alias("s"))
    j = s.join(activity, "uid", "left")
    return j.select("uid", F.round(F.col("start_line") * S.activity_multiplier("s"), 6).alias("score")).orderBy(F.desc("score"), "uid").limit(30)


@query(given("symbols", "edges") + """, d AS (SELECT uid, count(*) AS n FROM (SELECT src AS uid FROM edges UNION ALL SELECT dst FROM edges) GROUP BY uid), h AS (SELECT uid, n FROM d ORDER BY n DESC, uid LIMIT 15) SELECT h.uid, s.repo_uid AS cluster FROM h LEFT JOIN symbols s USING (uid)""")
def hub_clusters(t):
    ends = t.edges.select(F.explode(F.array("src", "dst")).alias("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "uid").limit(15)
    return ends.join(t.symbols.select("uid", F.col("repo_uid").alias("cluster")), "uid", "left").select("uid", "cluster")


@query(given("interactions") + "SELECT split_part(uid, ':', 1) AS prefix, uid, n FROM (SELECT uid, count(*) AS n FROM interactions GROUP BY uid) ORDER BY n DESC, uid LIMIT 12")
def top_uids_by_kind(t):
    n = A.interaction_counts(t.interactions).select("uid", (F.col("access") + F.col("seeds") + F.col("used") + F.col("shown") + F.col("terminal")).alias("n"))
    return n.where(F.col("uid").startswith("part:")).select(F.substring_index("uid", ":", 1).alias("prefix"), "uid", "n").orderBy(F.desc("n"), "uid").limit(12)


@query(given("symbols") + """SELECT * FROM (SELECT 'class' AS kind, uid, start_line::DOUBLE AS score FROM symbols WHERE kind = 'Class' ORDER BY score DESC, uid LIMIT 5) UNION ALL SELECT * FROM (SELECT 'function', uid, start_line::DOUBLE AS score FROM symbols WHERE kind = 'Function' ORDER BY score DESC, uid LIMIT 5)""")
def overview_landmarks(t):
    from graphloom.operators.notes import landmarks

    s = t.symbols.withColumn("score", F.col("start_line").cast("double"))
    return landmarks(5, **{"class": s.where("kind = 'Class'"), "function": s.where("kind = 'Function'")})


@query(given("symbols") + """SELECT uid, CASE WHEN file_path LIKE '%.go' AND kind = 'Method' AND uid LIKE '%0' THEN 'HttpHandler' WHEN file_path LIKE '%.py' AND name LIKE 'red%' THEN 'TestEntry' WHEN file_path LIKE '%.rs' THEN 'Main' END AS entry,
    CASE WHEN file_path LIKE '%.java' THEN 'spring/service' END AS framework FROM symbols""")
def entry_point_kinds(t):
    from graphloom.functions import conventions as C
    from graphloom.functions import scalar as S

    s = t.symbols
    go = F.col("file_path").endswith(".go") & (F.col("kind") == "Method") & F.col("uid").endswith("0")
    name = F.when(go, F.concat("name", F.lit("Handler"))).when(F.col("file_path").endswith(".py") & F.col("name").startswith("red"), F.concat(F.lit("test_"), "name")).when(F.col("file_path").endswith(".rs"), "main").otherwise(F.lit("x"))
    sig = F.when(F.col("file_path").endswith(".java"), "@Service class").otherwise(F.lit(""))
    lang = S.language("file_path")
    return s.select("uid", C.entry_point_kind(lang, name, F.col("file_path"), sig, F.col("kind")).alias("entry"), C.framework_hint(lang, name, F.col("file_path"), sig, F.col("kind")).alias("framework"))


@query(given("symbols") + """SELECT uid, CASE WHEN start_line % 3 = 0 THEN 'info' WHEN start_line % 3 = 1 THEN 'breaking' ELSE 'warning' END AS severity FROM symbols WHERE kind = 'Function'""")
def signature_severities(t):
    from graphloom.functions import conventions as C

    n = F.col("start_line") % 3
    new = F.when(n == 0, "f(a, b=1)").when(n == 1, "f()").otherwise(F.lit("f(a: int)"))
    return t.symbols.where("kind = 'Function'").select("uid", C.signature_severity(F.lit("f(a)"), new, F.col("file_path")).alias("severity"))


@query(given("edges") + "SELECT src, dst, CASE WHEN confidence >= 0.5 THEN 'breaking' ELSE 'warning' END AS severity FROM edges WHERE rel = 'CALLS' AND confidence >= 0.25 AND dst = 'sup:9'")
def severity_filter(t):
    from graphloom.functions import conventions as C
    from graphloom.functions import scalar as S

    e = t.edges.where("rel = 'CALLS' and dst = 'sup:9'").withColumn("severity", S.org_severity("confidence"))
    return e.where(C.at_least(F.col("severity"), "warning")).select("src", "dst", "severity")


@query(given("notes") + "SELECT uid FROM notes WHERE regexp_matches(lower(text), 'apache license, version') ORDER BY uid")
def phrase_search(t):
    from graphloom.operators import retrieval as RT

    from graphloom.queries.text import index

    return RT.boolean_search(t.notes, *index(t), '"apache license version" AND note').select("uid")


@query(RESOLVED + """, one AS (SELECT lower(title) AS t, vault_uid AS v FROM notes WHERE uid = 'note:1') SELECT n.uid FROM notes n, one WHERE n.vault_uid = one.v AND n.uid <> 'note:1' AND contains(lower('see Note 1 en ' || n.text), one.t) AND n.uid NOT IN (SELECT src FROM resolved WHERE dst = 'note:1')""")
def unlinked_mentions(t):
    n = t.notes.withColumn("text", F.concat(F.lit("see Note 1 en "), "text"))
    return J.unlinked_mentions(n, resolved(t), "note:1").select("uid")


#: Property bags written by events: a key for the event's type, with nested values, and one for its user; some take their key away, some are no objects.
_BAGS = """SELECT 'part:' || (event_id % (n + 7)) AS uid, event_id AS seq, CASE WHEN event_id % 29 = 0 THEN '[1, 2]' ELSE '{{"' || event_type || '": ' || CASE WHEN event_id % 17 = 0 THEN 'null' ELSE '{{"value": ' || CAST(CAST(round(value) AS BIGINT) AS VARCHAR(20)) || ', "props": ' || coalesce(props, 'null') || '}}' END
    || ', "user": ' || CASE WHEN event_id % 3 = 0 THEN CAST(user_id AS VARCHAR(20)) ELSE '"u' || CAST(user_id AS VARCHAR(20)) || '"' END || '}}' END AS bag FROM {events}, (SELECT count(*) AS n FROM {part}) AS t"""
_WRITES = given("symbols") + ", w AS (" + _BAGS.format(events="events", part="part") + """), o AS (SELECT uid, seq, bag::JSON AS bag FROM w WHERE json_valid(bag) AND json_type(bag::JSON) = 'OBJECT'),
    k AS (SELECT uid, seq, unnest(json_keys(bag)) AS key, bag FROM o), l AS (SELECT uid, key, arg_max(json_extract(bag, '$.' || key), seq) AS v FROM k GROUP BY uid, key), live AS (SELECT * FROM l WHERE json_type(v) <> 'NULL')"""


def _bags(t):
    writes = t.spark.sql(_BAGS, events=t.events, part=t.part)
    half = F.col("seq") % 2 == 0
    return AN.bags(AN.merged(AN.entries(writes.where(half)), writes.where(~half)))


@query(_WRITES + """SELECT s.uid, (SELECT TRY_CAST(json_extract_string(v, '$.value') AS DOUBLE) FROM live WHERE live.uid = s.uid AND key = 'view') AS viewed, (SELECT TRY_CAST(json_extract_string(v, '$.props.k') AS DOUBLE) FROM live WHERE live.uid = s.uid AND key = 'click') AS clicked,
    (SELECT CASE WHEN json_type(v) = 'VARCHAR' THEN json_extract_string(v, '$') ELSE CAST(v AS VARCHAR) END FROM live WHERE live.uid = s.uid AND key = 'user') AS by_user FROM symbols s WHERE kind = 'Function'""")
def node_annotations(t):
    return AN.annotated(t.symbols.where("kind = 'Function'").select("uid"), _bags(t), viewed=("view.value", "double"), clicked=("click.props.k", "double"), by_user=("user", "string"))


@query(_WRITES + "SELECT CASE WHEN uid IN (SELECT uid FROM symbols) THEN 'annotated' ELSE 'orphaned' END AS state, count(DISTINCT uid) AS nodes FROM live GROUP BY 1")
def annotation_audit(t):
    return AN.audit(t.symbols, _bags(t))


_RANGES = """SELECT 'cust:' || o_custkey AS file, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS start, CAST(epoch(o_orderdate) / 86400 AS BIGINT) + CASE o_orderstatus WHEN 'F' THEN 900 WHEN 'O' THEN 300 ELSE 30 END AS stop, 's' || o_orderkey AS name, 'ord:' || o_orderkey AS uid FROM orders"""


@query(f"""WITH r AS MATERIALIZED ({_RANGES}) SELECT i.uid, string_agg(o.name, '::' ORDER BY o.start, o.stop DESC, o.uid) AS chain, CAST(count(o.uid) AS INTEGER) AS depth FROM r i
    LEFT JOIN r o ON o.file = i.file AND o.uid <> i.uid AND o.start <= i.start AND o.stop >= i.stop AND (o.start < i.start OR o.stop > i.stop OR o.uid < i.uid) GROUP BY i.uid""")
def scope_chains(t):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    span = F.when(F.col("o_orderstatus") == "F", 900).when(F.col("o_orderstatus") == "O", 300).otherwise(30)
    ranges = t.orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("file"), day.alias("start"), (day + span).alias("stop"), F.concat(F.lit("s"), "o_orderkey").alias("name"), F.concat(F.lit("ord:"), "o_orderkey").alias("uid"))
    return SC.scope_chains(ranges)

"""Lookups, filters, searches, counts and scalar functions."""

from pyspark.sql import functions as F

from graphloom import adapters, model
from graphloom.functions import scalar as S
from graphloom.operators import aggregates as A
from graphloom.operators import reads as R
from graphloom.operators import trigrams as TG
from graphloom.registry import given, query

SYM, NOTE = given("symbols"), given("notes")


@query(SYM + "SELECT uid, name, kind FROM symbols WHERE uid = 'sup:7'")
def lookup_symbol(t):
    return R.lookup(t.symbols, "sup:7").select("uid", "name", "kind")


@query(SYM + "SELECT uid, name FROM symbols WHERE uid IN ('sup:1', 'part:2', 'cust:3', 'none:1')")
def batch_lookup(t):
    return R.batch_lookup(t.symbols, ["sup:1", "part:2", "cust:3", "none:1", "sup:1"]).select("uid", "name")


@query(SYM + "SELECT uid, CAST(pos AS INTEGER) AS pos FROM symbols JOIN (VALUES ('part:9', 0), ('sup:1', 1), ('part:3', 2)) AS k(u, pos) ON uid = u")
def ordered_lookup(t):
    return R.ordered_lookup(t.symbols, ["part:9", "sup:1", "part:3"]).select("uid", "pos")


@query(SYM + "SELECT uid, file_path FROM symbols WHERE name = 'red_widget'")
def symbols_by_name(t):
    return R.by_name(t.symbols, "red_widget").select("uid", "file_path")


@query(SYM + "SELECT uid, name FROM symbols WHERE file_path = 'nation3/supplier.java' AND repo_uid = 'nation:3'")
def symbols_in_file(t):
    return R.in_file(t.symbols, "nation3/supplier.java", "nation:3").select("uid", "name")


@query(given("symbols", "edges") + """SELECT s.uid, n.name AS nation FROM symbols s JOIN edges e ON e.src = s.uid AND e.rel = 'MEMBER_OF' JOIN symbols n ON n.uid = e.dst
    WHERE s.name = 'Supplier#000000005' AND s.file_path LIKE '%/supplier.java'""")
def qualified_spec(t):
    nation = t.symbols.select(F.col("uid").alias("dst"), F.col("name").alias("nation"))
    own = t.edges.where("src = 'sup:5' and rel = 'MEMBER_OF'").join(nation, "dst").select("nation").first()
    return R.by_spec(t.symbols, t.edges, f"supplier.java::{own.nation if own else ''}::Supplier#000000005").select("uid", F.lit(own.nation if own else None).alias("nation"))


@query(given("symbols", "edges") + """SELECT a.src AS uid, CAST(1 AS INTEGER) AS level, a.dst AS container FROM edges a WHERE a.rel = 'MEMBER_OF' AND a.src LIKE 'sup:%'
    UNION ALL SELECT a.src, 2, b.dst FROM edges a JOIN edges b ON b.src = a.dst AND b.rel = 'MEMBER_OF' WHERE a.rel = 'MEMBER_OF' AND a.src LIKE 'sup:%'""")
def container_chains(t):
    return R.container_chains(t.edges, t.symbols.where("kind = 'Class'").select("uid"), 3)


@query(NOTE + "SELECT uid, title FROM notes WHERE uid > 'note:3' AND vault_uid = 'vlt:en' ORDER BY uid LIMIT 25")
def note_keyset_page(t):
    return R.keyset_page(t.notes, "note:3", 25, F.col("vault_uid") == "vlt:en").select("uid", "title")


@query(given("symbols", "edges") + """SELECT s.uid, CAST(coalesce(c.n, 0) AS DOUBLE) AS score FROM symbols s LEFT JOIN (SELECT dst, count(*) AS n FROM edges WHERE rel = 'USES' GROUP BY dst) c ON c.dst = s.uid
    WHERE s.kind = 'Function' ORDER BY score DESC, uid LIMIT 40""")
def workspace_symbol_page(t):
    score = t.edges.where("rel = 'USES'").groupBy(F.col("dst").alias("uid")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    return R.ranked_page(t.symbols, score, 40, F.col("kind") == "Function").select("uid", "score")


@query(SYM + "SELECT count(*) AS rows, CAST(count(*) FILTER (TRY_CAST(split_part(name, '#', 2) AS INTEGER) IS NULL) AS BIGINT) AS skipped FROM symbols")
def scan_with_integrity(t):
    df = t.symbols.select("uid", F.coalesce(F.nullif(F.regexp_extract("name", "#(.*)$", 1), F.lit("")), F.lit("none")).alias("number"))
    return R.with_integrity(df, {"number": "int"})[1]


@query(given("symbols", "edges") + """SELECT count(*) AS edges, CAST(sum(CASE WHEN a.uid IS NULL OR b.uid IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS dangling,
    CAST(count(*) - count(DISTINCT (e.src, e.dst, e.rel)) AS BIGINT) AS repeated, CAST(count(*) FILTER (confidence < 0 OR confidence > 1) AS BIGINT) AS out_of_range
    FROM edges e LEFT JOIN symbols a ON a.uid = e.src LEFT JOIN symbols b ON b.uid = e.dst""")
def edge_integrity(t):
    return R.edge_integrity(t.edges, t.symbols.where(F.lit(True)))


@query(given("symbols", "edges") + """SELECT rel, count(*) AS n FROM (SELECT rel FROM edges UNION ALL SELECT 'DEFINES' FROM symbols) GROUP BY rel""")
def typed_edge_load(t):
    return R.typed_edges(t.edges, t.symbols).groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


@query(given("symbols", "notes", "tags") + "SELECT count(*) AS n FROM (SELECT uid FROM symbols UNION SELECT uid FROM notes UNION SELECT 'tag:' || tag FROM tags)")
def live_uids(t):
    every = t.symbols.select("uid").union(t.notes.select("uid")).union(t.tags.select(F.concat(F.lit("tag:"), "tag")))
    return every.distinct().agg(F.count(F.lit(1)).alias("n"))


_FACTOR = "CASE WHEN '/' || lower(file_path) LIKE '%/tests/%' THEN CAST(3 AS DOUBLE) / 10 ELSE 1.0 END * CASE WHEN '/' || lower(file_path) LIKE '%/test/%' THEN CAST(3 AS DOUBLE) / 10 ELSE 1.0 END"


@query(SYM + f""", m AS (SELECT *, CASE WHEN name = 'red' THEN 3 WHEN lower(name) = 'red' THEN 2 WHEN lower(name) LIKE 'red%' THEN 1 ELSE 0 END AS tier FROM symbols WHERE lower(name) LIKE '%red%')
    SELECT uid, name, CAST(tier AS INTEGER) AS tier, CAST(CASE WHEN tier >= 2 THEN 4 WHEN tier = 1 THEN 2 ELSE 1 END * {_FACTOR} AS DOUBLE) AS score, (SELECT count(*) FROM m) AS total FROM m
    ORDER BY tier DESC, score DESC, CASE kind WHEN 'Class' THEN 0 WHEN 'Interface' THEN 1 WHEN 'Function' THEN 2 WHEN 'Method' THEN 3 ELSE 1073741824 END, file_path, uid LIMIT 30""")
def name_search(t):
    return R.name_search(t.symbols, "red", 30)


@query(SYM + """, s AS (SELECT uid, CASE WHEN lower(name) = 'ring' THEN 1.0 WHEN lower(name) LIKE 'ring%' THEN 0.8 WHEN lower(name) LIKE '%ring%' THEN 0.5 WHEN lower(file_path) LIKE '%ring%' THEN 0.3 END AS base, start_line FROM symbols)
    SELECT uid, round(CAST(base AS DOUBLE) + 0.1 * least(CAST(start_line AS DOUBLE) / 10000, 1.0), 9) AS score FROM s WHERE base IS NOT NULL ORDER BY score DESC, uid LIMIT 20""")
def offline_search(t):
    scores = t.symbols.select("uid", (F.col("start_line").cast("double") / 10000).alias("score"))
    return R.offline_search(t.symbols, scores, "ring", 20).withColumn("score", F.round("score", 9))


@query(SYM + """, c AS (SELECT name, min(CASE WHEN lower(name) LIKE '%red_wiget%' THEN 0 WHEN levenshtein(lower(name), 'red_wiget') <= 2 THEN 1 END) AS stage FROM symbols GROUP BY name)
    SELECT name, CAST(stage AS INTEGER) AS stage, CAST(levenshtein(lower(name), 'red_wiget') AS INTEGER) AS distance FROM c WHERE stage IS NOT NULL ORDER BY stage, distance, name LIMIT 5""")
def did_you_mean(t):
    return R.did_you_mean(t.symbols, "red_wiget")


_LINES = given("notes") + ", l AS (SELECT uid, 'body' AS field, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line, unnest(string_split(text, chr(10))) AS line_text FROM notes)"
_PATTERN = r"\b[Tt]h[a-z]{2,5}tion\b"


@query(_LINES + rf"""SELECT uid, field, line, CAST(length(regexp_extract(line_text, '^(.*?){_PATTERN}', 1)) + 1 AS BIGINT) AS "column", left(regexp_extract(line_text, '{_PATTERN}'), 200) AS matched FROM l WHERE regexp_matches(line_text, '{_PATTERN}')""")
def regex_search(t):
    return R.regex_search(R.lines(t.notes, "uid", "body", "text"), _PATTERN)


@query(_LINES + rf"""SELECT uid, line, left(regexp_extract(line_text, '{_PATTERN}'), 200) AS matched FROM l WHERE regexp_matches(line_text, '{_PATTERN}') AND uid IN (SELECT uid FROM notes WHERE starts_with(file_path, 'src1') AND note_kind IN ('idea', 'log'))""")
def regex_search_scoped(t):
    few = R.scoped(t.notes, "src1", ["idea", "log"], kind="note_kind")
    return R.regex_search(R.lines(few, "uid", "body", "text"), _PATTERN).select("uid", "line", "matched")


@query(_LINES + r""", p AS (SELECT unnest(['the', '[0-9]{3}', 'Licen[sc]e', 'zzzzqq']) AS pattern), c AS (SELECT pattern, uid, CAST(sum(len(regexp_extract_all(line_text, pattern))) AS BIGINT) AS n FROM l, p GROUP BY ALL HAVING n > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, uid) AS k FROM c)
    SELECT pattern, CAST(sum(n) AS BIGINT) AS total_matches, count(*) AS files_matched, string_agg(uid, ',' ORDER BY k) FILTER (k <= 3) AS top_files FROM r GROUP BY pattern""")
def count_patterns(t):
    return R.count_patterns(R.lines(t.notes, "uid", "body", "text"), ["the", "[0-9]{3}", "Licen[sc]e", "zzzzqq"])


def _trigram_index(t):
    """The notes' index, built once for a state of the documents."""
    notes = t.notes.select("uid", "file_path", "note_kind", "text")
    return adapters.built(t.spark, t.sf_dir, "trigrams", ("documents",), lambda path: TG.build(notes, path, order=("file_path", "uid")))


@query(NOTE + "SELECT uid FROM notes WHERE regexp_matches(lower(text), 'apache license|password')")
def trigram_prefiltered_regex(t):
    few = TG.matching(t.spark, _trigram_index(t), "apache license|password")
    return few.where(F.lower("text").rlike("apache license|password")).select("uid")


_RARE = r"Apache License|[a-z]+ghtion\b"


@query(_LINES + rf"""SELECT uid, field, line, CAST(length(regexp_extract(line_text, '^(.*?)({_RARE})', 1)) + 1 AS BIGINT) AS "column", left(regexp_extract(line_text, '{_RARE}'), 200) AS matched FROM l WHERE regexp_matches(line_text, '{_RARE}')""")
def trigram_search(t):
    return TG.search(t.spark, _trigram_index(t), _RARE)


@query(NOTE + """, x AS (SELECT DISTINCT uid, lower(text)[i:i+2] AS trigram FROM notes, unnest(range(1, length(lower(text)) - 1)) AS r(i)) SELECT trigram, count(*) AS documents FROM x GROUP BY trigram""")
def trigram_frequencies(t):
    return TG.frequencies(t.spark, _trigram_index(t))


@query(SYM + "SELECT name, CAST(len(list_distinct([lower(name)[i:i+2] FOR i IN range(1, length(name) - 1)])) AS INTEGER) AS n FROM symbols WHERE kind = 'Function' GROUP BY name")
def trigram_sets(t):
    return t.symbols.where("kind = 'Function'").select("name", F.size(S.trigrams("name")).alias("n")).distinct()


@query(given("notes", "tags") + "SELECT uid FROM notes WHERE uid IN (SELECT note_uid FROM tags WHERE lower(tag) = 'size' OR lower(tag) LIKE 'size/%') AND modified_at >= '2023-06-01T00:00:00Z'")
def notes_by_tag_and_time(t):
    return R.lookup_filters(t.notes, t.tags, "#Size", "2023-06-01T00:00:00Z").select("uid")


@query(given("tags") + "SELECT note_uid, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM tags GROUP BY note_uid")
def note_tag_sets(t):
    return A.tag_sets(t.tags).select("note_uid", F.array_join("tags", ",").alias("tags"))


@query(SYM + """SELECT repo_uid, count(*) AS symbols, CAST(count(*) FILTER (is_entry_point) AS BIGINT) AS entry_points, count(DISTINCT file_path) AS files, CAST(count(*) FILTER (visibility = 'public') AS BIGINT) AS public_symbols FROM symbols GROUP BY repo_uid""")
def service_summaries(t):
    return A.service_summary(t.symbols)


@query(NOTE + "SELECT vault_uid, count(*) AS n FROM notes GROUP BY vault_uid")
def notes_by_vault(t):
    return t.notes.groupBy("vault_uid").agg(F.count(F.lit(1)).alias("n"))


@query(NOTE + "SELECT substr(coalesce(created_at, modified_at), 1, 4) AS year, count(*) AS n FROM notes GROUP BY 1")
def notes_by_year(t):
    return A.notes_by_year(t.notes)


@query(SYM + "SELECT split_part(file_path, '/', 1) AS module, count(*) AS symbols FROM symbols GROUP BY 1")
def module_gaps(t):
    return A.module_gaps(t.symbols, t.edges.where("rel = 'REFERENCES_CODE_NOTE_TO_SYMBOL'"))


# --- scalar functions


@query(SYM + """SELECT uid, substr(sha256(file_path), 1, 12) AS hash, 'sym:' || repo_uid || ':' || substr(sha256(file_path), 1, 12) || ':' || substr(sha256(name), 1, 12) || ':' || start_line AS symbol_uid,
    'note:' || repo_uid || ':' || substr(sha256(file_path), 1, 12) AS note_uid, 'tag:' || repo_uid || ':' || substr(sha256(lower(name)), 1, 12) AS tag_uid FROM symbols""")
def identity_functions(t):
    return t.symbols.select("uid", S.truncated_hash("file_path").alias("hash"), S.symbol_uid("repo_uid", "file_path", "name", "start_line").alias("symbol_uid"), S.note_uid("repo_uid", "file_path").alias("note_uid"), S.tag_uid("repo_uid", "name").alias("tag_uid"))


@query(given("contracts") + "SELECT uid, replace(path, '{}', '{}') AS normal FROM contracts")
def http_paths(t):
    raw = F.concat(F.lit("  /"), F.regexp_replace("path", r"\{\}", ":id"), F.lit("/"))
    return t.contracts.select("uid", S.normalize_http_path(raw).alias("normal"))


@query(NOTE + """SELECT uid, lower(replace(title, ' ', '-')) AS slug, lower(title) AS key, lower(split_part(split_part(file_path, '/', 2), '.', 1)) AS stem FROM notes""")
def text_keys(t):
    return t.notes.select("uid", S.slugify("title").alias("slug"), S.normalize_key(F.concat(F.lit("  "), F.translate("title", " ", "_"))).alias("key"), S.note_stem("file_path").alias("stem"))


@query(SYM + """SELECT uid, regexp_matches(file_path, '(^|/)tests/|_test\\.go$') AS is_test, CASE regexp_extract(file_path, '\\.([a-z]+)$', 1) WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'ts' THEN 'typescript' END AS language,
    'source' AS class FROM symbols""")
def path_classes(t):
    return t.symbols.select("uid", S.is_test_file("file_path").alias("is_test"), S.language("file_path").alias("language"), S.changed_file_class("file_path").alias("class"))


@query(SYM + """SELECT uid, round(CASE WHEN kind = 'Method' THEN 0.95 WHEN kind = 'Class' THEN 0.95 WHEN kind = 'Function' THEN 0.35 ELSE 0.75 END, 6)::DOUBLE AS confidence FROM symbols""")
def match_confidence(t):
    kind = F.when(F.col("kind") == "Method", "SameFileExact").when(F.col("kind") == "Class", "ImportResolved").when(F.col("kind") == "Function", "SamePackageFallback").otherwise("ReExportResolved")
    lang = F.when(F.col("kind").isin("Module", "Package"), "python").otherwise(S.language("file_path"))
    return t.symbols.select("uid", F.round(S.confidence_score(kind, lang), 6).alias("confidence"))


@query(given("edges") + """SELECT rel, CASE WHEN confidence >= 0.5 THEN 'breaking' WHEN confidence >= 0.25 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM edges GROUP BY ALL""")
def severities(t):
    return t.edges.groupBy("rel", S.org_severity("confidence").alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(given("symbols", "edges") + """, c AS (SELECT repo_uid, count(*) AS n, count(DISTINCT file_path) AS k, bool_or(is_entry_point) AS e FROM symbols GROUP BY 1)
    SELECT repo_uid, CASE WHEN s = 0 THEN 'low' WHEN s = 1 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT repo_uid, CASE WHEN n < 10 THEN 0 WHEN n < 50 THEN 1 WHEN n < 200 THEN 2 ELSE 3 END + CASE WHEN e THEN 1 ELSE 0 END + CASE WHEN k > 3 THEN 1 ELSE 0 END AS s FROM c)""")
def risk_levels(t):
    c = t.symbols.groupBy("repo_uid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path").alias("k"), F.max("is_entry_point").alias("e"))
    return c.select("repo_uid", S.risk_level("n", "k", "e").alias("risk"))


@query(SYM + """SELECT DISTINCT name, lower(replace(replace(name, '_', ' '), '#', '#')) AS words, name LIKE '%\\_%' ESCAPE '\\' AS distinctive FROM symbols WHERE kind = 'Function'""")
def identifier_words(t):
    return t.symbols.where("kind = 'Function'").select("name", S.split_identifier("name").alias("words"), S.is_distinctive("name").alias("distinctive")).distinct()


@query(NOTE + "SELECT uid, CAST(epoch(CAST(replace(replace(modified_at, 'T', ' '), 'Z', '') AS TIMESTAMP)) AS DOUBLE) AS epoch FROM notes")
def iso_times(t):
    return t.notes.select("uid", S.iso_epoch("modified_at").alias("epoch"))


@query(SYM + """SELECT uid, CASE WHEN is_entry_point THEN 'http:' || split_part(file_path, '/', 2) || '::' || name ELSE 'process::' || name END AS process, CASE split_part(uid, ':', 1) WHEN 'sup' THEN 'sym' ELSE split_part(uid, ':', 1) END AS prefix FROM symbols WHERE kind IN ('Method', 'Class')""")
def process_names(t):
    s = t.symbols.where("kind in ('Method', 'Class')")
    return s.select("uid", S.process_name(F.when(F.col("is_entry_point"), "HttpHandler"), "name", "file_path").alias("process"), F.when(F.col("uid").startswith("sup:"), "sym").otherwise(F.substring_index("uid", ":", 1)).alias("prefix"))


@query(given("symbols") + """SELECT uid, round(greatest(CAST(4 AS DOUBLE) / 10, least(CAST(16 AS DOUBLE) / 10, 1 + 1.2 * (CAST(start_line % 100 AS DOUBLE) / 100 - 0.5))), 9) AS multiplier FROM symbols WHERE kind = 'Function'""")
def activity_multipliers(t):
    return t.symbols.where("kind = 'Function'").select("uid", F.round(S.activity_multiplier(F.col("start_line") % 100 / F.lit(100.0)), 9).alias("multiplier"))


@query(SYM + """SELECT uid, CASE WHEN file_path LIKE 'tests/%' THEN 0.5 WHEN file_path LIKE 'nation1%/%.go' THEN 2.0 WHEN file_path LIKE '%.go' THEN 1.5 END::DOUBLE AS multiplier FROM symbols""")
def ranking_priors(t):
    return t.symbols.select("uid", S.ranking_prior(F.concat("file_path", F.lit(":12")), [("**/*.go", 1.5), ("nation1*/*.go", 2.0), ("tests/**", 0.5)]).alias("multiplier"))

"""Composed answers: ranked context, blast radius, affected tests, change impact."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scalar as S
from graphloom.operators import aggregates, graph, reads, retrieval


def seeds(symbols: DataFrame, edges: DataFrame, inputs: Iterable[str], most: int = 5) -> list[str]:
    """uids for inputs that are uids, files, specs or names, in order and once each."""
    out: list[str] = []
    for x in inputs:
        hit = reads.lookup(symbols, x) if ":" in x and "::" not in x else reads.by_spec(symbols, edges, x) if "::" in x else reads.in_file(symbols, x) if "/" in x else None
        rows = hit.select("uid").orderBy("uid").limit(most).collect() if hit is not None else []
        if not rows and "::" not in x:
            rows = reads.name_search(symbols, x, most).collect()
        out += [r.uid for r in rows if r.uid not in out]
    return out


def code_context(symbols: DataFrame, edges: DataFrame, inputs: Iterable[str], limit: int, intent: str | None = None, iterations: int = 20) -> DataFrame:
    """uid, name, file_path, score: personalised rank around the inputs; module owners last."""
    start = seeds(symbols, edges, inputs)
    intent = intent or graph.detect_intent(symbols, start)
    ranked = graph.personalized_pagerank(symbols, graph.scope_edges(edges, "code", intent), start, model.DAMPING[intent], iterations, back=model.REVERSE_WEIGHT)
    owner = F.col("name") == "<module>"
    return symbols.join(ranked, "uid").orderBy(owner, F.desc("score"), "uid").limit(limit).select("uid", "name", "file_path", "score")


def brain_context(notes: DataFrame, index: DataFrame, lengths: DataFrame, ppr: DataFrame, semantic: DataFrame, query: str, limit: int, rules: Iterable[tuple[str, float]] = (), aliases: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """uid, score, position: rank, text (with feedback) and vectors fused, priors applied, the head scored again."""
    text = retrieval.prf_search(index, lengths, retrieval.expand_query(query, aliases or {}), 200)
    fused = retrieval.weighted_fuse(ppr, text, semantic).join(notes.select("uid", "file_path", "modified_at"), "uid")
    ready = retrieval.apply_priors(fused, "file_path", rules).withColumns({"age_days": F.lit(None).cast("double"), "is_doc": F.lit(True), "has_body": F.lit(False), "aliases": F.lit(0)})
    return retrieval.rerank(ready).where(F.col("position") <= limit).select("uid", "score", "position")


def blast_radius(symbols: DataFrame, edges: DataFrame, changed_files: Iterable[str], assignment: DataFrame | None = None, max_depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """(affected: uid, impact_score, depth, severity; summary: one row with counts, clusters and the risk)."""
    changed = symbols.where(F.col("file_path").isin(*changed_files)).select("uid")
    hit = graph.impact_many(edges, changed, max_depth, 0.0)
    affected = symbols.join(hit, "uid").withColumn("severity", S.org_severity("impact_score"))
    n = affected.agg(F.count(F.lit(1)).alias("affected"), F.max("is_entry_point").alias("central"))
    if assignment is not None:
        clusters = aggregates.affected_clusters(assignment, affected.select("uid").unionByName(changed)).agg(F.count(F.lit(1)).alias("clusters"))
    else:
        clusters = n.select(F.lit(0).alias("clusters"))
    out = n.join(F.broadcast(clusters), how="inner").withColumn("risk", S.risk_level("affected", "clusters", F.coalesce("central", F.lit(False))))
    return affected, out


def affected_tests(symbols: DataFrame, edges: DataFrame, changed_files: Iterable[str], repo: str | None = None) -> DataFrame:
    """file_path, tier, score: test files that depend on the changed files, by fewest hops, then the best score."""
    changed = symbols.where(F.col("file_path").isin(*changed_files))
    if repo is not None:
        changed = changed.where(F.col("repo_uid") == repo)
    hit = graph.impact_many(edges, changed.select("uid"), 3, 0.3, 0.1)
    tests = symbols.where(S.is_test_file("file_path")).join(hit, "uid")
    return tests.groupBy("file_path").agg(F.min("depth").alias("tier"), F.max("impact_score").alias("score"), F.count(F.lit(1)).alias("symbols"))


def change_impact(symbols: DataFrame, edges: DataFrame, changed_files: Iterable[str], max_depth: int = 4) -> DataFrame:
    """entry, name, depth: processes (from entry points) that reach a changed symbol.

    The walk goes backwards from the changed symbols, so it costs what it finds, not the number of processes.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "confidence")
    reach = graph.bfs(back, symbols.where(F.col("file_path").isin(*changed_files)).select("uid"), max_depth, model.PROCESS_RELATIONS)
    return entry_points(symbols, edges).join(reach, "uid").select(F.col("uid").alias("entry"), "name", "depth")


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that start a process: flagged, named like one, or called by none; module owners only if they call."""
    calls = edges.where("rel = 'CALLS'")
    called = calls.select(F.col("dst").alias("uid"), F.lit(True).alias("called")).distinct()
    calling = calls.select(F.col("src").alias("uid"), F.lit(True).alias("calling")).distinct()
    j = symbols.join(called, "uid", "left").join(calling, "uid", "left")
    owner = F.col("name") == "<module>"
    return j.where(F.when(owner, F.coalesce("calling", F.lit(False))).otherwise(F.col("is_entry_point") | S.is_entry_name("name") | F.col("called").isNull())).select(*symbols.columns)


def processes(symbols: DataFrame, edges: DataFrame, max_depth: int, starts: DataFrame | None = None) -> DataFrame:
    """entry, members, depth: what each entry point reaches."""
    start = (entry_points(symbols, edges) if starts is None else starts).select(F.col("uid").alias("entry"), "uid")
    got = graph.bfs(edges, start, max_depth, model.PROCESS_RELATIONS, group="entry")
    return got.groupBy("entry").agg(F.count(F.lit(1)).alias("members"), F.max("depth").alias("depth"))


def repo_map(symbols: DataFrame, scores: DataFrame, budget: int) -> DataFrame:
    """repo_uid, file_path, best, tokens: files by their best callable's score while their names fit into the budget."""
    s = symbols.join(scores.select("uid", "score"), "uid", "left").withColumn("_s", F.when(F.col("kind").isin(*model.CALLABLE_KINDS), F.coalesce("score", F.lit(0.0))))
    files = s.groupBy("repo_uid", "file_path").agg(F.max("_s").alias("best"), F.sum(F.length("name")).alias("tokens"))
    return aggregates.within_budget(files, "tokens", budget, F.col("best").isNull(), F.desc("best"), F.col("repo_uid"), F.col("file_path"), per="repo_uid")


def investigate(entries: DataFrame, query: str) -> DataFrame:
    """Hits (uid, name, label, score) grouped into domains, exact names first."""
    from graphloom.operators.derive import domains

    return domains(entries.withColumn("exact", F.lower("name") == query.lower()))


def symbol_bodies(symbols: DataFrame, files: DataFrame, budget: int) -> DataFrame:
    """uid, body: source lines of symbols (file_path, start_line, end_line) from files (file_path, text), within a budget of words."""
    j = symbols.join(files, "file_path").withColumn("body", F.array_join(F.slice(F.split("text", "\n"), F.greatest(F.col("start_line").cast("int"), F.lit(1)), F.greatest((F.col("end_line") - F.col("start_line") + 1).cast("int"), F.lit(0))), "\n"))
    j = j.withColumn("words", F.size(F.split(F.trim("body"), r"\s+")))
    return aggregates.within_budget(j, "words", budget, F.col("uid")).select("uid", "body", "words")


def summaries(symbols: DataFrame, degrees: DataFrame) -> DataFrame:
    """uid, summary: one sentence for each symbol with a degree."""
    return symbols.join(degrees, "uid").select("uid", F.format_string("%s %s in %s: %d in, %d out, %s", F.lower("kind"), "name", "file_path", "in_degree", "out_degree", S.hub_role("in_degree", "out_degree")).alias("summary"))

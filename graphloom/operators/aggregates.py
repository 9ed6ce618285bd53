"""Counts, market-basket, recency, tags, statistics of documents, ranking metrics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalar as S


def hubs(edges: DataFrame, symbols: DataFrame, kinds: Iterable[str], top: int, scores: DataFrame | None = None, repos: Iterable[str] | None = None) -> DataFrame:
    """uid, in_degree, out_degree, total_degree, candidate_total: edges between symbols of the given kinds.

    Ordered by total degree, score, uid; the repository filter comes before the cut.
    """
    own = symbols.where(F.col("kind").isin(*kinds)).select("uid", "repo_uid")
    both = edges.join(own.select(F.col("uid").alias("src")), "src", "left_semi").join(own.select(F.col("uid").alias("dst")), "dst", "left_semi")
    ends = both.select(F.explode(F.array(F.struct(F.col("src").alias("uid"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("uid"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    degree = ends.groupBy(F.col("x.uid").alias("uid")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    degree = degree.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))
    if repos is not None:
        degree = degree.join(own.where(F.col("repo_uid").isin(*repos)).select("uid"), "uid", "left_semi")
    if scores is not None:
        degree = degree.join(scores.select("uid", "score"), "uid", "left")
    else:
        degree = degree.withColumn("score", F.lit(0.0))
    total = degree.agg(F.count(F.lit(1)).alias("candidate_total"))
    best = degree.orderBy(F.desc("total_degree"), F.desc(F.coalesce("score", F.lit(0.0))), "uid").limit(top).drop("score")
    return best.join(F.broadcast(total), how="inner")


def bulk_cutoff(commits: DataFrame) -> DataFrame:
    """One row: the nearest-rank 90th percentile of files per commit; null (no cut) for fewer than ten commits."""
    n = commits.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.when(F.count(F.lit(1)) >= 10, F.expr("percentile_disc(0.9) within group (order by n)")).cast("long").alias("cutoff"))


def cochange(commits: DataFrame, least: int, confidence: float, most_files: int | None = None) -> DataFrame:
    """file_a < file_b, n, total_a, total_b, confidence (Jaccard): pairs of files that change together.

    Pairs come from a self-join within a commit. most_files, where given, leaves out commits of more files (bulk
    changes), which bounds the pairs of a commit; totals still count every commit.
    """
    c = commits.select("commit_id", "file").distinct()
    totals = c.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    kept = c
    if most_files is not None:
        kept = c.join(c.groupBy("commit_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most_files), "commit_id", "left_semi")
    # a file that changed fewer times than `least` is in no pair that counts
    often = kept.join(totals.where(F.col("total") >= least).select("file"), "file", "left_semi")
    pairs = often.select("commit_id", F.col("file").alias("file_a")).join(often.select("commit_id", F.col("file").alias("file_b")), "commit_id").where("file_a < file_b")
    n = pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    out = n.join(totals.select(F.col("file").alias("file_a"), F.col("total").alias("total_a")), "file_a").join(totals.select(F.col("file").alias("file_b"), F.col("total").alias("total_b")), "file_b")
    return out.withColumn("confidence", F.col("n") / (F.col("total_a") + F.col("total_b") - F.col("n"))).where(F.col("confidence") >= confidence)


def recency(commits: DataFrame, now_epoch: float, window: int = 20, tau_days: float = 180.0) -> DataFrame:
    """file, score: mean of exp(-days / tau) over the newest commits that are not bulk."""
    n = commits.groupBy("commit_id").agg(F.count(F.lit(1)).alias("n"))
    small = n.join(F.broadcast(bulk_cutoff(commits)), how="inner").where("cutoff is null or n <= cutoff").select("commit_id")
    touch = commits.where("authored is not null").join(small, "commit_id", "left_semi").withColumn("epoch", S.micros("authored") / 1e6)
    newest = touch.withColumn("r", F.row_number().over(W.partitionBy("file").orderBy(F.desc("epoch"), F.desc("commit_id")))).where(F.col("r") <= window)
    days = F.greatest(F.lit(0.0), (F.lit(now_epoch) - F.col("epoch")) / 86400.0)
    return newest.groupBy("file").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(F.exp(-days / tau_days)))).alias("score"))


def tag_sets(tags: DataFrame) -> DataFrame:
    return tags.groupBy("note_uid").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def tag_graph(tags: DataFrame, focus: str) -> DataFrame:
    """tag, role (focus, exact, descendant, co_occurring), n: for one tag and those below it."""
    t = tags.distinct().withColumn("hit", S.tag_matches("tag", focus))
    inside = t.where("hit").select("note_uid").distinct()
    about = t.join(inside, "note_uid", "left_semi")
    low = focus.lstrip("#").lower()
    counts = inside.agg(F.count(F.lit(1)).alias("n")).select(F.lit(low).alias("tag"), F.lit("focus").alias("role"), "n")
    exact = about.where(F.lower("tag") == low).agg(F.count_distinct("note_uid").alias("n")).select(F.lit(low).alias("tag"), F.lit("exact").alias("role"), "n")
    below = about.where(F.col("hit") & (F.lower("tag") != low)).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select("tag", F.lit("descendant").alias("role"), "n")
    co = about.where("not hit").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).select("tag", F.lit("co_occurring").alias("role"), "n")
    return counts.unionByName(exact).unionByName(below).unionByName(co)


def tag_pairs(tags: DataFrame) -> DataFrame:
    """tag, other, n: notes that hold both, for all pairs of tags where neither is below the other."""
    t = tags.distinct()
    pairs = t.alias("a").join(t.alias("b"), "note_uid").where("a.tag <> b.tag")
    free = pairs.where(~F.expr("startswith(b.tag, concat(a.tag, '/'))"))
    return free.groupBy(F.col("a.tag").alias("tag"), F.col("b.tag").alias("other")).agg(F.count(F.lit(1)).alias("n"))


def document_statistics(notes: DataFrame, resolved: DataFrame, unresolved: DataFrame, orphans: DataFrame) -> DataFrame:
    """One row of totals."""
    weak = resolved.where("confidence < 1").groupBy("src", "target").agg(F.count_distinct("dst").alias("c"))
    parts = [
        notes.agg(F.count(F.lit(1)).alias("total_notes")),
        resolved.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("note_edges")),
        unresolved.agg(F.count(F.lit(1)).alias("unresolved")),
        weak.agg(F.count_if(F.col("c") > 1).alias("ambiguous"), F.count_if(F.col("c") <= 1).alias("low_confidence")),
        orphans.agg(F.count(F.lit(1)).alias("orphans")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="inner")
    return out.withColumn("avg_outdegree", F.when(F.col("total_notes") == 0, 0.0).otherwise(F.col("note_edges") / F.col("total_notes")))


def notes_by_year(notes: DataFrame) -> DataFrame:
    year = F.substring(F.coalesce("created_at", "modified_at"), 1, 4)
    return notes.select(year.alias("year")).where(F.length("year") == 4).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def interaction_counts(events: DataFrame) -> DataFrame:
    """Per uid: how often it was accessed, a seed, used, shown, terminal; sessions; the last time."""
    kinds = {"access": "access", "seed": "seeds", "used": "used", "shown": "shown", "terminal": "terminal"}
    return events.groupBy("uid").agg(*[F.count_if(F.col("kind") == k).alias(v) for k, v in kinds.items()], F.count_distinct("session").alias("sessions"), F.max("ts").alias("last_ts"))


def decay_scores(events: DataFrame, now: Column) -> DataFrame:
    days = (S.micros(now) - S.micros("last_ts")) / 86400e6
    return interaction_counts(events).withColumn("score", S.decayed_score("access", "seeds", "used", "shown", "terminal", "sessions", days))


def follow_ups(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Accesses within some seconds of the session's last event that showed or queried the same uid: event_id, uid, gap."""
    w = W.partitionBy("session", "uid").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    shown = F.max(F.when(F.col("kind") != "access", S.micros("ts"))).over(w)
    return events.withColumn("gap", (S.micros("ts") - shown) / 1e6).where((F.col("kind") == "access") & (F.col("gap") <= seconds)).select("event_id", "uid", "gap")


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """query, ndcg, mrr, precision: ranked (query, uid, rank from 1), judged (query, uid, grade)."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    j = ranked.join(judged, ["query", "uid"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    got = j.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"),
        F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
        F.count_if((F.col("rank") <= k) & (F.col("grade") >= 1)).alias("hits"),
        F.count(F.lit(1)).alias("n"),
    )
    ideal = judged.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "uid"))).where(F.col("r") <= k).groupBy("query").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("idcg"))
    return got.join(ideal, "query", "left").select(
        "query", F.when(F.coalesce("idcg", F.lit(0.0)) > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("hits") / F.least(F.lit(k), F.col("n"))).alias("precision"),
    )


def compare_reports(base: DataFrame, other: DataFrame) -> DataFrame:
    names = ["ndcg", "mrr", "precision"]
    j = base.join(other.select("query", *[F.col(c).alias(f"_{c}") for c in names]), "query")
    return j.select("query", *[(F.col(f"_{c}") - F.col(c)).alias(f"delta_{c}") for c in names])


def selection_report(joined: DataFrame, least: int = 10) -> DataFrame:
    """joined (truth_id, failed, selected: arrays; total): file_recall, change_recall, breadth; null for too few pairs."""
    caught = F.size(F.array_intersect("failed", "selected"))
    enough = F.count(F.lit(1)) >= least
    per = joined.withColumn("nf", F.size("failed")).withColumn("nc", caught)
    return per.agg(
        F.count(F.lit(1)).alias("n_joined"),
        F.when(enough & (F.sum("nf") > 0), F.sum("nc") / F.sum("nf")).alias("file_recall"),
        F.when(enough & (F.count_if(F.col("nf") > 0) > 0), F.count_if(F.col("nc") > 0) / F.count_if(F.col("nf") > 0)).alias("change_recall"),
        F.when(enough, F.avg(F.when(F.col("total") > 0, F.size("selected") / F.col("total")))).alias("breadth"),
    )


def modularity(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """One row: q of undirected weighted edges (a, b, weight), each once, under assignment (uid, community)."""
    m = edges.agg(F.sum("weight").alias("m"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("uid"), "weight").join(assignment, "uid").groupBy("community").agg(F.sum("weight").alias("d"))
    a, b = assignment.select(F.col("uid").alias("a"), F.col("community").alias("ca")), assignment.select(F.col("uid").alias("b"), F.col("community").alias("cb"))
    inner = edges.join(a, "a").join(b, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("l"))
    per = ends.join(inner, "community", "left").join(F.broadcast(m), how="inner")
    q = F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))
    return per.agg(F.coalesce(F.sum(q), F.lit(0.0)).alias("modularity"))


def cohesion(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """community, cohesion: inner weight over all weight at its members."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    a, b = assignment.select(F.col("uid").alias("a"), F.col("community").alias("community")), assignment.select(F.col("uid").alias("b"), F.col("community").alias("cb"))
    j = both.join(a, "a").join(b, "b", "left")
    return j.groupBy("community").agg((F.coalesce(F.sum(F.when(F.col("cb") == F.col("community"), F.col("weight"))), F.lit(0.0)) / F.sum("weight")).alias("cohesion"))


def affected_clusters(assignment: DataFrame, affected: DataFrame) -> DataFrame:
    j = assignment.join(affected.select("uid", F.lit(1).alias("_a")).distinct(), "uid", "left")
    return j.groupBy("community").agg(F.count("_a").alias("affected"), F.count(F.lit(1)).alias("total")).where("affected > 0")


def within_budget(df: DataFrame, size: str, budget: int, *order: Column, per: str | None = None) -> DataFrame:
    """Rows in order while the running sum of their size stays within the budget."""
    w = (W.partitionBy(per) if per else W.partitionBy()).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)


def best_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def service_summary(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("repo_uid").agg(F.count(F.lit(1)).alias("symbols"), F.count_if("is_entry_point").alias("entry_points"), F.count_distinct("file_path").alias("files"), F.count_if(F.col("visibility") == "public").alias("public_symbols"))


def module_gaps(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """First path segments with their symbols, when no note refers to code at all; else none."""
    n = references.agg(F.count(F.lit(1)).alias("_n"))
    return symbols.groupBy(F.substring_index("file_path", "/", 1).alias("module")).agg(F.count(F.lit(1)).alias("symbols")).join(F.broadcast(n), how="inner").where("_n = 0").drop("_n")

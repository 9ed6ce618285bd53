"""Joins along edges, anti-joins, interval and as-of matches, diffs and set operations."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions import scalar as S


def neighbours(edges: DataFrame, nodes: DataFrame, uid: str, direction: str, relations: Iterable[str]) -> DataFrame:
    """Nodes one edge away: `in` lists sources, `out` targets; with relation and confidence."""
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    hop = edges.where((F.col(near) == uid) & F.col("rel").isin(*relations)).select(F.col(far).alias("uid"), "rel", "confidence")
    return hop.join(nodes, "uid")


def strongest(hops: DataFrame) -> DataFrame:
    """One row per node: its strongest edge (ties: the first relation by name)."""
    return hops.groupBy("uid").agg(F.max("confidence").alias("confidence"), F.min_by("rel", F.struct(-F.col("confidence"), "rel")).alias("rel"))


def bounded_flow(edges: DataFrame, nodes: DataFrame, uid: str, limit: int, relations: Iterable[str], seen: Iterable[str] = (), visible: Column | None = None) -> DataFrame:
    """Distinct callees by uid, without those seen; `hidden` counts the distinct ones a reader may not see."""
    hop = neighbours(edges, nodes, uid, "out", relations).where(~F.col("uid").isin(*seen) if list(seen) else F.lit(True))
    one = strongest(hop).join(nodes, "uid")
    shown = one if visible is None else one.where(visible)
    hidden = one.where(~visible if visible is not None else F.lit(False)).agg(F.count_distinct("uid").alias("hidden"))
    return shown.orderBy("uid").limit(limit).select("uid", "name", "rel").join(F.broadcast(hidden), how="inner")


def files_referencing(edges: DataFrame, symbols: DataFrame, repo: str, path: str, relations: Iterable[str]) -> DataFrame:
    """Distinct other files with a symbol that refers to a symbol of the file."""
    inside = symbols.where((F.col("repo_uid") == repo) & (F.col("file_path") == path)).select(F.col("uid").alias("dst"))
    hop = edges.where(F.col("rel").isin(*relations)).join(inside, "dst", "left_semi").select(F.col("src").alias("uid")).distinct()
    return symbols.join(hop, "uid", "left_semi").where(F.col("file_path") != path).select("file_path").distinct()


def resolved_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """src, target, dst, confidence, candidates: the ladder of link targets, the first tier that answers wins.

    Tiers: whole path; unique stem; same folder's stem; unique title. Confidence is the tier's over the candidates.
    """
    n = notes.select(F.col("uid").alias("dst"), F.lower(F.regexp_replace("file_path", r"\.md$", "")).alias("path"), S.note_stem("file_path").alias("stem"), F.lower("title").alias("title"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("folder"))
    src = notes.select(F.col("uid").alias("src"), F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1).alias("src_folder"))
    raw = links.distinct().join(src, "src").withColumn("key", F.lower(F.regexp_replace(F.trim("target"), r"\.md$", "")))
    stems = n.withColumn("same", F.count(F.lit(1)).over(W.partitionBy("stem")))
    titles = n.withColumn("same", F.count(F.lit(1)).over(W.partitionBy("title")))
    tiers = [
        (raw.join(n, F.col("key") == F.col("path")), 1.0),
        (raw.join(stems.where("same = 1"), F.col("key") == F.col("stem")), 1.0),
        (raw.join(stems.where("same > 1"), (F.col("key") == F.col("stem")) & (F.col("src_folder") == F.col("folder"))), 0.95),
        (raw.join(titles.where("same = 1"), F.col("key") == F.col("title")), 1.0),
        (raw.join(titles.where("same > 1"), F.col("key") == F.col("title")), 1.0),
    ]
    found = None
    for k, (df, confidence) in enumerate(tiers):
        step = df.select("src", "target", "dst", F.lit(k).alias("tier"), F.lit(confidence).alias("base"))
        found = step if found is None else found.unionByName(step)
    first = found.withColumn("best", F.min("tier").over(W.partitionBy("src", "target"))).where("tier = best").drop("best").distinct()
    first = first.withColumn("candidates", F.count(F.lit(1)).over(W.partitionBy("src", "target")))
    return first.select("src", "target", "dst", (F.col("base") / F.col("candidates")).alias("confidence"), F.col("candidates").cast("long").alias("candidates"))


def unresolved_links(links: DataFrame, resolved: DataFrame) -> DataFrame:
    return links.distinct().join(resolved.select("src", "target").distinct(), ["src", "target"], "left_anti")


def backlinks(resolved: DataFrame, uid: str) -> DataFrame:
    return resolved.where((F.col("dst") == uid) & (F.col("src") != uid)).select("src", "target", "confidence").distinct()


def broken_links(resolved: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One row per source and target that is unresolved or less than sure, the worst first by `severity`."""
    weak = resolved.where("confidence < 1").groupBy("src", "target").agg(F.min("confidence").alias("confidence"), F.count_distinct("dst").alias("candidates"))
    lost = unresolved.select("src", "target", F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("candidates"))
    return weak.unionByName(lost).withColumn("severity", F.when(F.col("candidates") == 0, "unresolved").when(F.col("candidates") > 1, "ambiguous").otherwise("low_confidence"))


def orphans(notes: DataFrame, resolved: DataFrame, allowlist: Iterable[str] = (), prefix: str | None = None) -> DataFrame:
    """Notes with no link in or out, but for those on the allowlist."""
    linked = resolved.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("uid")).distinct()
    out = notes.join(linked, "uid", "left_anti").where(~S.is_allowlisted("file_path", "title", allowlist))
    return (out if prefix is None else out.where(F.col("file_path").startswith(prefix))).select("uid", "title", "file_path")


def induced(edges: DataFrame, picked: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges with both ends among the picked uids."""
    a, b = picked.select(F.col("uid").alias("src")), picked.select(F.col("uid").alias("dst"))
    out = edges.join(a, "src", "left_semi").join(b, "dst", "left_semi")
    return out if limit is None else out.orderBy("src", "dst", "rel").limit(limit)


def repos_sharing_edges(edges: DataFrame, symbols: DataFrame, repo: str) -> DataFrame:
    """Other repositories with an edge to or from this one."""
    own = symbols.select("uid", "repo_uid")
    pairs = edges.join(own.select(F.col("uid").alias("src"), F.col("repo_uid").alias("a")), "src").join(own.select(F.col("uid").alias("dst"), F.col("repo_uid").alias("b")), "dst").where("a <> b").select("a", "b").distinct()
    return pairs.where(F.col("a") == repo).select(F.col("b").alias("repo_uid")).unionByName(pairs.where(F.col("b") == repo).select(F.col("a").alias("repo_uid"))).distinct()


def shared_names(symbols: DataFrame, least_length: int = 6) -> DataFrame:
    """Names in two or more repositories, as pairs of repositories: one symbol (the smallest uid) per repository."""
    one = symbols.where((F.length("name") >= least_length) & F.col("name").rlike("^[A-Za-z0-9_]+$")).groupBy("name", "repo_uid").agg(F.min(F.struct("uid", "kind")).alias("s"))
    a = one.select("name", F.col("repo_uid").alias("repo_a"), F.col("s.uid").alias("uid_a"), F.col("s.kind").alias("kind_a"))
    b = one.select(F.col("name").alias("_n"), F.col("repo_uid").alias("repo_b"), F.col("s.uid").alias("uid_b"), F.col("s.kind").alias("kind_b"))
    return a.join(b, (F.col("name") == F.col("_n")) & (F.col("repo_a") < F.col("repo_b"))).select("name", "repo_a", "repo_b", "uid_a", "uid_b", F.when(F.col("kind_a") == F.col("kind_b"), "high").otherwise("medium").alias("confidence"))


def repo_links(symbols: DataFrame) -> DataFrame:
    """Pairs of repositories that share two names or more, at least one of them specific (in few repositories)."""
    repos = symbols.agg(F.count_distinct("repo_uid").alias("repos"))
    names = symbols.where(~S.is_noise("name")).select("name", "repo_uid").distinct()
    few = names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(repos), how="inner").select("name", (F.col("n") <= F.greatest(F.lit(3), F.ceil(F.col("repos") * 0.3))).alias("specific"))
    a = names.join(few.where("specific"), "name")
    pairs = a.select("name", F.col("repo_uid").alias("repo_a")).join(a.select("name", F.col("repo_uid").alias("repo_b")), "name").where("repo_a < repo_b")
    return pairs.groupBy("repo_a", "repo_b").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2").withColumn("confidence", F.when(F.col("shared") >= 5, "high").when(F.col("shared") >= 3, "medium").otherwise("low"))


def dependency_links(dependencies: DataFrame, packages: DataFrame) -> DataFrame:
    """A dependency is a package when it has its name or ends in /name: equal on the part after the last slash, then checked."""
    d = dependencies.withColumn("_k", F.substring_index("dependency", "/", -1))
    p = packages.withColumn("_k", F.substring_index("package", "/", -1))
    hit = d.join(p, "_k").where((F.col("dependency") == F.col("package")) | F.col("dependency").endswith(F.concat(F.lit("/"), F.col("package"))))
    return hit.where("repo_uid <> package_repo").select("repo_uid", "package_repo", "dependency", "package")


def contract_drift(declared: DataFrame, derived: DataFrame, implemented: DataFrame) -> DataFrame:
    """Declared contracts that nothing implements, and implemented shapes that nothing declares, by repository."""
    a = declared.join(implemented.select("uid", "repo_uid"), ["uid", "repo_uid"], "left_anti").select("uid", "repo_uid", F.lit("declared_not_implemented").alias("drift"))
    b = derived.join(declared.select("uid", "repo_uid"), ["uid", "repo_uid"], "left_anti").select("uid", "repo_uid", F.lit("implemented_not_declared").alias("drift"))
    return a.unionByName(b)


def contained_bindings(symbols: DataFrame, inner: Iterable[str], outer: Iterable[str]) -> DataFrame:
    """Symbols of the inner kinds whose span lies in an outer symbol of the same file, after its first line.

    Spans are put on a grid of lines, so the range condition meets only spans nearby.
    """
    grid = 256
    o = symbols.where(F.col("kind").isin(*outer)).select("repo_uid", "file_path", F.col("start_line").alias("_a"), F.col("end_line").alias("_z"))
    o = o.withColumn("_g", F.explode(F.sequence(F.floor(F.col("_a") / grid), F.floor(F.col("_z") / grid))))
    i = symbols.where(F.col("kind").isin(*inner)).withColumn("_g", F.floor(F.col("start_line") / grid))
    same = (F.col("i.repo_uid") == F.col("o.repo_uid")) & (F.col("i.file_path") == F.col("o.file_path")) & (F.col("i._g") == F.col("o._g"))
    return i.alias("i").join(o.alias("o"), same & (F.col("i.start_line") > F.col("o._a")) & (F.col("i.end_line") <= F.col("o._z")), "left_semi").drop("_g")


def point_in_span(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Points (key, line) with the spans (key, start_line, end_line) that hold them."""
    return points.join(spans, key).where(F.col("line").between(F.col("start_line"), F.col("end_line")))


def as_of(truths: DataFrame, selections: DataFrame, key: str) -> DataFrame:
    """truth_id, selection_id: the latest selection of the same key no later than the truth; each serves once, earlier truths first.

    Within a key both sides are numbered as one line of time; a truth takes the latest selection still free.
    That is the rule of matching brackets: with depth = selections - truths so far, a truth pairs with the
    last selection before it that opened its depth, and a truth that meets no free selection resets the depth.
    """
    events = truths.select(F.col(key).alias("k"), "ts", F.lit(1).alias("side"), F.col("truth_id").alias("id")).unionByName(selections.select(F.col(key).alias("k"), "ts", F.lit(0).alias("side"), F.col("selection_id").alias("id")))
    w = W.partitionBy("k").orderBy("ts", "side", "id").rowsBetween(W.unboundedPreceding, 0)
    walk = events.withColumn("d", F.sum(F.when(F.col("side") == 0, 1).otherwise(-1)).over(w))
    walk = walk.withColumn("low", F.least(F.lit(0), F.min("d").over(w)))
    before = F.least(F.lit(0), F.coalesce(F.min("d").over(W.partitionBy("k").orderBy("ts", "side", "id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    walk = walk.withColumn("before", before).withColumn("level", F.when(F.col("side") == 0, F.col("d")).otherwise(F.col("d") + 1))
    walk = walk.withColumn("matched", (F.col("side") == 1) & (F.col("d") >= F.col("before")))
    last = F.last(F.when(F.col("side") == 0, F.col("id")), ignorenulls=True).over(W.partitionBy("k", "level").orderBy("ts", "side", "id").rowsBetween(W.unboundedPreceding, 0))
    return walk.withColumn("selection_id", last).where("matched and selection_id is not null").select(F.col("id").alias("truth_id"), "selection_id")


def api_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes of public symbols by key: removed, renamed (same file and signature, new name), signature or visibility changed."""
    b = before.where("visibility = 'public'").select("key", F.col("name").alias("b_name"), F.col("file_path").alias("b_file"), F.col("signature").alias("b_sig"), F.col("visibility").alias("b_vis"))
    a = after.select(F.col("key").alias("a_key"), F.col("name").alias("a_name"), F.col("file_path").alias("a_file"), F.col("signature").alias("a_sig"), F.col("visibility").alias("a_vis"))
    both = b.join(a, F.col("key") == F.col("a_key"))
    changed = both.where(~F.col("b_sig").eqNullSafe(F.col("a_sig"))).select("key", F.lit("signature_changed").alias("change"))
    narrowed = both.where("a_vis <> 'public'").select("key", F.lit("visibility_reduced").alias("change"))
    gone = b.join(a, F.col("key") == F.col("a_key"), "left_anti")
    fresh = a.join(before.select(F.col("key").alias("a_key")), "a_key", "left_anti")
    to = gone.join(fresh, (F.col("b_file") == F.col("a_file")) & F.col("b_sig").eqNullSafe(F.col("a_sig")) & (F.col("b_name") != F.col("a_name")), "left_semi").select("key", F.lit("renamed").alias("change"))
    removed = gone.join(to.select("key"), "key", "left_anti").select("key", F.lit("removed").alias("change"))
    return changed.unionByName(narrowed).unionByName(to).unionByName(removed)


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """All symbols by canonical id: signature_changed, export_added, export_removed, renamed, removed, added.

    Old and new symbols left over are paired as renames when kind and parameter count agree, in the order of their ids.
    """
    o = old.select(F.col("key").alias("o_key"), F.col("kind").alias("o_kind"), F.col("signature").alias("o_sig"), (F.col("visibility") == "public").alias("o_pub"))
    n = new.select(F.col("key").alias("n_key"), F.col("kind").alias("n_kind"), F.col("signature").alias("n_sig"), (F.col("visibility") == "public").alias("n_pub"))
    both = o.join(n, F.col("o_key") == F.col("n_key"))
    out = both.where(~F.col("o_sig").eqNullSafe(F.col("n_sig"))).select(F.col("o_key").alias("key"), F.lit("signature_changed").alias("change"))
    out = out.unionByName(both.where("o_pub <> n_pub").select(F.col("o_key").alias("key"), F.when(F.col("n_pub"), "export_added").otherwise("export_removed").alias("change")))
    left = o.join(n, F.col("o_key") == F.col("n_key"), "left_anti").withColumn("p", S.parameter_count("o_sig"))
    right = n.join(o, F.col("o_key") == F.col("n_key"), "left_anti").withColumn("p", S.parameter_count("n_sig"))
    left = left.withColumn("r", F.row_number().over(W.partitionBy("o_kind", "p").orderBy("o_key")))
    right = right.withColumn("r", F.row_number().over(W.partitionBy("n_kind", "p").orderBy("n_key"))).withColumnsRenamed({"p": "np", "r": "nr"})
    pair = left.join(right, (F.col("o_kind") == F.col("n_kind")) & (F.col("p") == F.col("np")) & (F.col("r") == F.col("nr")), "full_outer")
    return out.unionByName(pair.select(F.coalesce("o_key", "n_key").alias("key"), F.when(F.col("n_key").isNull(), "removed").when(F.col("o_key").isNull(), "added").otherwise("renamed").alias("change")))


def parameter_diff(base: DataFrame, head: DataFrame, keys: tuple[str, ...] = ("operation", "location", "name")) -> DataFrame:
    """Parameters by operation, place and name: added, removed, type or requirement changed, each breaking or info."""
    b = base.select(*keys, F.col("type").alias("bt"), F.col("required").alias("br"), F.lit(True).alias("_b"))
    h = head.select(*keys, F.col("type").alias("ht"), F.col("required").alias("hr"), F.lit(True).alias("_h"))
    j = b.join(h, list(keys), "full_outer")
    change = (
        F.when(F.col("_h").isNull(), "removed").when(F.col("_b").isNull(), F.when(F.col("hr"), "added_required").otherwise("added_optional"))
        .when(F.col("bt") != F.col("ht"), "type_changed").when(F.col("hr") & ~F.col("br"), "now_required").when(F.col("br") & ~F.col("hr"), "now_optional")
    )
    return j.withColumn("change", change).where("change is not null").select(*keys, "change", F.when(F.col("change").isin("added_optional", "now_optional"), "info").otherwise("breaking").alias("severity"))


def response_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """Response codes that went away (breaking for a success code that no class such as 2XX covers) or came."""
    cover = head.where(F.col("code").rlike("^[1-5][xX]{2}$|^default$")).select("operation", F.lower("code").alias("cover")).distinct()
    gone = base.join(head, ["operation", "code"], "left_anti")
    kept = gone.join(cover, (gone["operation"] == cover["operation"]) & ((F.col("cover") == F.concat(F.substring("code", 1, 1), F.lit("xx"))) | (F.col("cover") == "default")), "left_semi")
    lost = gone.join(kept, ["operation", "code"], "left_anti")
    new = head.join(base, ["operation", "code"], "left_anti")
    return lost.select("operation", "code", F.lit("removed").alias("change"), F.when(F.col("code").startswith("2"), "breaking").otherwise("info").alias("severity")).unionByName(new.select("operation", "code", F.lit("added").alias("change"), F.lit("info").alias("severity")))


def openapi_diff(base: tuple[DataFrame, DataFrame, DataFrame], head: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """operation, what, change, severity over (operations, parameters, responses) of two versions."""
    gone = base[0].join(head[0], "operation", "left_anti").select("operation", F.lit("operation").alias("what"), F.lit("removed").alias("change"), F.lit("breaking").alias("severity"))
    new = head[0].join(base[0], "operation", "left_anti").select("operation", F.lit("operation").alias("what"), F.lit("added").alias("change"), F.lit("info").alias("severity"))
    both = base[0].join(head[0], "operation", "left_semi").select("operation")
    p = parameter_diff(base[1].join(both, "operation", "left_semi"), head[1].join(both, "operation", "left_semi")).select("operation", F.concat_ws(" ", "location", "name").alias("what"), "change", "severity")
    r = response_diff(base[2].join(both, "operation", "left_semi"), head[2].join(both, "operation", "left_semi")).select("operation", F.concat(F.lit("response "), "code").alias("what"), "change", "severity")
    return gone.unionByName(new).unionByName(p).unionByName(r)


def unlinked_mentions(notes: DataFrame, resolved: DataFrame, uid: str) -> DataFrame:
    """Notes of the same vault whose text holds the note's title and that do not link to it, with a snippet."""
    one = notes.where(F.col("uid") == uid).select(F.lower("title").alias("_t"), F.col("vault_uid").alias("_v"))
    hit = notes.join(F.broadcast(one), F.col("vault_uid") == F.col("_v")).where((F.col("uid") != uid) & F.lower("text").contains(F.col("_t")))
    free = hit.join(resolved.where(F.col("dst") == uid).select(F.col("src").alias("uid")).distinct(), "uid", "left_anti")
    return free.select("uid", F.expr("substring(text, greatest(1, locate(_t, lower(text)) - 40), 80 + length(_t))").alias("snippet"), F.expr("cast(locate(_t, lower(text)) as bigint)").alias("at"))


def federated_union(local: DataFrame, server: DataFrame, key: str = "key") -> DataFrame:
    """Local rows, and the server's rows of keys that are not local; `tier` tells where from (both: known to each)."""
    s = server.select(F.col(key).alias("_k")).distinct()
    mine = local.join(s, F.col(key) == F.col("_k"), "left").withColumn("tier", F.when(F.col("_k").isNull(), "local").otherwise("both")).drop("_k")
    other = server.join(local.select(key).distinct(), key, "left_anti").withColumn("tier", F.lit("server"))
    return mine.unionByName(other, allowMissingColumns=True)


def reconcile(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What to add and remove to turn the old edges into the new."""
    add = new.join(old.select(*keys), keys, "left_anti").select(*keys, F.lit("add").alias("action"))
    return add.unionByName(old.join(new.select(*keys), keys, "left_anti").select(*keys, F.lit("remove").alias("action")))

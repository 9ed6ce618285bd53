"""Full text, vectors, fusion and re-ranking."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom import model
from graphloom.functions import scalar as S
from graphloom.plans.iterate import cut, numbered

K1, B, TITLE_BOOST = 1.2, 0.75, 3.0
RRF_K = 60
#: Characters of a run by which names are looked up.
GRAM = 3


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def postings(docs: DataFrame, fields: Mapping[str, str] = {"title": "title", "body": "text"}) -> DataFrame:
    """uid, field, term, tf, length. A view: what a search asks of terms or documents is asked before terms are counted."""
    out = None
    for field, column in fields.items():
        t = docs.select("uid", F.lit(field).alias("field"), tokens(F.coalesce(column, F.lit(""))).alias("t")).withColumn("length", F.size("t"))
        step = t.select("uid", "field", "length", F.explode("t").alias("term")).groupBy("uid", "field", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("length").cast("long").alias("length"))
        out = step if out is None else out.unionByName(step)
    return out


def field_lengths(docs: DataFrame, fields: Mapping[str, str] = {"title": "title", "body": "text"}) -> DataFrame:
    """field, n_docs, avg_length: over all documents, empty ones too."""
    out = None
    for field, column in fields.items():
        step = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(tokens(F.coalesce(column, F.lit(""))))).alias("avg_length")).select(F.lit(field).alias("field"), "n_docs", "avg_length")
        out = step if out is None else out.unionByName(step)
    return out


def bm25(index: DataFrame, lengths: DataFrame, terms: Mapping[str, float], boosts: Mapping[str, float] = {"title": TITLE_BOOST}) -> DataFrame:
    """uid, score: weighted terms over all fields; any term is enough. The postings of the terms are written once."""
    hit = cut(index.where(F.col("term").isin(*terms)))
    df = hit.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))
    j = hit.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(lengths), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.lit(0.0)
    for t, w in terms.items():
        weight = F.when(F.col("term") == t, float(w)).otherwise(weight)
    for f, b in boosts.items():
        weight = weight * F.when(F.col("field") == f, b).otherwise(1.0)
    part = weight * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    return j.groupBy("uid").agg(F.sum(part).alias("score"))


def query_terms(query: str) -> dict[str, float]:
    import re

    return dict.fromkeys(re.findall(r"\w+", query.lower().replace("_", " ")), 1.0)


def parse_query(query: str) -> dict:
    """terms, required terms, phrases and fields of a query; what does not parse is taken as plain words.

    `a AND b` and `+a` require, `"a b"` is a phrase, `title:a` names a field, `a OR b` and bare words are optional.
    """
    import re

    out: dict = {"terms": {}, "must": set(), "phrases": [], "fields": {}}
    parts = re.findall(r'"[^"]+"|\S+', query)
    for i, x in enumerate(parts):
        if x in ("AND", "OR"):
            continue
        if x.startswith('"') and x.endswith('"') and len(x) > 1:
            out["phrases"].append(x[1:-1].lower())
            out["terms"] |= query_terms(x[1:-1])
            continue
        field, _, rest = x.partition(":") if re.match(r"^(title|body):\w", x) else ("", "", x)
        words = query_terms(rest)
        out["terms"] |= words
        if field:
            out["fields"] |= dict.fromkeys(words, field)
        if x.startswith("+") or "AND" in (parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""):
            out["must"] |= set(words)
    return out


def boolean_search(docs: DataFrame, index: DataFrame, lengths: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """BM25 of all terms over the documents that hold the required ones, the phrases and the fields' terms; all of them, or the best so many."""
    q = parse_query(query)
    hits = bm25(index, lengths, q["terms"] or {"": 0.0})
    if q["must"]:
        all_of = index.where(F.col("term").isin(*q["must"])).groupBy("uid").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(q["must"]))
        hits = hits.join(all_of, "uid", "left_semi")
    for term, field in q["fields"].items():
        hits = hits.join(index.where((F.col("term") == term) & (F.col("field") == field)), "uid", "left_semi")
    for phrase in q["phrases"]:
        line = F.array_join(tokens(F.concat_ws(" ", "title", "text")), " ")
        want = " ".join(query_terms(phrase))
        hits = hits.join(docs.where(F.concat(F.lit(" "), line, F.lit(" ")).contains(f" {want} ")).select("uid"), "uid", "left_semi")
    return hits if limit is None else hits.orderBy(F.desc("score"), "uid").limit(limit)


def prf_terms(index: DataFrame, lengths: DataFrame, first: DataFrame, query: str, stopwords: Iterable[str] = model.STOPWORDS, hits: int = 5, top: int = 10) -> DataFrame:
    """term, weight of expansion: from the bodies of the first hits; idf at least the (upper) median, the best by idf * tf."""
    best = cut(first.orderBy(F.desc("score"), "uid").limit(hits).select("uid"))
    body = index.where("field = 'body'")
    tf = body.join(F.broadcast(best), "uid", "left_semi").where((F.length("term") >= 3) & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(*query_terms(query), *stopwords)).groupBy("term").agg(F.sum("tf").alias("freq"))
    tf = cut(tf)
    df = body.join(F.broadcast(tf.select("term")), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = cut(df)
    scored = tf.join(df, "term").join(F.broadcast(lengths.where("field = 'body'")), how="inner").withColumn("idf", F.log(F.col("n_docs") / (1.0 + F.col("df"))))
    # the terms of five documents: one small partition
    w = W.orderBy("idf", "term")
    ordered = scored.withColumn("r", F.row_number().over(w) - 1)
    middle = ordered.agg(F.floor(F.count(F.lit(1)) / 2).alias("mid")).join(ordered.select("r", "idf"), F.col("mid") == F.col("r")).select(F.col("idf").alias("median"))
    kept = scored.join(F.broadcast(middle), how="inner").where("idf >= median").withColumn("rank_score", F.col("idf") * F.col("freq"))
    return kept.orderBy(F.desc("rank_score"), "term").limit(top).select("term", "idf", "freq", "rank_score")


def prf_search(index: DataFrame, lengths: DataFrame, query: str, limit: int, weight: float = 0.3) -> DataFrame:
    """Two passes: the query, then the query with at most ten expansion terms at a lower weight."""
    first = bm25(index, lengths, query_terms(query))
    extra = {r.term: weight for r in prf_terms(index, lengths, first, query).collect()}
    return bm25(index, lengths, extra | query_terms(query)).orderBy(F.desc("score"), "uid").limit(limit)


def similarity(vector: Column, query: Iterable[float], kind: str = "cosine") -> Column:
    q = [float(x) for x in query]
    lit = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(vector, lit, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    if kind == "dot":
        return dot
    norm = sum(x * x for x in q) ** 0.5
    own = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((own > 0) & F.lit(norm > 0), dot / (own * F.lit(norm if norm else 1.0))).otherwise(0.0)


def vector_search(vectors: DataFrame, query: Iterable[float], limit: int, where: Column | None = None, kind: str = "cosine") -> DataFrame:
    """uid, score: exact; the predicate comes before the cut; other dimensions are skipped; nothing for a zero query."""
    q = list(query)
    rows = vectors.where(F.size("embedding") == len(q))
    if not any(q):
        rows = rows.where(F.lit(False))
    rows = rows if where is None else rows.where(where)
    return rows.select("uid", similarity(F.col("embedding"), q, kind).alias("score")).orderBy(F.desc("score"), "uid").limit(limit)


def rrf(lists: Mapping[str, DataFrame], weights: Mapping[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """uid, score, sources: sum of weight / (k + rank + 1), rank from 0 by score and uid in each (cut) list."""
    out = None
    for name, df in lists.items():
        r = F.row_number().over(W.orderBy(F.desc("score"), "uid"))
        step = df.select("uid", F.lit(name).alias("source"), (F.lit((weights or {}).get(name, 1.0)) / (k + r)).alias("part"))
        out = step if out is None else out.unionByName(step)
    return out.groupBy("uid").agg(F.sum("part").alias("score"), F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))


def tanh_normalized(df: DataFrame, column: str = "score") -> DataFrame:
    """The column as tanh(x / lower median of the positive values); 0 when none is positive."""
    median = df.where(F.col(column) > 0).agg(F.expr(f"percentile_disc(0.5) within group (order by {column})").alias("_m"))
    return df.join(F.broadcast(median), how="inner").withColumn(column, F.when(F.col("_m").isNull(), 0.0).otherwise(F.tanh(F.col(column) / F.col("_m")))).drop("_m")


def weighted_fuse(ppr: DataFrame, text: DataFrame, vectors: DataFrame, w_ppr: float = 0.4, w_text: float = 0.25, w_vector: float = 0.35) -> DataFrame:
    """uid, score: each signal normalised over the union, then weighed."""
    j = ppr.select("uid", F.col("score").alias("a")).join(text.select("uid", F.col("score").alias("b")), "uid", "full_outer").join(vectors.select("uid", F.col("score").alias("c")), "uid", "full_outer").fillna(0.0, ["a", "b", "c"])
    med = j.agg(*[F.expr(f"percentile_disc(0.5) within group (order by case when {x} > 0 then {x} end)").alias(f"m{x}") for x in "abc"])
    norm = lambda x: F.when(F.col(f"m{x}").isNull(), 0.0).otherwise(F.tanh(F.col(x) / F.col(f"m{x}")))
    return j.join(F.broadcast(med), how="inner").select("uid", (w_ppr * norm("a") + w_text * norm("b") + w_vector * norm("c")).alias("score"))


def apply_priors(df: DataFrame, location: str, rules: Iterable[tuple[str, float]], low: float = 0.0, high: float = 10.0) -> DataFrame:
    """Scores times the last matching rule's multiplier, clamped; others as they are."""
    m = S.ranking_prior(location, list(rules))
    return df.withColumn("score", F.when(m.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), F.col("score") * m))).otherwise(F.col("score")))


def rerank(df: DataFrame, top: int = 50, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The first `top` by score (uid, score, age_days, is_doc, has_body, aliases) scored again; the rest keep their order."""
    w = {"relevance": 1.0, "rank": -0.001, "recency": 0.05, "doc": 0.02, "body": 0.02, "alias": 0.01} | dict(weights or {})
    r = numbered(df, F.desc("score"), "uid", name="rank").withColumn("rank", F.col("rank").cast("int"))
    new = (
        w["relevance"] * F.col("score") + w["rank"] * F.col("rank") + w["recency"] * F.coalesce(F.pow(F.lit(2.0), -F.col("age_days") / 30.0), F.lit(0.0))
        + w["doc"] * F.col("is_doc").cast("int") + w["body"] * F.col("has_body").cast("int") + w["alias"] * F.least(F.coalesce("aliases", F.lit(0)), F.lit(3))
    )
    # only the head changes places; the window is over its `top` rows
    head = r.where(F.col("rank") < top).withColumn("rerank_score", new).withColumn("position", F.row_number().over(W.orderBy(F.desc("rerank_score"), "rank")))
    return head.unionByName(r.where(F.col("rank") >= top).withColumns({"rerank_score": F.lit(None).cast("double"), "position": F.col("rank") + 1}))


def expand_query(query: str, aliases: Mapping[str, Iterable[str]], most: int = 10) -> str:
    """The query and the canonical names (ten at most, by alias) of the whole words that are aliases of two letters or more."""
    words = set(query.lower().split())
    found: list[str] = []
    for alias, name in sorted((a.lower(), name) for name, many in aliases.items() for a in many if len(a) >= 2):
        if alias in words and name not in found and len(found) < most:
            found.append(name)
    return " ".join([query, *found])


def _grams(text: Column) -> Column:
    """The distinct runs of GRAM characters of a text; of a shorter one, the text."""
    n = F.length(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - GRAM + 1, F.lit(1))), lambda i: F.substring(text, i, GRAM)))


def _containing(short: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b) of the texts a of short and b of long such that b contains a.

    A text is looked up by the rarest of its runs of characters among those of the long ones; runs that are
    shorter than GRAM, which whole short texts are, are indexed apart.
    """
    index = long.select("b", F.explode(_grams(F.col("b"))).alias("g"))
    tiny = short.where(F.length("a") < GRAM)
    runs = long.select("b", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("b")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda k: F.col("b").substr(i, k)))))).alias("a"))
    found = runs.join(tiny, "a", "left_semi").select("a", "b").distinct()
    wide = short.where(F.length("a") >= GRAM)
    counts = index.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    # a run that no long text has rules its text out
    asked = wide.select("a", F.explode(_grams(F.col("a"))).alias("g")).join(counts, "g", "left").groupBy("a").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), "g")).alias("g"))
    return found.unionByName(asked.join(index, "g").where(F.col("b").contains(F.col("a"))).select("a", "b"))


def suggest_targets(targets: DataFrame, notes: DataFrame, most: int = 3) -> DataFrame:
    """target, uid, score: notes for an unresolved target (src, target): 3 equal, 2 contains it, 1 is contained in it.

    Equal names meet by key; containment is found through the rarest run of characters, never by pairing all.
    """
    t = targets.select("src", "target").distinct().withColumn("k", F.lower(F.trim("target"))).where("k <> ''").withColumn("kn", S.normalize_key("k"))
    n = notes.select("uid", "title", F.explode(F.array(F.lower("title"), S.note_stem("file_path"))).alias("name")).where("name <> ''").withColumn("nn", S.normalize_key("name"))
    keys, names = t.select("k", "kn").distinct(), n.select("name", "nn").distinct()
    same = keys.join(names.select("name"), F.col("k") == F.col("name")).select("k", "name").unionByName(keys.where("kn <> ''").join(names.where("nn <> ''"), F.col("kn") == F.col("nn")).select("k", "name"))
    short, long = keys.select(F.col("k").alias("a")).distinct(), names.select(F.col("name").alias("b")).distinct()
    inside = _containing(short, long).select(F.col("a").alias("k"), F.col("b").alias("name"))
    around = _containing(long.select(F.col("b").alias("a")), short.select(F.col("a").alias("b"))).select(F.col("b").alias("k"), F.col("a").alias("name"))
    of = same.withColumn("score", F.lit(3)).unionByName(inside.withColumn("score", F.lit(2))).unionByName(around.withColumn("score", F.lit(1))).groupBy("k", "name").agg(F.max("score").alias("score"))
    hit = t.select("src", "target", "k").join(of, "k").join(n.select("uid", "title", "name"), "name").where("uid <> src").groupBy("src", "target", "uid", "title").agg(F.max("score").alias("score"))
    w = W.partitionBy("src", "target").orderBy(F.desc("score"), "title", "uid")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("src", "target", "uid", "score", "r")


def pooled(vectors: DataFrame, key: str = "uid") -> DataFrame:
    """Mean of token vectors (key, embedding) by key."""
    e = vectors.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return e.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))

"""Queries that SQL cannot say, against plain Python over the whole smallest tables."""

import re
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators.notes import note_edges
from graphloom.queries.joined import resolved
from graphloom.registry import QUERIES, Tables

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, DIR)


@pytest.fixture(scope="module")
def edges(t):
    return [tuple(r) for r in t.edges.select("src", "dst", "rel", "confidence").collect()]


def plain_betweenness(pairs):
    """All shortest paths from every node, counted there and added up on the way back."""
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order, todo = {s: 0}, Counter({s: 1}), [], deque([s])
        while todo:
            u = todo.popleft()
            order.append(u)
            for v in near[u]:
                if v not in dist:
                    dist[v] = dist[u] + 1
                    todo.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        through = Counter()
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] - 1:
                    through[u] += paths[u] / paths[v] * (1 + through[v])
            if v != s:
                score[v] += through[v] / 2
    return score


def test_betweenness_and_bridges(spark, t, edges):
    pairs = [(a, b) for a, b, rel, _ in edges if rel in ("IMPORTS", "MEMBER_OF")]
    want = plain_betweenness(pairs)
    got = {r.uid: r.betweenness for r in QUERIES["betweenness"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(abs(got[u] - want[u]) < 1e-5 for u in want)
    repos = {r.uid: r.repo_uid for r in t.symbols.collect()}
    top = sorted(want, key=lambda u: (-round(want[u], 6), u))[:10]
    rows = {r.uid: r for r in QUERIES["bridges"](spark, DIR).collect()}
    assert {round(r.betweenness, 5) for r in rows.values()} == {round(want[u], 5) for u in top}
    for u, r in rows.items():
        around = {repos[y] for a, b in pairs for x, y in ((a, b), (b, a)) if x == u and y in repos} | {repos[u]}
        assert r.repos == ",".join(sorted(around))


def walk(nodes, weights, seeds, damping, rounds=20, every=4, tolerance=1e-6):
    out = defaultdict(float)
    for (a, _), w in weights.items():
        out[a] += w
    k = len([s for s in seeds if s in nodes])
    p = {u: (1 / k if u in seeds else 0.0) for u in nodes}
    score = dict(p)
    for r in range(1, rounds + 1):
        new = Counter()
        for (a, b), w in weights.items():
            new[b] += score[a] * w / out[a]
        lost = sum(s for u, s in score.items() if u not in out)
        fresh = {u: (1 - damping) * p[u] + damping * lost * p[u] + damping * new[u] for u in nodes}
        moved = max(abs(fresh[u] - score[u]) for u in nodes)
        score = fresh
        if r % every == 0 and moved < tolerance:
            break
    return score


def scope(nodes, edges, kind, intent=None):
    out = Counter()
    for a, b, rel, c in edges:
        c = 1.0 if c is None else c
        if rel in model.SCOPES[kind] and c > 0 and a in nodes and b in nodes:
            w = c * model.RELATION_WEIGHT.get(rel, 1.0) * (model.CALLS_MULTIPLIER.get(intent, 1.0) if rel == "CALLS" else 1.0)
            out[a, b] += w
            out[b, a] += w * model.REVERSE_WEIGHT
    return out


def test_unified_rank(spark, t, edges):
    mention = t.documents.join(t.part, F.col("p_partkey") == F.col("doc_id")).select(F.concat(F.lit("note:"), "doc_id").alias("src"), F.concat(F.lit("part:"), "p_partkey").alias("dst"), F.lit(0.85).alias("confidence"))
    every = edges + [tuple(r) for r in note_edges(t.notes, t.tags, resolved(t), mention).select("src", "dst", "rel", "confidence").collect()]
    nodes = {x for a, b, *_ in every for x in (a, b)}
    score = walk(nodes, scope(nodes, every, "unified"), {"note:1"}, 0.75)
    want = {u: s for u, s in score.items() if s > model.PPR_FLOOR or u == "note:1"}
    got = {r.uid: r.score for r in QUERIES["unified_rank"](spark, DIR).collect()}
    assert got.keys() == want.keys() and len(got) > 20 and all(abs(got[u] - want[u]) < 1e-7 for u in want)


def test_code_context(spark, t, edges):
    symbols = {r.uid: r for r in t.symbols.collect()}
    rows = QUERIES["code_context"](spark, DIR).collect()
    seeds = {"sup:3"} | {u for u, r in symbols.items() if r.name == "red_widget"}
    picked = [symbols[u] for u in seeds if u in symbols]
    intent = "analyze-impact" if any(r.is_entry_point for r in picked) else "find-definition" if len(picked) == 1 else "understand-architecture" if len({r.file_path for r in picked}) > 1 else "general-context"
    score = walk(set(symbols), scope(set(symbols), edges, "code", intent), {r.uid for r in picked}, model.DAMPING[intent])
    want = sorted(score, key=lambda u: (symbols[u].name == "<module>", -score[u], u))[: len(rows)]
    assert {r.uid: r.score for r in rows} == pytest.approx({u: score[u] for u in want}, abs=1e-7)


def cliques(edges):
    near = defaultdict(Counter)
    for a, b, w in edges:
        if a != b:
            near[a][b] += w
            near[b][a] += w
    return near


def quality(near, of):
    total = sum(sum(c.values()) for c in near.values())
    inside, degree = Counter(), Counter()
    for a, c in near.items():
        degree[of[a]] += sum(c.values())
        for b, w in c.items():
            inside[of[a]] += w * (of[a] == of[b])
    return sum(inside[c] / total - (degree[c] / total) ** 2 for c in degree)


def test_communities_cannot_be_bettered_by_a_move(spark, t, edges):
    """Every node once, each community named by its least member and connected, and no single move to a neighbour's betters the modularity."""
    near = cliques([(a, b, 1.0 if c is None else c) for a, b, rel, c in edges if rel in ("IMPORTS", "MEMBER_OF", "CROSS_REPO_LINK")])
    of = {r.uid: r.community for r in QUERIES["communities"](spark, DIR).collect()}
    assert of.keys() == near.keys()
    members = defaultdict(set)
    for u, c in of.items():
        members[c].add(u)
    for c, m in members.items():
        assert c == min(m)
        seen, todo = {c}, [c]
        while todo:
            for v in near[todo.pop()]:
                if v in m and v not in seen:
                    seen.add(v)
                    todo.append(v)
        assert seen == m
    best = quality(near, of)
    assert best > 0.2
    for u in near:
        for c in {of[v] for v in near[u]} - {of[u]}:
            assert quality(near, of | {u: c}) <= best + 1e-8


def test_topic_clusters_partition_the_linked_notes(spark, t):
    links = {(r.src, r.dst) for r in resolved(t).where("src <> dst").select("src", "dst").distinct().collect()}
    titles = {r.uid: r.title for r in t.notes.select("uid", "title").collect()}
    rows = QUERIES["topic_clusters"](spark, DIR).collect()
    assert sum(r["size"] for r in rows) == len({u for pair in links for u in pair})
    assert len(rows) == len({r.community for r in rows}) and all(r.label in titles.values() and r.community in titles for r in rows)
    degree = Counter(titles[b] for _, b in links)
    assert sum(degree[r.label] for r in rows) >= len(rows) / 2


def test_code_mentions(spark, t):
    got = {(r.path, r.name): r.n for r in QUERIES["code_mentions_in_notes"](spark, DIR).collect()}
    paths = {r.file_path for r in t.notes.collect()}
    assert {p for p, name in got if name == "load_table"} == paths and all(n >= 1 for n in got.values())


def test_markdown_facts(spark, t):
    want = Counter()
    for r in t.notes.select("file_path", "title", "text").collect():
        text = f"# {r.title}\n{r.text}"
        want[r.file_path, "title"] += 1
        fence = False
        for line in text.split("\n"):
            if re.match(r"^\s*(```|~~~)", line):
                fence = not fence
            elif not fence and re.match(r"^#{1,6}\s+\S", line):
                want[r.file_path, "heading"] += 1
    got = {(r.path, r.kind): r.n for r in QUERIES["markdown_facts"](spark, DIR).collect()}
    assert {k: n for k, n in got.items() if k[1] in ("title", "heading")} == dict(want)
    assert all(got[p, "section"] == want[p, "heading"] for p, kind in want if kind == "heading")


def test_html_as_markdown_keeps_every_word(spark, t):
    """Words outside menus, footers, scripts and styles are there, once for each time they stand on the page, and no tag is."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.skip = [], 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "head", "nav", "footer", "header", "form", "aside")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "head", "nav", "footer", "header", "form", "aside")

        def handle_data(self, data):
            if not self.skip:
                self.out += re.findall(r"\w+", data)

    pages = {r.page_id: r.html for r in t.pages.collect()}
    missing = total = 0
    for r in QUERIES["html_as_markdown"](spark, DIR).collect():
        p = Words()
        p.feed(pages[r.page_id] or "")
        have = Counter(re.findall(r"\w+", r.markdown or ""))
        want = Counter(p.out)
        total += sum(want.values())
        missing += sum((want - have).values())
        assert not re.search(r"</?(p|div|span|article|h[1-6])\b", r.markdown or "")
    assert total > 500 and missing <= 0.02 * total

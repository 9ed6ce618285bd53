"""Budgets, property bags and scope chains against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import annotations as AN
from graphloom.operators import budget as BU
from graphloom.operators import scopes as SC


def walk(edges, seeds, depth, steps):
    """One step at a time: nodes of a depth by uid, ways out by where they lead."""
    out = {}
    for a, b in sorted(set(edges)):
        out.setdefault(a, []).append(b)
    seen, level, used = {s: 0 for s in seeds}, sorted(set(seeds)), 0
    for d in range(depth + 1):
        new = set()
        for u in level:
            if used == steps:
                return seen, used, True
            used += 1
            for v in out.get(u, []) if d < depth else []:
                if used == steps:
                    return seen, used, True
                used += 1
                if v not in seen:
                    seen[v] = d + 1
                    new.add(v)
        level = sorted(new)
    return seen, used, False


def test_budget_is_exact(spark):
    rng = random.Random(3)
    rows = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(70)]
    df = spark.createDataFrame([(a, b, "CALLS") for a, b in rows] + [("n00", "x", "OTHER")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("n00",), ("n01",), ("n01",), ("lone",)], "uid string")
    for depth, steps in [(0, 2), (0, 3), (2, 0), (2, 1), (2, 5), (2, 9), (3, 17), (3, 40), (3, 10_000)]:
        got = BU.bounded_reach(df, seeds, depth, steps)
        nodes = {r.uid: r.depth for r in got.nodes.collect()}
        assert (nodes, got.steps, got.truncated) == walk(rows, ["n00", "n01", "lone"], depth, steps), (depth, steps)


def test_deadline(spark):
    df = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "CALLS")], "src string, dst string, rel string")
    seeds = spark.createDataFrame([("a",)], "uid string")
    over = BU.bounded_reach(df, seeds, 3, 100, seconds=0)
    assert over.truncated and {r.uid for r in over.nodes.collect()} == {"a"}
    fine = BU.bounded_reach(df, seeds, 3, 100, seconds=300)
    assert not fine.truncated and fine.nodes.count() == 3


def test_bags_take_the_last_writer_of_each_key(spark):
    rng = random.Random(5)
    rows, held = [], {}
    for k in range(200):
        uid = f"u{rng.randrange(8)}"
        bag = {rng.choice("abcd"): rng.choice([1, 2.5, "x", True, None, {"deep": {"n": k}}, [1, k]]) for _ in range(rng.randint(0, 3))}
        rows.append((uid, k, json.dumps(bag)))
        held.setdefault(uid, {}).update(bag)
    rows += [("u0", 900, "not json"), ("u0", 901, "[1]"), ("u1", 902, None), ("u1", 903, "3")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "uid string, seq long, bag string")
    want = {u: {k: v for k, v in bag.items() if v is not None} for u, bag in held.items()}
    want = {u: b for u, b in want.items() if b}
    whole = AN.bags(AN.entries(df))
    cut = df.where("seq % 3 = 0")
    for got in (whole, AN.bags(AN.merged(AN.entries(cut), df.where("seq % 3 <> 0"))), AN.bags(AN.merged(AN.entries(df), df.limit(50)))):
        assert {r.uid: json.loads(r.bag) for r in got.select("uid", F.to_json("bag").alias("bag")).collect()} == want
    assert AN.rejected(df).count() == 4
    nodes = spark.createDataFrame([(f"u{k}",) for k in range(9)], "uid string")
    for r in AN.annotated(nodes, whole, a=("a", "string"), deep=("$.b.deep.n", "long")).collect():
        b = want.get(r.uid, {})
        assert r.deep == (b["b"]["deep"]["n"] if isinstance(b.get("b"), dict) else None)
        assert (r.a is None) == ("a" not in b) or isinstance(b["a"], (dict, list))
    assert AN.bags(AN.entries(df.where(F.lit(False)))).count() == 0


@pytest.mark.parametrize("shape", ["nested", "any"])
def test_chains_by_comparing_all_pairs(spark, shape):
    rng = random.Random(shape == "any")
    rows = []

    def nest(file, a, b, depth):
        rows.append((file, a, b, f"s{len(rows)}", f"u{len(rows):04}"))
        while depth and b - a > 2 and rng.random() < 0.8:
            x = rng.randint(a, b - 1)
            nest(file, x, rng.randint(x, b), depth - 1)
            a = x + 1

    if shape == "nested":
        for f in range(4):
            for k in range(12 if f else 60):  # one file holds most rows
                nest(f"f{f}", 100 * k, 100 * k + 90, 5)
    else:
        for k in range(500):
            a = rng.randint(0, 60)
            rows.append((rng.choice(["f", "f", "f", "g", None]), a, a + rng.randint(-1, 25), rng.choice([f"s{k}", None]), f"u{k:04}"))
    want = {}
    for f, a, b, _, u in rows:
        if f is None or a > b:
            continue
        over = [(x, -y, v, n) for g, x, y, n, v in rows if g == f and x <= y and v != u and x <= a and y >= b and ((x, -y, v) < (a, -b, u))]
        chain = [n for *_, n in sorted(over, key=lambda z: z[:3]) if n is not None]
        want[u] = ("::".join(chain) or None, len(chain))
    df = spark.createDataFrame(rows, "file string, start int, stop int, name string, uid string").repartition(6)
    assert {r.uid: (r.chain, r.depth) for r in SC.scope_chains(df).collect()} == want
    assert SC.scope_chains(df.where(F.lit(False))).count() == 0

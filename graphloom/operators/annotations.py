"""Typed property bags on nodes, as values of type VARIANT.

Writes are rows (uid, seq, bag): a JSON object whose keys replace those of earlier writes, key by key; a key with null is
taken away. Bags are merged by the last writer of each key, so writes may come in any order and any number of batches,
and merged bags can be merged again with later ones. What is no JSON object is no write; `rejected` tells which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _objects(writes: DataFrame) -> DataFrame:
    parsed = writes.select("uid", "seq", F.expr("try_parse_json(bag)").alias("v"))
    return parsed.where(F.col("v").isNotNull() & F.expr("schema_of_variant(v) LIKE 'OBJECT<%'"))


def rejected(writes: DataFrame) -> DataFrame:
    """Writes that are not JSON objects."""
    return writes.where(F.expr("try_parse_json(bag) IS NULL OR schema_of_variant(try_parse_json(bag)) NOT LIKE 'OBJECT<%'"))


def entries(writes: DataFrame) -> DataFrame:
    """uid, key, value (variant), seq: the last write of every key, those that took it away too; of writes with one seq the greater text wins."""
    each = writes.sparkSession.sql("SELECT o.uid, o.seq, e.key, e.value FROM {o} o, LATERAL variant_explode(o.v) AS e", o=_objects(writes))
    return each.groupBy("uid", "key").agg(F.max_by(F.struct("value", "seq"), F.struct("seq", F.to_json("value"))).alias("x")).select("uid", "key", "x.value", "x.seq")


def bags(last: DataFrame) -> DataFrame:
    """uid, bag (variant): entries put together again; nodes whose keys were all taken away have none."""
    kept = last.where(F.col("value").isNotNull() & ~F.is_variant_null("value"))
    return kept.groupBy("uid").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("bag"))


def merged(older: DataFrame, writes: DataFrame) -> DataFrame:
    """Entries of both: a batch of writes on top of entries that are stored; keys that no write names are not looked at."""
    new = entries(writes)
    both = older.unionByName(new.select(*older.columns))
    return both.groupBy("uid", "key").agg(F.max_by(F.struct("value", "seq"), F.struct("seq", F.to_json("value"))).alias("x")).select("uid", "key", "x.value", "x.seq")


def value(path: str, kind: str, bag: str = "bag") -> Column:
    """A nested value of a type (`$.risk.score`, `double`); null where it is missing or of another kind."""
    return F.try_variant_get(bag, path if path.startswith("$") else f"$.{path}", kind)


def annotated(nodes: DataFrame, held: DataFrame, **values: tuple[str, str]) -> DataFrame:
    """nodes with typed values of their bags, by name: (path, type)."""
    return nodes.join(held, "uid", "left").select(*[F.col(c) for c in nodes.columns], *[value(*v).alias(k) for k, v in values.items()])


def audit(nodes: DataFrame, held: DataFrame) -> DataFrame:
    """state (annotated, orphaned), nodes: bags on nodes that exist, and on none."""
    state = F.when(F.col("known"), "annotated").otherwise("orphaned").alias("state")
    return held.select("uid").join(nodes.select("uid", F.lit(True).alias("known")).distinct(), "uid", "left").groupBy(state).agg(F.count(F.lit(1)).alias("nodes"))

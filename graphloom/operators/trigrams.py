"""An inverted index of trigrams for regular-expression search.

The folder of an index holds, for each generation (a build or an upsert):

* texts/gen=/block=: the documents, a file for each block of about BLOCK_BYTES, in a range of the order they were given;
* postings/gen=: trigram, block, n, gaps: which documents of a block have a trigram, as the gaps between their ordinals,
  sorted by trigram, so that a search reads the row groups of the trigrams it names;
* dead/gen=: block, ord of documents that this generation replaced or removed;
* commits/gen=: one row, written last. Readers see committed generations only.

A search takes from the parsed pattern the trigrams that any match must hold, looks up how frequent they are, intersects
the lists of the rarest block by block, rarest first, and reads only the files of blocks that are left. The pattern
decides on the rows that remain, so the index changes what is read, never what is found. An upsert writes its own
documents and marks the old ones; work grows with the change.

A Python worker holds at most BATCH_ROWS rows of a batch, CHUNK bytes of texts (or one text, cut into windows) and their trigrams, or
the lists of LIST_ROWS blocks, however many documents there are.

Null texts are empty. Where uids repeat within one build all rows are kept; an upsert replaces all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import reads
from graphloom.plans.iterate import batches_of, cut, exists

BLOCK_BYTES = 64 << 20
#: Lists that are intersected for a clause: the rarest. Any subset of a clause gives candidates enough.
LISTS = 8
#: Blocks up to so many are named to the scan; beyond, the join alone decides.
NAMED_BLOCKS = 10_000
#: A table of candidates of so many rows is sent to every task.
SMALL = 1 << 20
#: Bytes of texts that a worker cuts into trigrams at once, and code points of one text.
CHUNK, WINDOW = 4 << 20, 1 << 20
#: Rows of an Arrow batch: of texts, and of lists.
BATCH_ROWS, LIST_ROWS = 64, 8
POSTINGS = "trigram long, block long, n int, gaps array<int>"


def code(trigram: str) -> int:
    """Three code points in one number."""
    a, b, c = map(ord, trigram)
    return a << 42 | b << 21 | c


def codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text, in order."""
    if len(text) > WINDOW:
        return np.unique(np.concatenate([codes(text[k : k + WINDOW]) for k in range(0, len(text) - 2, WINDOW - 2)]))
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) > 2 else np.zeros(0, np.int64)


def required(pattern: str) -> list[set[str]] | None:
    """Clauses of trigrams of which a match holds one whole; None where nothing is required or the pattern reads otherwise in another dialect."""
    import re

    if "&&" in pattern or re.search(r"\[[^\]]*\[", pattern) or re.search(r"\(\?[a-zA-Z]*[uUxd]", pattern):
        return None  # class operations, and flags that fold more than the index does
    try:
        clauses = reads.required_trigrams(pattern)
    except re.error:
        return None
    if clauses is None:
        return None
    safe = [{t for t in c if all(_plain(x) for x in t)} for c in clauses]
    return None if any(not c for c in safe) else safe


def _plain(c: str) -> bool:
    """A character whose lower case is one character, whatever stands around it."""
    return len(c.lower()) == 1 and c not in "Σσς" and (ord(c) < 0x250 and c not in "İı" or c.lower() == c.upper() == c)


def _schemas(spark: SparkSession, path: str) -> tuple[T.StructType, list[int]]:
    """The documents' columns and the committed generations."""
    import json

    rows = spark.read.schema("columns string, gen int").parquet(f"{path}/commits").orderBy("gen").collect()
    return T.StructType.fromJson(json.loads(rows[0]["columns"])), [r["gen"] for r in rows]


def _read(spark: SparkSession, path: str, what: str, schema: T.StructType | str, gens: list[int], *parts: str) -> DataFrame:
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    full = T.StructType([*schema.fields, *(T.StructField(p, T.LongType() if p == "block" else T.IntegerType()) for p in parts)])
    return spark.read.schema(full).parquet(f"{path}/{what}").where(F.col("gen").isin(gens))


def _texts_schema(columns: T.StructType) -> T.StructType:
    return T.StructType([*columns.fields, T.StructField("ord", T.IntegerType())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches gathered until their texts have CHUNK bytes; cut where one has more."""
    held, size = [], 0
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("low")).to_numpy()) // CHUNK
        for part in np.split(np.arange(b.num_rows), np.flatnonzero(np.diff(ends)) + 1):
            if not len(part):
                continue
            held.append(b.slice(part[0], len(part)))
            size += held[-1].column("low").nbytes
            if size >= CHUNK:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _postings(texts: DataFrame, text: str) -> DataFrame:
    """trigram, block, n, gaps, from rows that hold block and ord; each batch of documents adds up its own lists first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches):
            block, ords = b.column("block").to_numpy(), b.column("ord").to_numpy()
            held = [codes(x) for x in b.column("low").to_pylist()]
            every = np.concatenate(held or [np.zeros(0, np.int64)])
            which = np.repeat(np.arange(len(held)), [len(x) for x in held])
            for one in np.unique(block):
                mine = block[which] == one
                tri, doc = every[mine], ords[which[mine]]
                order = np.lexsort((doc, tri))
                tri, doc = tri[order], doc[order]
                first = np.flatnonzero(np.diff(tri, prepend=-1)) if len(tri) else np.zeros(0, np.int64)
                offsets = np.append(first, len(tri)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(tri[first]), pa.array(np.full(len(first), one)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(doc.astype(np.int32)))], names=["trigram", "block", "ords"])

    rows = texts.select("block", "ord", F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low")).mapInArrow(run, "trigram long, block long, ords array<int>")
    lists = rows.groupBy("trigram", "block").agg(F.array_sort(F.flatten(F.collect_list("ords"))).alias("o"))
    gaps = F.transform("o", lambda x, i: x - F.when(i > 0, F.get("o", i - 1)).otherwise(F.lit(0)))
    return lists.select("trigram", "block", F.size("o").alias("n"), gaps.alias("gaps"))


def _write(docs: DataFrame, path: str, gen: int, text: str, order: Iterable[str], block_bytes: int, replaces: DataFrame | None) -> None:
    spark = docs.sparkSession
    columns = docs.schema
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    dealt = docs.repartitionByRange(max(1, -(-size // block_bytes)), *order).withColumn("block", (F.lit(gen << 32) + F.spark_partition_id()).cast("long"))
    dealt = dealt.withColumn("ord", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).cast("int"))
    dealt.withColumn("gen", F.lit(gen)).write.mode("append").partitionBy("gen", "block").parquet(f"{path}/texts")
    texts = _read(spark, path, "texts", _texts_schema(columns), [gen], "gen", "block")
    rows = _postings(texts, text).withColumn("gen", F.lit(gen))
    with batches_of(spark, BATCH_ROWS):
        rows.repartitionByRange("trigram", "block").sortWithinPartitions("trigram", "block").write.mode("append").partitionBy("gen").parquet(f"{path}/postings")
    if replaces is not None:
        replaces.select("block", "ord", F.lit(gen).alias("gen")).write.mode("append").partitionBy("gen").parquet(f"{path}/dead")
    spark.createDataFrame([(columns.json(), gen)], "columns string, gen int").coalesce(1).write.mode("append").partitionBy("gen").parquet(f"{path}/commits")


def build(docs: DataFrame, path: str, text: str = "text", order: Iterable[str] = ("uid",), block_bytes: int = BLOCK_BYTES) -> None:
    """A new index of docs (uid, the text and what else is to be had with a hit); order: columns by which blocks are ranges."""
    _write(docs, path, 0, text, order, block_bytes, None)


def upsert(spark: SparkSession, path: str, changes: DataFrame, removed: DataFrame | None = None, text: str = "text", key: str = "uid", order: Iterable[str] = ("uid",), block_bytes: int = BLOCK_BYTES) -> None:
    """Documents of changed and removed keys give way to the changes: a generation of its own, seen from its commit on."""
    columns, gens = _schemas(spark, path)
    keys = changes.select(key) if removed is None else changes.select(key).unionByName(removed.select(key))
    old = live(spark, path).join(keys.distinct(), key, "left_semi").select("block", "ord")
    _write(changes.select(*columns.names), path, gens[-1] + 1, text, order, block_bytes, cut(old))


def _dead(spark: SparkSession, path: str, gens: list[int]) -> DataFrame | None:
    return _read(spark, path, "dead", "block long, ord int", gens, "gen").select("block", "ord") if exists(spark, f"{path}/dead") else None


def live(spark: SparkSession, path: str, blocks: list[int] | None = None) -> DataFrame:
    """The documents, with block and ord."""
    columns, gens = _schemas(spark, path)
    texts = _read(spark, path, "texts", _texts_schema(columns), gens, "gen", "block")
    if blocks is not None:
        texts = texts.where(F.col("block").isin(blocks))
    dead = _dead(spark, path, gens)
    return (texts if dead is None else texts.join(dead, ["block", "ord"], "left_anti")).drop("gen")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """trigram (text), documents: over live documents."""
    _, gens = _schemas(spark, path)
    rows = _read(spark, path, "postings", POSTINGS, gens, "gen")
    dead = _dead(spark, path, gens)
    if dead is None:
        n = rows.groupBy("trigram").agg(F.sum("n").cast("long").alias("documents"))
    else:
        n = _live_counts(rows, dead)
    return n.select(F.concat(_character(42), _character(21), _character(0)).alias("trigram"), "documents")


def _character(shift: int):
    """The character at a place of a trigram's number, by way of four big-endian bytes."""
    point = F.shiftright("trigram", shift).bitwiseAND(F.lit((1 << 21) - 1))
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def _live_counts(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """trigram, documents: lists without the dead of their block, which are gathered by block (no more than its documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(g) - (0 if d is None else int(np.isin(np.cumsum(g.values.to_numpy()), d.values.to_numpy()).sum())) for g, d in zip(b.column("gaps"), (x if x.is_valid else None for x in b.column("gone")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("trigram"), pa.array(n, pa.int64())], names=["trigram", "n"])

    gone = dead.groupBy("block").agg(F.collect_set("ord").alias("gone"))
    with batches_of(rows.sparkSession, LIST_ROWS):
        return cut(rows.join(gone, "block", "left").select("trigram", "gaps", "gone").mapInArrow(run, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("documents")).where("documents > 0"))


def candidates(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """block, ord of documents that may match (replaced ones too), stored; None where the pattern requires no trigram."""
    clauses = required(pattern)
    if clauses is None:
        return None
    _, gens = _schemas(spark, path)
    rows = _read(spark, path, "postings", POSTINGS, gens, "gen")
    named = {code(t) for c in clauses for t in c}
    df = {r["trigram"]: r["n"] for r in rows.where(F.col("trigram").isin(*named)).groupBy("trigram").agg(F.sum("n").alias("n")).collect()}  # a row for each trigram of the pattern
    found = None
    for clause in clauses:
        ids = sorted((df.get(code(t), 0), code(t)) for t in clause)
        if not ids[0][0]:
            continue  # a trigram that no document has
        few = [k for _, k in ids[:LISTS]]
        one = rows.where(F.col("trigram").isin(*few)).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("n", "trigram", "gaps"))).alias("lists")).where(F.size("lists") == len(few))
        hit = one.mapInArrow(_intersected, "block long, ord int")
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return spark.createDataFrame([], "block long, ord int")
    with batches_of(spark, LIST_ROWS):
        return cut(found.distinct() if len(clauses) > 1 else found)


def _intersected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordinals in all lists of a block, the rarest list first."""
    for b in batches:
        for block, lists in zip(b.column("block").to_pylist(), b.column("lists"), strict=True):
            held = None
            for one in lists:
                x = np.cumsum(one["gaps"].values.to_numpy(), dtype=np.int32)
                held = x if held is None else held[np.isin(held, x, assume_unique=True)]
                if not len(held):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), block)), pa.array(held)], names=["block", "ord"])


def matching(spark: SparkSession, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Live documents that may match, without block and ord: only the files of blocks with a candidate are read."""
    few = candidates(spark, path, pattern)
    if few is None:
        return live(spark, path).drop("block", "ord")
    blocks = [r["block"] for r in few.select("block").distinct().limit(NAMED_BLOCKS + 1).collect()]
    docs = live(spark, path, blocks if len(blocks) <= NAMED_BLOCKS else None)
    small = few.count() <= SMALL
    return docs.join(F.broadcast(few) if small else few, ["block", "ord"], "left_semi").drop("block", "ord")


def search(spark: SparkSession, path: str, pattern: str, text: str = "text", field: str = "body", limit: int | None = None) -> DataFrame:
    """uid, field, line, column, matched: what regex_search finds in all lines of all documents.

    A match is looked for within a line, so a pattern's trigrams are those of one line.
    """
    reads.check_pattern(pattern)
    return reads.regex_search(reads.lines(matching(spark, path, pattern, text), "uid", field, text), pattern, limit)

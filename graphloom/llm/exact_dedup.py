"""Exact dedup by an extendible-hash index on shared files; DataFrame operations only.

Texts are equal when they are identical after every run of ASCII white space became one space. A null
text counts as empty. A text's 64-bit hash is its key.

1. The rows are numbered in one scan and written with key, size and SHA-256 to the shared folder; all later
   passes read that table, so a number never depends on how a later scan is split.
2. The directory starts with one bucket for all keys. A bucket with more than `capacity` keys or
   `capacity_bytes` of text is split by the next bit of the key, and the directory doubles when the bucket's
   local depth was the global one. What is overfull at `max_depth`, or holds a single key, gets overflow pages.
   The loads come from a histogram of leading key bits; it has at most 2**max_depth rows, and so has the
   directory, which is written to the shared folder.
3. Rows are routed through the directory to the owner of their page: whole texts, each once. A key that many
   rows or many bytes share is summed up before it is sent (HOT_KEYS at most, the heaviest; any other key has
   at most a HOT_KEYS-th of all bytes), so a group of a third of all rows sends one row per task.
4. An owner task has a range of pages. It compares the whole normalised bytes of a key's rows, and chains the
   distinct texts of a key (collisions) as positions 0, 1, ... The pages are written to the shared folder.
5. Every row probes: key to slot, slot to page, key and position in the chain by SHA-256.

Null doc_ids sort last; rows that repeat a doc_id and text are told apart by their place in the input. Exactly
one row of a group is kept. Very long texts are rows as any others: one that is larger than a page has a page to
itself. An empty table gives an empty result. Columns other than the id and the text pass by untouched, whatever
their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import written

CAPACITY = 1 << 18
CAPACITY_BYTES = 32 << 20
MAX_DEPTH = 20
#: A key with more rows than this, or with an eighth of a page's bytes in several rows, is summed up before it is routed.
HOT_ROWS = 4096
HOT_KEYS = 1 << 16
#: Owner tasks at most; each has a range of pages.
OWNERS = 1 << 16
#: A row's place in its group's order: id (null last), then place in the input.
_TAG = "cast(cast(coalesce(_id, 9223372036854775807) as decimal(38,0)) * 10000000000000000000BD + _row as decimal(38,0))"


def normalised(text: Column) -> Column:
    """Runs of white space as one space; a lone space is left alone, which spares most of the work."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _described(rows: DataFrame, key) -> DataFrame:
    """_key, _sha and _bytes for _norm."""
    return rows.withColumns({"_key": key(F.col("_norm")).cast("long"), "_sha": F.unhex(F.sha2("_norm", 256)), "_bytes": F.octet_length("_norm").cast("long")})


def _tagged(docs: DataFrame, id_col: str, text_col: str, key) -> DataFrame:
    """_id, _tag, _norm, _key, _sha, _bytes of every row, stored."""
    rows = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), normalised(F.col(text_col)).alias("_norm"))
    return written(_described(rows.select("_id", F.expr(_TAG).alias("_tag"), "_norm"), key), "dedup-rows")


def slot(key: Column, depth: int) -> Column:
    """The first depth bits of the key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def split(loads: list[tuple[int, int, int]], bits: int, capacity: int, capacity_bytes: int) -> tuple[list[tuple[int, int, int, int]], bool]:
    """Buckets (prefix, local depth, keys, bytes) after splitting, and whether none is left that more bits could split.

    loads: (slot of so many bits, keys, bytes). Starts with one bucket of depth 0; the global depth is the greatest
    local one.
    """
    loads = sorted(loads)
    slots, keys, size = [x[0] for x in loads], [0], [0]
    for _, n, b in loads:
        keys.append(keys[-1] + n)
        size.append(size[-1] + b)

    def load(prefix: int, depth: int) -> tuple[int, int]:
        a, z = (bisect_left(slots, p << (bits - depth)) for p in (prefix, prefix + 1))
        return keys[z] - keys[a], size[z] - size[a]

    done, settled, waiting = [], True, [(0, 0)]
    while waiting:
        prefix, depth = waiting.pop()
        n, b = load(prefix, depth)
        overfull = n > 1 and (n > capacity or b > capacity_bytes)
        if overfull and depth < bits:
            waiting += [(2 * prefix, depth + 1), (2 * prefix + 1, depth + 1)]
        else:
            settled &= not overfull
            done.append((prefix, depth, n, b))
    return sorted(done, key=lambda x: x[0] << (bits - x[1])), settled


def _loads(rows: DataFrame, capacity_bytes: int) -> DataFrame:
    """_key, n, load (bytes that will be routed), hot; one row per key, stored."""
    keys = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes"))
    hot = (F.col("n") > HOT_ROWS) | (F.col("n") > 1) & (F.col("bytes") > capacity_bytes // 8)
    return written(keys.select("_key", "n", "bytes", hot.alias("hot"), F.when(hot, F.expr("bytes div n")).otherwise(F.col("bytes")).alias("load")), "dedup-keys")


def directory(keys: DataFrame, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int, int]:
    """(slot, bucket, depth, pages, page) for every slot of the doubled directory, its global depth and the number of pages.

    page: the number of the bucket's first page; pages are numbered in the order of the keys.
    """
    spark = keys.sparkSession
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("b")).first()
    full = max(total.n / capacity, (total.b or 0) / capacity_bytes, 1)
    bits = min(max_depth, math.ceil(math.log2(full)) + 3)
    while True:
        loads = [(r.slot, r.n, r.b) for r in keys.groupBy(slot(F.col("_key"), bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("b")).collect()]
        buckets, settled = split(loads, bits, capacity, capacity_bytes)
        if settled or bits >= max_depth:
            break
        bits = min(max_depth, bits + 4)
    depth = max(x[1] for x in buckets)
    rows, page = [], 0
    for k, (prefix, local, n, b) in enumerate(buckets):
        pages = max(1, math.ceil(n / capacity), math.ceil(b / capacity_bytes)) if n > 1 else 1
        rows.append((k, prefix << (depth - local), (prefix + 1) << (depth - local), local, pages, page))
        page += pages
    table = spark.createDataFrame(rows, "bucket long, first long, behind long, depth int, pages int, page long")
    return written(table.select(F.explode(F.sequence(F.col("first"), F.col("behind") - 1)).alias("slot"), "bucket", "depth", "pages", "page"), "dedup-directory"), depth, page


def routed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """rows (_key) with bucket, depth and page: the key's slot, and an overflow page by another hash of the key."""
    at = rows.withColumn("_slot", slot(F.col("_key"), depth)).join(F.broadcast(slots), F.col("_slot") == F.col("slot"))
    return at.withColumn("page", F.col("page") + F.pmod(F.xxhash64(F.lit("page"), "_key"), F.col("pages"))).drop("_slot", "slot", "pages")


def _index(rows: DataFrame, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame, int]:
    """The pages of the index, stored; the directory; its global depth."""
    keys = _loads(rows, capacity_bytes)
    slots, depth, pages = directory(keys, capacity, capacity_bytes, max_depth)
    hot = keys.where("hot").orderBy(F.desc("bytes"), "_key").limit(HOT_KEYS).select(F.col("_key").alias("_hot"))
    some = rows.select("_id", "_tag", "_norm", "_key", "_sha").join(F.broadcast(hot), F.col("_key") == F.col("_hot"), "left")
    cold = some.where("_hot is null").select("_key", "_sha", "_norm", "_id", "_tag", F.lit(1).cast("long").alias("_n"))
    summed = some.where("_hot is not null").groupBy("_key", "_sha", "_norm").agg(F.min("_id").alias("_id"), F.min("_tag").alias("_tag"), F.count(F.lit(1)).alias("_n"))
    owners = min(pages, OWNERS)
    sent = routed(cold.unionByName(summed), slots, depth).withColumn("_owner", F.floor(F.col("page") * owners / pages).cast("int"))
    owned = sent.repartitionById(owners, "_owner").groupBy("_owner", "bucket", "depth", "page", "_key", "_sha", "_norm")
    chains = owned.agg(F.min("_id").alias("keep_id"), F.min("_tag").alias("keep_tag"), F.sum("_n").alias("group_size"))
    short = chains.select("_owner", "bucket", "depth", "page", F.col("_key").alias("key"), F.col("_sha").alias("sha"), F.octet_length("_norm").alias("n_bytes"), "keep_id", "keep_tag", "group_size")
    placed = short.withColumn("chain_pos", F.row_number().over(W.partitionBy("_owner", "page", "key").orderBy("sha", "n_bytes")) - 1)
    return written(placed.drop("_owner"), "dedup-index"), slots, depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key=F.xxhash64, capacity_bytes: int = CAPACITY_BYTES) -> DataFrame:
    """The index: bucket, depth, page, key, sha, n_bytes, keep_id, keep_tag, group_size, chain_pos."""
    return _index(_tagged(docs, id_col, text_col, key), capacity, capacity_bytes, max_depth)[0]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, max_depth: int = MAX_DEPTH, key=F.xxhash64, capacity_bytes: int = CAPACITY_BYTES) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, bucket, chain_pos."""
    rows = _tagged(docs, id_col, text_col, key)
    index, slots, depth = _index(rows, capacity, capacity_bytes, max_depth)
    asked = routed(rows.select("_id", "_tag", "_key", "_sha"), slots, depth).select("_id", "_tag", "_key", "_sha", F.col("page").alias("_page"))
    hit = asked.join(index, (F.col("_page") == F.col("page")) & (F.col("_key") == F.col("key")) & (F.col("_sha") == F.col("sha")))
    return hit.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_tag") == F.col("keep_tag")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain_pos",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, whole."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_r"), F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"))
    norm = normalised(F.col(f"_r.`{text_col}`"))
    rows = written(_described(rows.select("_r", "_id", F.expr(_TAG).alias("_tag"), norm.alias("_norm")), F.xxhash64).drop("_norm"), "dedup-rows")
    index, slots, depth = _index(rows.withColumn("_norm", norm))
    kept = index.select(F.col("page").alias("_page"), F.col("key").alias("_of"), "keep_tag")
    asked = routed(rows.select("_r", "_tag", "_key"), slots, depth)
    return asked.join(kept, (F.col("page") == F.col("_page")) & (F.col("_key") == F.col("_of")) & (F.col("_tag") == F.col("keep_tag")), "left_semi").select("_r.*")

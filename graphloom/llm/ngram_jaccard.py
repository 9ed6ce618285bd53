"""Exact self-join of documents on the Jaccard similarity of their word n-gram sets, and its components.

A-Z are lower-cased; words are runs of anything but ASCII white space; a set holds the 64-bit hashes of a
text's distinct n-word shingles (with fewer words, of the whole sequence). Two documents link when
100 * intersection >= percent * union.

Method (set-relation skipping):

* Every set is put into one global order: shingles that are rare first, by hash; shingles known to be
  frequent last. Two sets that link share a shingle among the first n - ceil(t n) + 1 of each (prefix
  filter), so only those are indexed. Frequent shingles are found in two counts over all texts: first of the lowest
  shingles of every set, then, of the sets whose lowest hold a frequent one, of all that the prefix can reach when
  frequent ones give way to others: the more of the lowest are frequent, the further (`reach`). Chunks add up their own counts first. The list is bounded (FREQUENT). Any list gives the same links: it
  decides cost only.
* The index is one row per entry (shingle, document, size, position), dealt and sorted by shingle, so its cost is
  in proportion to the texts. In a list entries are sorted by set size and then by the
  shingle's position; a probe skips blocks of sizes that cannot reach the threshold and, within a size,
  all entries behind the last useful position.
* Of lists that hold the same sets only the one of the first shingle is kept: it allows every pair that the others do.
* Answers are derived from similar sets. Equal sets share one answer. First every entry of a list is
  compared with one pivot of about its size only; sets that this links are answered together, and
  afterwards a list yields only pairs that are not yet connected, so a group of near copies costs its
  length, not its square, and no link between components is lost.
* A pair is refuted without its texts when the parity bitmaps of the two sets differ in more bits than
  linked sets can differ in shingles; the rest are verified on the whole sets.

A list is read as a stream and passed on in blocks of LIST_BLOCK entries; a block begins with the pivots of the one
before it. Blocks are paired after the pivots' answers are known, and only where their entries are not all connected.
The result is components and the links that make them; links inside a component that is connected already are not
computed. Sets are taken for equal when their sizes, 128-bit hashes and bitmaps' hashes are.

Null or empty texts have no set and link with nothing; rows with a null id get a null component. Rows that repeat
an id are compared each with its own text and tied together. A very long text is worked on whole, in one task, with
8 bytes a word and its bitmap of 2^20 bits at most. Columns besides the id and the text are not read, so their names
cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches_of, chunks, components, forget, small_batches, text_bytes, word_hashes, written

NGRAM = 5
PERCENT = 80
#: Shingles put last in the order, at most; at least so many texts hold each.
FREQUENT = 1 << 20
FREQUENT_FROM = 12
#: Groups of equal sets whose representatives every task knows, at most.
HOT_SETS = 1 << 16
LIST_BLOCK = 4096
#: Bytes of text that are worked on at once.
CHUNK = 8 << 20
BLOOM_BITS = 1 << 24
#: Pairs that a task holds before it passes them on.
PAIRS = 1 << 17
#: Index entries of one task, and tasks at most; a task sorts its entries on disk and reads them as a stream.
ENTRIES, MOST_PARTS = 1 << 20, 1 << 16

_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    with np.errstate(over="ignore"):
        width = min(n, len(w))
        h = w[: len(w) - width + 1].copy()
        for k in range(1, width):
            h *= _M
            h += w[k : len(w) - width + 1 + k]
        h += np.uint64(width)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def needed(a, b, percent: int = PERCENT):
    """The least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - (-(-percent * n // 100)) + 1


def sketch_bits(n: int) -> int:
    """A power of two, about the set's size."""
    return 1 << max(8, min(20, (max(n, 1) - 1).bit_length()))


def sketch(s: np.ndarray) -> bytes:
    """Parity bitmap: bit b tells whether an odd number of shingles fall on b."""
    bits = sketch_bits(len(s))
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their bitmaps (folded to one size)."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


# --- pass A: what every text holds


_A = "id long, h long, n int, sig binary, sketch binary"


def _signature(s: np.ndarray, bitmap: bytes) -> bytes:
    """What stands for a set: a hash of its shingles and one of its bitmap."""
    return xxhash.xxh3_128_digest(s.tobytes()) + xxhash.xxh3_64_digest(bitmap)


def _describe(ngram: int):
    """Of every text its size, signature and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            sets = [shingles(x, ngram) for x in text_bytes(t.column("text"))]
            bitmaps = [sketch(s) for s in sets]
            one = lambda name: t.column(name).combine_chunks()  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([one("id"), one("h"), pa.array([len(s) for s in sets], pa.int32()), pa.array([_signature(s, b) for s, b in zip(sets, bitmaps, strict=True)], pa.binary()), pa.array(bitmaps, pa.binary())], names=["id", "h", "n", "sig", "sketch"])

    return run


def _low_part(s: np.ndarray, percent: int) -> np.ndarray:
    """A set's lowest shingles, half as many as its prefix has."""
    return s[: prefix_length(len(s), percent) // 2 + 8]


def reach(n: int, low: int, hits: int, percent: int) -> int:
    """How many of a set's n shingles its prefix may reach over when `hits` of its `low` lowest are frequent and give way; an upper estimate."""
    share = hits / low + 1 / math.sqrt(low)
    return n if share >= 1 else min(n, math.ceil(prefix_length(n, percent) / (1 - share)) + 8)


def _counted(ngram: int, percent: int, shared=None):
    """Of every chunk of texts its shingles and how many of its sets hold each; equal sets of a chunk count once.

    Without shared only the low part of each set is counted; with it (shingles known to be frequent, sorted) those within reach of the
    prefixes of sets whose low part holds one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            held: dict[int, np.ndarray] = {}
            for x in text_bytes(t.column("text")):
                s = shingles(x, ngram)
                low = _low_part(s, percent) if len(s) else s
                if shared is not None:
                    known = shared.value
                    at = np.searchsorted(known, low)
                    hits = int((known[np.minimum(at, len(known) - 1)] == low).sum()) if len(known) else 0
                    low = s[: reach(len(s), len(low), hits, percent)] if hits else s[:0]
                if len(low):
                    held[xxhash.xxh3_64_intdigest(s.tobytes())] = low.copy()
            u, c = np.unique(np.concatenate([np.empty(0, np.uint64), *held.values()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int64))], names=["token", "count"])

    return run


def _most_frequent(rows: DataFrame, counted, least: int) -> np.ndarray:
    """The shingles that most sets hold, `least` at least, sorted; FREQUENT at most."""
    counts = rows.select("text").mapInArrow(counted, "token long, count long").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= least)
    found = np.sort(counts.orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    del counts
    _let_go(rows.sparkSession)
    return found


def _let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished jobs when nothing refers to them any more."""
    spark.sparkContext._jvm.System.gc()


# --- pass B: the index of prefixes


_B = "token long, id long, n int, pos int"


def _index(ngram: int, percent: int, shared):
    """The entries of every set's prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hot = shared.value
        for t in chunks(batches, "text", CHUNK):
            tokens, ids, sizes = [], [], []
            seen = set()
            for i, x in zip(t.column("id").to_pylist(), text_bytes(t.column("text")), strict=True):
                s = shingles(x, ngram)
                if i is None or not len(s):
                    continue
                sig = _signature(s, sketch(s))
                if hot.get(sig, i) != i or sig in seen:
                    continue  # an equal set has the same answer; the edges between equal sets join them
                seen.add(sig)
                p = prefix_length(len(s), percent)
                at = np.searchsorted(last, s)
                frequent = last[np.minimum(at, len(last) - 1)] == s if len(last) else np.zeros(len(s), bool)
                head = s[~frequent][:p]
                if len(head) < p:
                    head = np.concatenate([head, s[frequent][: p - len(head)]])
                tokens.append(head)
                ids.append(i)
                sizes.append(len(s))
            if ids:
                length = np.array([len(x) for x in tokens])
                token = np.concatenate(tokens).view(np.int64)
                place = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.repeat(np.array(ids, np.int64), length)), pa.array(np.repeat(np.array(sizes, np.int32), length)), pa.array(place.astype(np.int32))], names=["token", "id", "n", "pos"])

    return run


_LISTS = "list long, block int, several boolean, ids array<long>, sizes array<int>, places array<int>"


def _leads(entries: list[np.ndarray], percent: int) -> np.ndarray:
    """Of each block of sizes the place of the entry with the smallest id."""
    _, i, n, _ = entries
    block = _size_block(n, percent)
    o = np.lexsort((i, block))
    return o[np.r_[True, block[o][1:] != block[o][:-1]]]


def _lists(list_block: int, percent: int):
    """From entries sorted by shingle, size, position and id: the lists of two entries or more, in blocks."""

    def rows(number: np.ndarray, several: np.ndarray, off: np.ndarray, entries: list[np.ndarray], token: np.ndarray) -> pa.RecordBatch:
        fold = lambda x: pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x))
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(number.astype(np.int32)), pa.array(several), fold(entries[1]), fold(entries[2]), fold(entries[3])], names=[x.split()[0] for x in _LISTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        lead: list[np.ndarray] | None = None  # the pivots of the held list's last block that was passed on
        number = 0  # such blocks

        def block(part: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal lead, number
            whole = part if lead is None else [np.concatenate(x) for x in zip(lead, part, strict=True)]
            out = rows(np.array([number]), np.array([True]), np.array([0, len(whole[0])]), whole, whole[0][:1])
            at = _leads(whole, percent)
            lead, number = [x[at] for x in whole], number + 1
            return out

        for b in _then(batches, None):
            if b is not None:
                new = [b.column(k).to_numpy() for k in range(4)]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if held is None or not len(held[0]):
                continue
            t = held[0]
            last = len(t) if b is None else int(np.searchsorted(t, t[-1]))  # where the list begins that may go on
            cuts = np.r_[0, np.flatnonzero(t[1:last] != t[: last - 1]) + 1, last] if last else np.array([0])
            size = np.diff(cuts)
            long = size > list_block
            if number and len(size):
                long[0] = True
            plain = np.flatnonzero((size > 1) & ~long)
            if len(plain):
                at = np.concatenate([np.arange(cuts[k], cuts[k + 1]) for k in plain])
                yield rows(np.zeros(len(plain)), np.zeros(len(plain), bool), np.r_[0, np.cumsum(size[plain])], [x[at] for x in held], t[cuts[plain]])
            for k in np.flatnonzero(long):
                for at in range(cuts[k], cuts[k + 1], list_block):
                    yield block([x[at : min(at + list_block, cuts[k + 1])] for x in held])
                lead, number = None, 0
            held = [x[last:] for x in held]
            while len(held[0]) > 2 * list_block:
                yield block([x[:list_block] for x in held])
                held = [x[list_block:] for x in held]

    return run


def _first_lists(lists: DataFrame) -> DataFrame:
    """Of the lists that hold the same sets the one whose shingle is first in the order; all blocks of long lists.

    The order is one for all sets, so in each of them that shingle stands before those of the other lists: sizes are the same, places
    are lower, and every pair that another list allows is allowed there.
    """
    own = [F.when(F.col("several"), F.col(c)).alias(f"_{c}") for c in ("list", "block")]
    kept = lists.groupBy(F.xxhash64("ids").alias("_key"), "ids", *own).agg(F.min_by(F.struct("list", "block", "several", "sizes", "places"), F.element_at("places", 1)).alias("x"))
    return kept.select("x.list", "x.block", "x.several", "ids", "x.sizes", "x.places")


def _then(batches: Iterator, end) -> Iterator:
    yield from batches
    yield end


def _size_block(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(n) / math.log(100 / percent)).astype(np.int64) if percent < 100 else n


def pivots(ids: np.ndarray, n: np.ndarray, run_of: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first answers: in each list, every entry with the smallest id of its block of sizes, and those of adjacent blocks.

    Lists of one group of near copies share their smallest ids, so the pairs are few times the documents.
    """
    block = _size_block(n, percent)
    o = np.lexsort((ids, block, run_of))
    i, z, r, k = ids[o], n[o], run_of[o], block[o]
    new = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])] if len(o) else np.empty(0, bool)
    first = np.flatnonzero(new)
    x = np.repeat(first, np.diff(np.r_[first, len(o)]))
    y = np.arange(len(o))
    near = (r[first][1:] == r[first][:-1]) & (k[first][1:] == k[first][:-1] + 1)
    x, y = np.r_[x, first[:-1][near]], np.r_[y, first[1:][near]]
    low, high = np.minimum(z[x], z[y]), np.maximum(z[x], z[y])
    ok = (100 * low >= percent * high) & (i[x] != i[y])
    return np.unique(np.stack([np.minimum(i[x], i[y])[ok], np.maximum(i[x], i[y])[ok]], 1), axis=0)


def _pivots(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off = b.column("ids").offsets.to_numpy()
            part = slice(off[0], off[-1])
            pairs = pivots(b.column("ids").values.to_numpy()[part], b.column("sizes").values.to_numpy()[part].astype(np.int64), np.repeat(np.arange(b.num_rows), np.diff(off)), percent)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def probe(ids: np.ndarray, n: np.ndarray, pos: np.ndarray, group: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs of one list (sorted by size, position) that the sizes and positions allow and no group joins yet."""
    if len(n) <= 12:
        return _probe_short(ids.tolist(), n.tolist(), pos.tolist(), group.tolist(), percent)
    out = []
    sizes, first = np.unique(n, return_index=True)
    ends = np.r_[first[1:], len(n)]
    for i in range(len(n)):
        top = np.searchsorted(sizes, 100 * n[i] // percent, side="right")
        for k in range(np.searchsorted(sizes, n[i]), top):  # blocks of one size; the others are skipped
            lo, hi = max(first[k], i + 1), ends[k]
            if lo >= hi:
                continue
            need = needed(n[i], sizes[k], percent)
            if n[i] - pos[i] < need:
                break
            hi = lo + np.searchsorted(pos[lo:hi], sizes[k] - need, side="right")  # and what lies behind in a block
            j = np.arange(lo, hi)
            j = j[(group[j] != group[i]) & (ids[j] != ids[i])]
            if len(j):
                out.append(np.stack([np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])], 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)


def _probe_short(ids: list, n: list, pos: list, group: list, percent: int) -> np.ndarray:
    """The same for a list too short to have blocks worth skipping."""
    out = []
    for i in range(len(n)):
        for j in range(i + 1, len(n)):
            if 100 * n[i] < percent * n[j]:
                break
            if group[i] != group[j] and min(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j], percent):
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return np.array(out, np.int64) if out else np.empty((0, 2), np.int64)


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.concatenate([*found, np.empty((0, 2), np.int64)]).astype(np.int64)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    if len(p):
        p = p[np.r_[True, (p[1:] != p[:-1]).any(1)]]
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])


def _unlinked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            lists = b.column("entries")
            off, field = lists.offsets.to_numpy(), lists.values
            col = [field.field(k).to_numpy() for k in ("n", "pos", "id", "group")]
            for x, y in zip(off, off[1:], strict=False):
                n, pos, ids, group = (c[x:y].astype(np.int64) for c in col)
                o = np.lexsort((ids, pos, n))
                found.append(probe(ids[o], n[o], pos[o], group[o], percent))
                held += len(found[-1])
                if held > PAIRS:
                    yield _pairs(found)
                    found, held = [], 0
            yield _pairs(found)

    return run


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column("na").to_numpy().astype(np.int64), b.column("nb").to_numpy().astype(np.int64)
            most = na + nb - 2 * needed(na, nb, percent)
            ok = [least_difference(x, y) <= m for x, y, m in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), most.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok, pa.bool_())), b.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return run


def _linked(ngram: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept: dict[int, np.ndarray] = {}
            ok = []
            for a, c, x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), text_bytes(b.column("ta")), text_bytes(b.column("tb")), strict=True):
                if len(kept) > 256:
                    kept.clear()
                for k, v in ((a, x), (c, y)):
                    if k not in kept:
                        kept[k] = shingles(v, ngram)
                both = len(np.intersect1d(kept[a], kept[c], assume_unique=True))
                ok.append(100 * both >= percent * (len(kept[a]) + len(kept[c]) - both) and both > 0)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])

    return run


def _texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that pairs name, and few others: a Bloom filter of BLOOM_BITS bits at most goes to every task."""
    words = BLOOM_BITS // 64
    place = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    bits = named.select(place.alias("p")).groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    assert words <= 1 << 18
    held = texts.withColumn("p", place).withColumn("word", F.floor(F.col("p") / 64)).join(F.broadcast(bits), "word")
    return held.where(F.expr("getbit(bits, cast(p % 64 as int)) = 1")).select("id", "text")


def _verified(pairs: DataFrame, about: DataFrame, texts: DataFrame, ngram: int, percent: int, name: str) -> DataFrame:
    """The pairs that link."""
    side = lambda s: about.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_possible(percent), "a long, b long"), f"{name}-likely")
    few = _texts_of(texts, likely)
    text = lambda s: few.select(F.col("id").alias(s), F.col("text").alias(f"t{s}"))
    return written(likely.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").sortWithinPartitions("a", "b").mapInArrow(_linked(ngram, percent), "a long, b long"), f"{name}-links")


def _few(df: DataFrame, most: int) -> DataFrame:
    """df, to be sent to every task if it has no more rows than that."""
    return F.broadcast(df) if df.count() <= most else df


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, list_block: int = LIST_BLOCK, frequent_from: int = FREQUENT_FROM) -> tuple[DataFrame, DataFrame]:
    """(every, edges): id, node and n of every row; edges (a, b) between nodes that link or hold equal sets, enough to give the components.

    A node is an id, or, for rows that share an id and not the text, a hash of both.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    every = written(rows.select("id", "h", "text").mapInArrow(_describe(ngram), _A), "jaccard-sets")
    some = _most_frequent(rows, _counted(ngram, percent), frequent_from)
    frequent = _most_frequent(rows, _counted(ngram, percent, spark.sparkContext.broadcast(some)), frequent_from)
    # ids that are on several rows; torn where the texts differ
    again = written(every.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("c"), (F.min("h") != F.max("h")).alias("torn")).where("c > 1"), "jaccard-repeated")
    torn = again.where("torn").select("id", F.lit(True).alias("torn"))
    if not torn.isEmpty():
        every = every.join(_few(torn, HOT_SETS), "id", "left")
        rows = rows.join(_few(torn, HOT_SETS), "id", "left")
    else:
        every, rows = every.withColumn("torn", F.lit(None).cast("boolean")), rows.withColumn("torn", F.lit(None).cast("boolean"))
    node = F.when(F.col("torn"), F.col("h")).otherwise(F.col("id")).alias("node")
    every = every.select("id", node, "n", "sig", "sketch")
    texts = rows.where("id is not null").select(node.alias("id"), "text")
    nodes = every.where("n > 0 and id is not null").select(F.col("node").alias("id"), "n", "sig", "sketch")
    if not again.isEmpty():
        nodes = nodes.dropDuplicates(["id"])
        texts = written(texts.dropDuplicates(["id"]), "jaccard-texts")
    about = written(nodes, "jaccard-nodes")

    sets = written(about.groupBy("sig", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1"), "jaccard-equal")
    hot = sets.where("c > 8").orderBy(F.desc("c"), "sig").limit(HOT_SETS)
    known = {bytes(r.sig): r.rep for r in hot.select("sig", "rep").collect()}
    shared = spark.sparkContext.broadcast((frequent, known))
    # sets with many copies are told to every task, the others meet by a join
    to_hot = about.select("id", "sig", "n").join(F.broadcast(hot.select("sig", "n", F.col("rep").alias("hot"))), ["sig", "n"], "left")
    cold = to_hot.where("hot is null").join(sets.select("sig", "n", "rep"), ["sig", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    equal = written(to_hot.where("hot is not null").select(F.col("id").alias("a"), F.col("hot").alias("b")).unionByName(cold).where("a <> b"), "jaccard-copies")

    total = about.agg(F.sum(F.expr(f"n - ceil(n * {percent} / 100) + 1"))).first()[0] or 0
    entries = texts.mapInArrow(_index(ngram, percent, shared), _B)
    parts = min(MOST_PARTS, max(8, math.ceil(total / ENTRIES)))
    entries = written(entries, "jaccard-entries")
    with batches_of(spark, 1 << 16):
        lists = written(_first_lists(entries.repartition(parts, "token").sortWithinPartitions("token", "n", "pos", "id").mapInArrow(_lists(list_block, percent), _LISTS)), "jaccard-lists")
    forget(entries)
    _let_go(spark)
    pairs = written(lists.select("ids", "sizes").mapInArrow(_pivots(percent), "a long, b long").distinct(), "jaccard-pivots")
    first = _verified(pairs, about, texts, ngram, percent, "jaccard-near")
    group = components(first.unionByName(equal))

    placed = lists.select("list", "block", "several", F.explode(F.arrays_zip("ids", "sizes", "places")).alias("e")).select("list", "block", "several", F.col("e.ids").alias("id"), F.col("e.sizes").alias("n"), F.col("e.places").alias("pos"))
    labelled = placed.join(group, F.col("id") == F.col("node"), "left").select("list", "block", "several", "id", "n", "pos", F.coalesce("component", "id").alias("group"))
    blocks = written(labelled.groupBy("list", "block", "several").agg(F.collect_list(F.struct("id", "n", "pos", "group")).alias("entries"), F.min("group").alias("g0"), F.max("group").alias("g1")).where("several or g0 <> g1"), "jaccard-blocks")
    forget(lists)
    x, y = (blocks.where("several").select("list", F.col("block").alias(f"b{k}"), F.col("entries").alias(f"e{k}"), F.col("g0").alias(f"l{k}"), F.col("g1").alias(f"m{k}")) for k in (1, 2))
    across = x.join(y, "list").where("b1 < b2 and (l1 <> m1 or l2 <> m2 or l1 <> l2)").select(F.concat("e1", "e2").alias("entries"))
    left = blocks.where("g0 <> g1").select("entries").unionByName(across).mapInArrow(_unlinked(percent), "a long, b long").distinct()
    rest = _verified(left.join(pairs, ["a", "b"], "left_anti"), about, texts, ngram, percent, "jaccard-rest")
    same = every.where("id is not null and node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))
    edges = first.unionByName(rest).unionByName(group.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(same)
    return every.select("id", "node", "n"), written(edges, "jaccard-all")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT, list_block: int = LIST_BLOCK, frequent_from: int = FREQUENT_FROM) -> DataFrame:
    """id, n_shingles, component_id for every row."""
    every, edges = jaccard_links(docs, id_col, text_col, ngram, percent, list_block, frequent_from)
    group = components(edges)
    found = every.select("id", "n", F.col("node").alias("_node")).join(group, F.col("_node") == F.col("node"), "left")
    # nodes that are not ids have no say in a component's name
    torn = every.where("node <> id").select(F.col("node").alias("component"), F.col("id").alias("_own"))
    if not torn.isEmpty():
        names = found.where("id is not null").groupBy("component").agg(F.min("id").alias("name"))
        found = found.join(names, "component", "left").withColumn("component", F.when(F.col("component").isNotNull(), F.col("name")))
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays: that with the smallest id. Rows with a null id stay."""
    group = jaccard_components(docs, id_col, text_col).where(f"component_id <> {id_col}").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(group, F.col(id_col) == F.col("_gone"), "left_anti")

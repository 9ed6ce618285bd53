"""Alignment of two tokenizers over a corpus: minimal groups of tokens, links, and how often ids are linked.

A text is encoded by a byte-level tokenizer (A, on a space and the text) and by a sentencepiece model (B, which adds the
space). Where both spell the same bytes, tokens of A and B whose byte ranges overlap are linked. Links are edges of a
bipartite graph; union-find over it, for all texts of a chunk at once, gives connected components, which are exactly the
smallest groups of tokens that cover the same bytes. The members of a component expand its links.

Pairs of ids are counted over the corpus in two steps: each chunk of texts adds up its own pairs, then pairs of all chunks are
added up by key, so a frequent pair is one row for each chunk. Every pair's count and whether it is the highest of its B id go
back to the chunks that hold the pair, and from there to their documents. No table of pairs is broadcast or collected.
A chunk is CHUNK characters of text, or one text, so what is gathered by chunk is bounded by it.

Texts that are null, empty, or not spelt alike by both have no tokens: zeros and an empty digest. Special tokens' strings
inside texts are plain text. Very long texts are encoded whole (some fifty times their room). Repeated rows and ids are texts of their own; null ids stay. An
empty table gives no rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.byte_level import ByteLevel
from graphloom.llm.common import chunks, small_batches, written

CHUNK = 1 << 20
#: Stretches of text whose A ids a worker keeps.
KEPT = 1 << 19
#: Characters encoded by one call.
AT_ONCE = 1 << 18
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others for 256 and on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """A vocabulary's bytes by id, and its ids in decimal with each separator that may follow."""

    def __init__(self, spelt: list[bytes]):
        self.bytes = spelt
        self.length = np.array([len(x) for x in spelt] or [0], np.int64)
        self.shown = np.array([[str(k) + sep for sep in (",", "|", ";", "")] for k in range(len(spelt))], object)

    def spells(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Pair:
    """Both tokenizers, made once in a worker."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a = ByteLevel(a.decode(), literal=True, kept=KEPT)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        of = byte_alphabet()
        entries = self.a.library.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(entries.values(), default=-1) + 1)
        for piece, k in entries.items():
            spelt[k] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
        self.left = Side(spelt)
        # with a token for every byte and no change of the text before, a byte-level tokenizer spells every text
        self.exact = self.a.by_stretch and {bytes([x]) for x in range(256)} <= set(spelt)
        n = self.b.get_piece_size()
        self.right = Side([bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace(MARK, " ").encode() for k in range(n)])

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Both sides' ids of each text; empty where the text is, or where they do not spell it."""
        none = np.zeros(0, np.int32)
        for x, a, b in zip(texts, self.a.ids([" " + x for x in texts]), self._pieces(texts), strict=True):
            want = b" " + x.encode()
            if x and (self.exact or self.left.spells(a.tolist()) == want) and self.right.spells(b) == want:
                yield a.astype(np.int32), np.array(b, np.int32)
            else:
                yield none, none

    def _pieces(self, texts: list[str]) -> Iterator[list[int]]:
        for part in parts(texts, AT_ONCE):
            yield from self.b.encode(part, num_threads=1)


def parts(texts: list[str], most: int) -> Iterator[list[str]]:
    """Runs of texts of `most` characters at the most, or one text."""
    held: list[str] = []
    n = 0
    for x in texts:
        if held and n + len(x) > most:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x)
    if held:
        yield held


_READY: dict[int, Pair] = {}


def _ready(a: bytes, b: bytes) -> Pair:
    key = hash((a, b))
    if key not in _READY:
        _READY[key] = Pair(a, b)
    return _READY[key]


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the A and B tokens that overlap: a link for each stretch between neighbouring ends of either side."""
    size = int(a_ends[-1]) + 1 if len(a_ends) else 0
    in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
    in_a[a_ends], in_b[b_ends] = True, True
    ends = np.flatnonzero(in_a | in_b)
    in_a, in_b = in_a[ends], in_b[ends]
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b


def components(n_a: int, n_b: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over A tokens 0 .. n_a - 1 and B tokens n_a .. n_a + n_b - 1: every node's root, the least of its set.

    All edges at once: the greater root of an edge is hung below the lesser, paths are halved until they end at roots, and
    only edges whose ends differ go on.
    """
    root = np.arange(n_a + n_b)
    b = b + n_a
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        split = root[a] != root[b]
        a, b = a[split], b[split]
    return root


class Aligned:
    """The groups and links of a chunk of texts, laid one after another."""

    def __init__(self, pair: Pair, encoded: list[tuple[np.ndarray, np.ndarray]]):
        texts = range(len(encoded))
        held_a, held_b = [a for a, _ in encoded], [b for _, b in encoded]
        self.n_a, self.n_b = (np.array([len(x) for x in held], np.int64) for held in (held_a, held_b))
        none = [np.zeros(0, np.int32)]
        self.a, self.b = np.concatenate(held_a or none), np.concatenate(held_b or none)
        a_ends, b_ends = np.cumsum(pair.left.length[self.a]), np.cumsum(pair.right.length[self.b])
        self.link_a, self.link_b = links(a_ends, b_ends)
        n = len(self.a)
        root = components(n, len(self.b), self.link_a, self.link_b)
        first = root[:n] == np.arange(n)  # a group's root is its first A token, so groups are in the order of bytes
        group = (np.cumsum(first) - 1)[root]
        self.group_a, self.group_b, self.groups = group[:n], group[n:], int(first.sum())
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        doc_of_group = np.zeros(self.groups, np.int64)
        doc_of_group[self.group_a] = self.doc_a
        self.n_groups = np.bincount(doc_of_group, minlength=len(texts))
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=len(texts))
        self.pair = pair

    def shown(self) -> list[str]:
        """Each text's groups, `a1,a2|b1;a3|b2,b3`."""
        a_in, b_in = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        before_a, before_b = np.cumsum(a_in) - a_in, np.cumsum(b_in) - b_in
        at_a = np.arange(len(self.a)) + before_b[self.group_a]
        at_b = np.arange(len(self.b)) + (before_a + a_in)[self.group_b]
        last_a = np.diff(self.group_a, append=-1) != 0
        last_b = np.diff(self.group_b, append=-1) != 0
        sep_b = np.where(last_b, 2, 0)
        sep_b[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        words = np.empty(len(self.a) + len(self.b), object)
        words[at_a] = self.pair.left.shown[self.a, last_a.astype(np.int64)]
        words[at_b] = self.pair.right.shown[self.b, sep_b]
        flat, at = words.tolist(), np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(flat[i:j]) for i, j in zip(at, at[1:], strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of ids (a, b), how many links hold each, and every link's place among them."""
        keys, which, n = np.unique((self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b], return_inverse=True, return_counts=True)
        return (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n, which.astype("<u4")


ROW = "kind string, chunk long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, links binary, a array<int>, b array<int>, n array<long>"


def aligned(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A row for each document (kind `doc`) and for the distinct pairs of each chunk (kind `pairs`), stored once.

    groups: the groups as text, where asked for. links: the place of each link's pair among the chunk's pairs, sorted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = []
    for path in (byte_level_path, piece_path):
        with open(path, "rb") as f:
            files.append(f.read())
    held = spark.sparkContext.broadcast(tuple(files))  # two vocabulary files
    schema = {c.split()[0]: c.split()[1] for c in ROW.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair = _ready(*held.value)
        task = TaskContext.get().partitionId() << 32
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}

        def rows(size: int, **given: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(size, kinds[k])) for c, k in schema.items()], names=list(schema))

        k = 0
        for t in chunks(batches, "text", CHUNK):
            t = t.combine_chunks()
            every = [x or "" for x in t.column("text").to_pylist()]
            encoded = list(pair.encode(every))
            at = 0
            for texts in parts(every, CHUNK):
                end = at + len(texts)
                yield from one(task | k, t.column("id").chunk(0).slice(at, len(texts)), texts, Aligned(pair, encoded[at:end]), rows)
                at = end
                k += 1

    def one(chunk: int, ids: pa.Array, texts: list[str], got: Aligned, rows) -> Iterator[pa.RecordBatch]:
        shown = got.shown()
        digest = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
        shown = shown if with_groups else [None] * len(texts)
        a, b, n, which = got.pairs()
        at = np.concatenate([[0], np.cumsum(got.n_links)])
        packed = [np.sort(which[i:j]).tobytes() for i, j in zip(at, at[1:], strict=False)]
        yield rows(
            len(texts), kind=pa.array(["doc"] * len(texts)), chunk=pa.array(np.full(len(texts), chunk), pa.int64()), id=ids, n_a=pa.array(got.n_a), n_b=pa.array(got.n_b), n_groups=pa.array(got.n_groups, pa.int64()),
            n_links=pa.array(got.n_links, pa.int64()), groups_sha256=pa.array(digest, pa.string()), groups=pa.array(shown, pa.string()), links=pa.array(packed, pa.binary()),
        )
        yield rows(1, kind=pa.array(["pairs"]), chunk=pa.array([chunk], pa.int64()), a=pa.array([a], pa.list_(pa.int32())), b=pa.array([b], pa.list_(pa.int32())), n=pa.array([n], pa.list_(pa.int64())))

    return written(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ROW), "aligned")


def chunk_pairs(stored: DataFrame) -> DataFrame:
    """chunk, place, a, b, n: every chunk's distinct pairs."""
    x = stored.where("kind = 'pairs'").select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "p"))
    return x.select("chunk", "place", "p.a", "p.b", "p.n")


def pair_counts(stored: DataFrame) -> DataFrame:
    """a, b, count (links of the corpus), best (no other A id is linked to this B id more often)."""
    counts = chunk_pairs(stored).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = written(counts, "pair-counts")
    top = counts.groupBy(F.col("b").alias("of")).agg(F.max("count").alias("top"))  # at most a row for each B id
    return counts.join(top, F.col("b") == F.col("of")).select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def alignment(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Per document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups (text) where asked for."""
    stored = aligned(docs, byte_level_path, piece_path, id_col, text_col, with_groups)
    answers = chunk_pairs(stored).select("chunk", "place", "a", "b").join(pair_counts(stored), ["a", "b"]).select(F.col("chunk").alias("of_chunk"), "place", "count", "best")
    documents = stored.where("kind = 'doc'").select("chunk", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else []), "links")

    def judge(docs: pa.Table, found: pa.Table) -> pa.Table:
        size = found.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        place = found.column("place").to_numpy()
        count[place], best[place] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        packed = docs.column("links").to_pylist()
        which = np.frombuffer(b"".join(packed), "<u4")
        at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)])
        sums = [np.concatenate([[0], np.cumsum(x[which])]) for x in (best, count)]
        return docs.drop_columns(["chunk", "links"]).append_column("n_best", pa.array(np.diff(sums[0][at]))).append_column("count_sum", pa.array(np.diff(sums[1][at])))

    schema = "id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, " + ("groups string, " if with_groups else "") + "n_best long, count_sum long"
    out = documents.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(judge, schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))

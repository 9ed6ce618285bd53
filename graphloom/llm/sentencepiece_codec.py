"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces, scores, types, trainer and normaliser settings) and rebuilt:
the normaliser (compiled character map, extra white space, dummy prefix, the marker for spaces), a Unigram
model from the scores or a BPE model whose merges follow from them, byte fallback, and the decoder. As in
the library a text is not split into words first. Batches are encoded by several threads. Parity
with the sentencepiece library is verified while encoding, for every text; a mismatch raises. The model file's bytes are read once on the driver and broadcast.

A very long text is a call of its own, which takes some fifty times its room. The input's columns pass by untouched;
`token_ids` and `decoded_text` take the place of columns so named. Null and empty texts have no tokens and decode to the empty text. Whole texts are encoded. Repeated rows
are encoded separately. Decoding gives back the normalised text, which for a model with the identity
normaliser is the text.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import chunks, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Every text is verified; a caller may ask for every nth one, or none (0).
VERIFY_EVERY = 1
THREADS = 2
CHUNK = 1 << 20
#: Characters encoded by one call.
AT_ONCE = 1 << 18


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; floats and doubles stay as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Model:
    """What the protobuf holds."""

    def __init__(self, data: bytes):
        self.data = data
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer |= dict(fields(value))
            elif number == 3:
                normaliser |= dict(fields(value))
        self.kind = trainer.get(3, 1)  # 1 unigram, 2 BPE
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.collapse = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        if self.kind not in (1, 2) or self.suffix or not self.escape:
            raise ValueError("only unigram and BPE models with a marker before words are supported")

    @property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, _) in enumerate(self.pieces)}

    def merges(self) -> list[tuple[str, str]]:
        """Every way to join two pieces into a third, the best third first."""
        ids = self.ids
        usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
        found = []
        for p, score, kind in self.pieces:
            if kind in (NORMAL, USER):
                found += [(-score, ids[p], ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        return [x[4:] for x in sorted(found)]


def tokenizer(model: Model):
    from tokenizers import Regex, Tokenizer, models, normalizers

    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == 1:
        lowest = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0) - 10
        # a control, unknown or unused piece keeps its number under a name that no text can hold: two noncharacters around it
        name = lambda p, kind: p if kind in (NORMAL, USER, BYTE) else f"\ufdd0{p}\ufdd1"
        t = Tokenizer(models.Unigram([(name(p, kind), s if kind == NORMAL else (0.0 if kind == USER else lowest)) for p, s, kind in model.pieces], unknown, model.byte_fallback))
    else:
        t = Tokenizer(models.BPE(model.ids, model.merges(), unk_token=None if unknown is None else model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.collapse:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    t.decoder = decoder(model)
    return t


def decoder(model: Model, by_piece: bool = False):
    """Markers become spaces in the joined text, which is quicker than by piece; by piece where bytes spell a marker."""
    from tokenizers import decoders

    marker = [decoders.Replace(MARK, " ")]
    joined = [decoders.ByteFallback(), decoders.Fuse()]
    return decoders.Sequence([*(marker + joined if by_piece else joined + marker), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])


_READY: dict[int, tuple] = {}


def _ready(data: bytes) -> tuple:
    """The tokenizer and the reference library's processor, made once in a worker."""
    key = hash(data)
    if key not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece

        model = Model(data)
        _READY[key] = (tokenizer(model), sentencepiece.SentencePieceProcessor(model_proto=data), frozenset(i for i, (_, _, kind) in enumerate(model.pieces) if kind == BYTE), model)
    return _READY[key]


def parts(texts: list[str], most: int = AT_ONCE) -> Iterator[list[str]]:
    """Runs of texts of `most` characters, or one text: an encoding takes many times its text's room."""
    held, n = [], 0
    for x in texts:
        held.append(x)
        n += len(x)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def encode_texts(data: bytes, texts: list[str], verify_every: int = VERIFY_EVERY) -> list[list[int]]:
    t, reference, _, _ = _ready(data)
    ids: list[list[int]] = []
    for part in parts(texts):
        ids += [x.ids for x in t.encode_batch_fast(part, add_special_tokens=False)]
    some = range(0, len(texts), verify_every) if verify_every else ()
    for k, want in zip(some, reference.encode([texts[k] for k in some], num_threads=1), strict=True) if some else ():
        if ids[k] != want:
            raise AssertionError(f"the rebuilt tokenizer differs from sentencepiece on {texts[k][:80]!r}")
    return ids


def decode_ids(data: bytes, ids: list[list[int]]) -> list[str]:
    t, _, _, model = _ready(data)
    control = {i for i, (_, _, kind) in enumerate(model.pieces) if kind == CONTROL}
    last = {i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == "<0x81>"}  # of a marker's three bytes
    ids = [x if control.isdisjoint(x) else [i for i in x if i not in control] for x in ids]
    out = t.decode_batch(ids, skip_special_tokens=False)
    if spelled := [k for k, x in enumerate(ids) if not last.isdisjoint(x)]:
        exact = tokenizer(model)
        exact.decoder = decoder(model, by_piece=True)
        for k, x in zip(spelled, exact.decode_batch([ids[k] for k in spelled], skip_special_tokens=False), strict=True):
            out[k] = x
    return out


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model_path: str = MODEL, text_col: str = "text", verify_every: int = VERIFY_EVERY) -> DataFrame:
    """docs and token_ids (array<int>), which takes the place of a column of that name."""
    docs = docs.drop("token_ids")
    spark = docs.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, text_col, CHUNK):
            t = t.combine_chunks()
            at = 0
            for part in parts([x or "" for x in t.column(text_col).to_pylist()], 4 * AT_ONCE):
                ids = encode_texts(data.value, part, verify_every)
                yield from t.slice(at, len(part)).append_column("token_ids", pa.array(ids, pa.list_(pa.int32()))).to_batches()
                at += len(part)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, model_path: str = MODEL, ids_col: str = "token_ids") -> DataFrame:
    """rows and decoded_text, which takes the place of a column of that name."""
    rows = rows.drop("decoded_text")
    data = rows.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            yield from t.append_column("decoded_text", pa.array(decode_ids(data.value, [x or [] for x in t.column(ids_col).to_pylist()]), pa.string())).to_batches()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded_text", T.StringType())]))


def digests(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", verify_every: int = VERIFY_EVERY) -> DataFrame:
    """id, n_tokens, n_byte_tokens, ids_crc32, round_trip: encodes and decodes every whole text."""
    import zlib

    spark = docs.sparkSession
    small_batches(spark)
    data = spark.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", CHUNK):
            texts = [x or "" for x in t.column("text").to_pylist()]
            held, equal = [], []
            for part in parts(texts, 4 * AT_ONCE):
                ids = encode_texts(data.value, part, verify_every)
                equal += [a == b for a, b in zip(part, decode_ids(data.value, ids), strict=True)]
                held += [np.array(x, "<i4") for x in ids]
            low, high = min(_ready(data.value)[2], default=0), max(_ready(data.value)[2], default=-1)
            yield pa.RecordBatch.from_arrays(
                [
                    t.column("id").combine_chunks(), pa.array([len(x) for x in held], pa.int64()), pa.array([int(((x >= low) & (x <= high)).sum()) for x in held], pa.int64()),
                    pa.array([zlib.crc32(x.tobytes()) for x in held], pa.int64()), pa.array(equal, pa.bool_()),
                ],
                names=["id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean").withColumnRenamed("id", id_col)

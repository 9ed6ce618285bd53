"""Embedding functions: an interface from texts to vectors, run in Arrow batches, and pooling of token vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators import retrieval


@dataclass(frozen=True)
class Embedder:
    """embed: a list of texts to as many vectors of `dimension` finite numbers; it is given at most `batch` texts at once.

    It is sent to the tasks, so it must pickle; what is costly to make (a model) is best made at its first call.
    """

    dimension: int
    embed: Callable[[list[str]], Sequence[Sequence[float]]]
    batch: int = 64

    def checked(self, texts: list[str]) -> np.ndarray:
        """Vectors of texts, batch by batch; ValueError where the function does not keep its promise."""
        out = []
        for k in range(0, len(texts), self.batch):
            part = texts[k : k + self.batch]
            got = self.embed(part)
            if len(got) != len(part):
                raise ValueError(f"{len(part)} texts gave {len(got)} vectors")
            if odd := [len(v) for v in got if len(v) != self.dimension]:
                raise ValueError(f"a vector has {odd[0]} components, not {self.dimension}")
            out.append(np.asarray(got, np.float32).reshape(len(part), self.dimension))
        x = np.concatenate(out) if out else np.zeros((0, self.dimension), np.float32)
        if not np.isfinite(x).all():
            raise ValueError("a vector holds a component that is not finite")
        return x


@dataclass(frozen=True)
class HashedWords:
    """A deterministic embedding without a model: how many of a text's words fall on each component, by a digest."""

    dimension: int

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for word in re.findall(r"[^\x20\x09-\x0D]+", text):
                v[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dimension] += 1.0
            out.append(v)
        return out


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding") -> DataFrame:
    """rows and their texts' vectors (array<float>), which take the place of a column of that name; null texts have none."""
    rows = rows.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            there = [k for k, x in enumerate(texts) if x is not None]
            vectors: list[np.ndarray | None] = [None] * len(texts)
            for k, v in zip(there, embedder.checked([texts[k] for k in there]), strict=True):
                vectors[k] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def search(vectors: DataFrame, embedder: Embedder, query: str, limit: int, where: Column | None = None, kind: str = "cosine") -> DataFrame:
    """uid, score: the nearest of the vectors (uid, embedding) to a text."""
    return retrieval.vector_search(vectors, [float(x) for x in embedder.checked([query])[0]], limit, where, kind)


def pooled(tokens: DataFrame, how: str = "mean", key: str = "uid", normalise: bool = True) -> DataFrame:
    """key, embedding: token vectors (key, pos, embedding, mask) made one for each key.

    how: mean or max over tokens whose mask is 1, cls the first of them, last the last. A key without such tokens has no
    vector. Components are added up in the tasks first, so a key may hold very many tokens.
    """
    seen = tokens.where("mask = 1 and embedding is not null")
    if how in ("cls", "last"):
        pick = F.min_by if how == "cls" else F.max_by
        one = seen.groupBy(key).agg(pick("embedding", "pos").alias("embedding"))
    elif how in ("mean", "max"):
        each = seen.select(key, F.posexplode("embedding").alias("i", "x")).groupBy(key, "i").agg((F.avg if how == "mean" else F.max)(F.col("x").cast("double")).alias("x"))
        one = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
    else:
        raise ValueError(f"no pooling is called {how}")
    if not normalise:
        return one
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return one.withColumn("_n", norm).select(key, F.transform("embedding", lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(F.lit(0.0))).alias("embedding"))

"""The interface of embedding functions, and pooling."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.operators import embedding as EM


def test_vectors_and_batches(spark):
    sizes = []

    def lengths(texts):
        sizes.append(len(texts))
        return [[float(len(x)), 1.0] for x in texts]

    e = EM.Embedder(2, lengths, batch=3)
    assert e.checked(["a", "bb", "ccc", "d"]).tolist() == [[1, 1], [2, 1], [3, 1], [1, 1]] and sizes == [3, 1]
    df = spark.createDataFrame([(1, "ab", 9), (2, None, 9), (3, "", 9)], "uid int, text string, embedding int")
    got = {r.uid: r.embedding for r in EM.embedded(df, EM.Embedder(2, lambda texts: [[float(len(x)), 1.0] for x in texts])).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert EM.embedded(df.where(F.lit(False)), e).count() == 0


@pytest.mark.parametrize(("function", "what"), [(lambda t: [[1.0]] * len(t), "1 components, not 2"), (lambda t: [], "gave 0 vectors"), (lambda t: [[1.0, math.nan]] * len(t), "not finite")])
def test_a_function_that_breaks_its_promise(spark, function, what):
    with pytest.raises(ValueError, match=what):
        EM.Embedder(2, function).checked(["x"])
    with pytest.raises(Exception, match=what):
        EM.embedded(spark.createDataFrame([("x",)], "text string"), EM.Embedder(2, function)).collect()


def test_search_by_text(spark):
    e = EM.Embedder(64, EM.HashedWords(64))
    df = spark.createDataFrame([("a", "red green"), ("b", "red red red"), ("c", "blue"), ("d", None)], "uid string, text string")
    got = EM.search(EM.embedded(df, e), e, "red", 2).collect()
    assert [r.uid for r in got] == ["b", "a"] and abs(got[0].score - 1) < 1e-9


def test_pooling(spark):
    rows = [("k", 0, [9.0, 9.0], 0), ("k", 1, [3.0, 0.0], 1), ("k", 2, [1.0, 4.0], 1), ("none", 0, [1.0, 1.0], 0), ("zero", 0, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "uid string, pos int, embedding array<float>, mask int")
    one = lambda how, n=False: {r.uid: [round(x, 6) for x in r.embedding] for r in EM.pooled(df, how, normalise=n).collect()}
    assert one("mean") == {"k": [2.0, 2.0], "zero": [0.0, 0.0]} and one("max")["k"] == [3.0, 4.0]
    assert one("cls")["k"] == [3.0, 0.0] and one("last")["k"] == [1.0, 4.0]
    assert one("max", True) == {"k": [0.6, 0.8], "zero": [0.0, 0.0]}
    with pytest.raises(ValueError, match="called median"):
        EM.pooled(df, "median")

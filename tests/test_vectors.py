import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import knn, retrieval
from lodestone.types import CollectionConfig, DimensionMismatch, InvalidConfig


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_bit_goldens(spark):
    row = one(spark, V.bit_encode(arr(1, -1, 0.5, -0.5, 0, 1, -1, 1), 8).alias("a"), V.bit_encode(arr(0), 1).alias("b"), V.bit_encode(arr(1, -1, 1), 3).alias("c"))
    assert (row.a.data, row.b.data, row.c.data) == ([0xAD], [0x80], [0xA0])
    assert one(spark, V.bit_decode(V.bit_encode(arr(1, -1, 0.5, -0.5), 4), 4).alias("d")).d == [1, -1, 1, -1]


def test_int8_goldens(spark):
    row = one(spark, V.int8_encode(arr(0, 1)).alias("a"), V.int8_decode(V.int8_encode(arr(5, 5, 5))).alias("b"), V.int8_encode(arr(0.5231, -0.1892, 0.7745)).alias("c"))
    assert row.a.data == [-128, 127] and row.b == [5, 5, 5] and row.c.data == [60, -128, 127]


def test_kernels(spark):
    i = lambda *x: F.array(*(F.lit(v) for v in x))
    row = one(spark, V.cosine(arr(1, 2, 3), arr(4, 5, 6)).alias("a"), V.cosine(arr(0, 0), arr(1, 2)).alias("b"), V.euclidean(arr(0, 0), arr(3, 4)).alias("c"), V.hamming(i(0b10101010), i(0b10101001), 8).alias("d"), V.hamming(i(0xA0), i(0x80), 3).alias("e"))
    assert row.a == pytest.approx(32 / math.sqrt(14 * 77)) and row.b == 0 and row.c == pytest.approx(1 / 6) and row.d == 0.75 and row.e == pytest.approx(2 / 3)


def test_query_codes_match_columns(spark):
    rng = np.random.default_rng(1)
    for q in ("F32", "INT8", "BIT"):
        v = rng.normal(size=11).tolist()
        assert one(spark, V.encode(arr(*v), q, 11)["data"].alias("d")).d == V.encode_query(v, q, 11)


def test_settings():
    for bad in ({"dimensions": 0}, {"dimensions": 4, "quantization": "X"}, {"dimensions": 4, "metric": "hamming"}, {"dimensions": 4, "metric": "x"}):
        with pytest.raises(InvalidConfig):
            CollectionConfig(**bad)
    assert CollectionConfig(4, "BIT").metric == "cosine"
    with pytest.raises(DimensionMismatch):
        V.encode_query([1.0], "F32", 2)
    with pytest.raises(InvalidConfig):
        V.encode_query([float("nan")], "F32", 1)


def test_top_k_edges(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, embedding array<double>")
    config = CollectionConfig(2)
    assert [r.id for r in knn.nearest(df, [1.0, 0.0], config).collect()] == ["a", "b", "c"]
    assert knn.nearest(df, [1.0, 0.0], config, 0).count() == 0
    assert [r.id for r in knn.nearest(df, [1.0, 0.0], config, -1).collect()] == ["a", "b"]
    assert [r.id for r in knn.nearest(df, [1.0, 0.0], config, 1, F.col("id") != "a").collect()] == ["b"]
    plan = knn.nearest(df, [1.0, 0.0], config, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("codec,metric", [("F32", "cosine"), ("F32", "euclidean"), ("INT8", "dot"), ("BIT", "hamming"), ("BIT", "cosine")])
def test_join_matches_single_queries(spark, codec, metric):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=9).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    config = CollectionConfig(9, codec, metric)
    joined = knn.nearest_join(df.where("id < 3").withColumnRenamed("id", "query_id"), df, config, 4).collect()
    for q in range(3):
        one_ = [r.id for r in knn.nearest(df, rows[q][1], config, 4).collect()]
        assert [r.id for r in sorted(joined, key=lambda r: r["rank"]) if r.query_id == q] == one_


@pytest.mark.parametrize("codec,metric", [("F32", "cosine"), ("INT8", "cosine"), ("BIT", "hamming")])
def test_join_memory_is_bounded(codec, metric):
    """A block of 4,096 queries over a batch of 10,000 rows held 41 million scores several times over."""
    rng = np.random.default_rng(5)
    config = CollectionConfig(8, codec, metric)
    x, ids = rng.normal(size=(10_000, 8)), rng.permutation(10_000)
    q = knn._encode_all(x[: knn.QUERY_BLOCK], codec)
    tracemalloc.start()
    best = knn._Best(q, 3, config)
    for part in np.array_split(np.arange(10_000), 3):
        best.add(ids[part], x[part])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    s = knn._scores(q[:50], knn._encode_all(x, codec), metric, 8)
    want = [sorted(zip(-row.round(12), ids, strict=True))[:3] for row in s]
    assert [list(zip(-a.round(12), b, strict=True)) for a, b in zip(best.score[:50], best.id[:50], strict=True)] == want


def test_join_edges(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (4, [1.0])], "id long, embedding array<double>")
    ask = lambda k: [(r.id, r.score) for r in knn.nearest_join(df.where("id = 1").withColumnRenamed("id", "query_id"), df, CollectionConfig(2), k).orderBy("rank").collect()]
    assert ask(0) == [] and ask(1) == [(1, 1.0)] and ask(9) == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert knn.nearest_join(df.where("id > 9").withColumnRenamed("id", "query_id"), df, CollectionConfig(2), 2).count() == 0


def test_join_ties_by_decimals(spark):
    """Scores of 1 and a little less go by id where nine decimals count; the scores themselves stay as they are."""
    df = spark.createDataFrame([(5, [1.0, 0.0]), (2, [1.0, 2e-6]), (1, [1.0, 1e-3]), (7, [1.0, 1e-6])], "id long, embedding array<double>")
    queries = df.where("id = 5").withColumnRenamed("id", "query_id")
    ask = lambda **more: [(r.id, r.score) for r in knn.nearest_join(queries, df, CollectionConfig(2), 2, **more).orderBy("rank").collect()]
    assert [x for x, _ in ask()] == [5, 7]
    found = ask(digits=9)
    assert [x for x, _ in found] == [2, 5] and 0 < 1 - found[0][1] < 1e-11


def test_quality_over_copies(spark, monkeypatch):
    """Copies of a vector in other tiles and query blocks tie to nine decimals, so the least ids are found first."""
    monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 64))
    rows = [(c * 200 + i, v.tolist()) for c in range(6) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = df.where("id % 200 < 20 AND id >= 1000").withColumnRenamed("id", "query_id")
    found = knn.nearest_join(queries, df, CollectionConfig(64), 5, digits=9)
    ranks = retrieval.rank_of_expected(queries.select("query_id", (F.col("query_id") % 200 + 400).alias("expected_id")), found)
    assert tuple(retrieval.retrieval_quality(ranks, (1, 5)).first()) == pytest.approx((0.0, 1.0, 1 / 3))
    assert {tuple(r.ids) for r in found.groupBy("query_id").agg(F.collect_list("id").alias("ids")).select(F.transform(F.array_sort("ids"), lambda x: F.floor(x / 200)).alias("ids")).collect()} == {(0, 1, 2, 3, 4)}

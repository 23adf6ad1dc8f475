import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm.ann_search import nearest


@pytest.mark.parametrize("block", [4096, 50])
def test_recall_and_measure(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24)) + 3 * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]
    x[1000:1400] = x[1000]  # one very common vector
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 50 == 0, block_vectors=block, block_queries=block).toPandas()
    hits = 0
    for q in range(0, 3000, 50):
        own = got[got.query_id == q].sort_values("rank")
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id], rtol=0, atol=1e-12) and q not in set(own.vec_id)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(best) & set(own.vec_id))
        if 1000 <= q < 1400:
            assert own.vec_id.tolist() == best.tolist()
    assert hits >= 0.95 * 600


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (200, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 100, 1.414214), (100, 1, 0, 1.414214), (100, 2, 1, 1.414214), (100, 3, 1, 1.414214)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_recall_where_lists_outnumber_probes(spark):
    """Isotropic vectors, the worst for lists: the probes grow with what the recall needs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 64)).astype(np.float32).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, 20000, 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    print("recall", hits / 2000)
    assert hits >= 0.9 * 2000


@pytest.mark.parametrize("offset", [0.0, 1e7])
def test_recall_of_close_vectors_among_far_ones(spark, offset):
    """Codes fitted to far vectors do not tell close ones apart; far from 0, squares lose digits."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16))
    x[:2000] = x[0] + 1e-3 * rng.normal(size=(2000, 16))
    x = x[rng.permutation(4000)] + offset
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 40 == 0).toPandas()
    hits = 0
    for q in range(0, 4000, 40):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & set(got[got.query_id == q].vec_id))
    print("recall", hits / 1000)
    assert hits >= 0.95 * 1000


def test_a_visited_list_loses_none_of_its_nearest(spark):
    """With one list every query visits all; whatever is missed then, the codes lost."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 96))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest(df, F.col("vec_id") % 40 == 0, lists=1).toPandas()
    for q in range(0, 4000, 40):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(d)[:10].tolist()

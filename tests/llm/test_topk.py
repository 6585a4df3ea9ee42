import numpy as np
import pytest

from chronostrata.llm import topk


def brute(rows, n=5, every=50):
    fine = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in {(i, tuple(v)) for i, v in fine if i % every == 0}:
        ranked = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in fine if j != i)[:n]
        out += [(i, p + 1, j, -x) for p, (x, j) in enumerate(ranked)]
    return sorted(out)


RNG = np.random.default_rng(0)
CASES = {
    "ties": [(i, [1.0, 0.5]) for i in range(200)] + [(50, None), (51, [None, 1.0]), (52, [float("nan"), 1.0]), (53, [float("inf")]), (None, [1.0, 2.0])],
    "few": [(0, [1.0]), (50, [-1.0]), (3, [2.0])],
    "one": [(0, [1.0])],
    "ragged": [(i, RNG.normal(size=i % 4).tolist()) for i in range(150)],
    "repeated": [(i % 60, [float(i % 60 % 3)]) for i in range(180)],
    "random": [(i, RNG.normal(size=16).tolist()) for i in range(300)],
}


@pytest.mark.parametrize("name", CASES)
def test_equals_brute_force(spark, name):
    df = spark.createDataFrame(CASES[name], "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, topk.top_k(df.filter("vec_id % 50 = 0"), df).collect())) == brute(CASES[name])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(df, df).count() == 0


def test_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 2)
    df = spark.createDataFrame(CASES["random"], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df.filter("vec_id % 50 = 0"), df).collect())) == brute(CASES["random"])


def test_scores_beyond_doubles_are_exact():
    q, c = np.array([[2.0**30, 3.0]]), np.array([[2.0**25 + 1, 5.0]])
    assert topk.products(q, c)[0, 0] == 2**30 * (2**25 + 1) + 15
    assert topk.products(q * 2**20, c * 2**20)[0, 0] == topk.MOST


def test_further_columns_are_left_alone(spark):
    df = spark.createDataFrame(CASES["ties"], "vec_id long, embedding array<double>").repartition(3)
    from pyspark.sql import functions as F

    for name in ("score", "rank", "query_id", "bin", "chunk", "n", "low", "high", "key"):
        df = df.withColumn(name, F.lit("clash"))
    assert sorted(tuple(r)[:4] for r in topk.top_k(df.filter("vec_id % 50 = 0"), df).select("query_id", "rank", "vec_id", "score").collect()) == brute(CASES["ties"])

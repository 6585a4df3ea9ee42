import random

import pytest
from pyspark.sql import functions as F

from chronostrata.operators import intervals, prefix, store


def rows():
    random.seed(6)
    return [(k, i, random.randrange(-5, 20)) for k in (None, 0, 1, 2) for i in sorted(random.sample(range(400), 60))]


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_and_previous_across_ranges(spark, width, inclusive):
    df = spark.createDataFrame(rows(), "k long, i long, x long").repartition(5)
    ranges = [F.floor(F.col("i") / width)]
    got = prefix.running(df, ["k"], ["i"], F.col("x"), ranges, "s", inclusive)
    got = prefix.previous(got, ["k"], ["i"], F.col("x"), ranges, "p").collect()
    want, sums, last = [], {}, {}
    for k, i, x in rows():
        before = sums.get(k, 0)
        sums[k] = before + x
        want.append((k, i, x, sums[k] if inclusive else before, last.get(k)))
        last[k] = x
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_global_order(spark):
    df = spark.createDataFrame([(k % 3, k, 10) for k in range(500)], "used long, id long, size long").repartition(4)
    got = store.reclaimed(df, 1000, F.lit(False), "used", "id", "size", width=50).collect()
    assert sorted((r["used"], r["id"]) for r in got) == sorted((k % 3, k) for k in range(500))[:100]


@pytest.mark.parametrize("width", [3, 64, 1 << 16])
def test_islands_across_ranges(spark, width):
    random.seed(8)
    spans, want = [], []
    for k in range(4):
        at, packed = 0, 0
        for _ in range(30):
            at += random.randrange(1, 9)
            begin = at
            for _ in range(random.randrange(1, 6)):
                n = random.randrange(1, 7)
                spans.append((k, at, n))
                at += n
            want.append((k, begin, at - begin, packed))
            packed += at - begin
    df = spark.createDataFrame(spans, "k long, s long, n long").repartition(3)
    assert sorted(map(tuple, intervals.coalesce_islands(df, "k", "s", "n", width).collect())) == want

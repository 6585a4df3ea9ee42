"""Packed doubles and the index made of them."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronostrata.functions import scalars as sc
from chronostrata.plans import catalogue
from oracle import rows_of_spark, rows_of_sql

SMALL = "/root/testdata/sf0.001"
NUMBERS = [[0, 1, 2, 3], None, [], [None, 5, None], [2**53, 2**53 - 1, 7], list(range(9)), [None], [1 << 40], [3] * 5]


@pytest.mark.parametrize("most", [0, 4, 100])
def test_packed_doubles(spark, most):
    df = spark.createDataFrame(list(enumerate(NUMBERS)), "i int, x array<bigint>").repartition(2)
    got = {r["i"]: r["p"] and bytes(r["p"]) for r in df.select("i", sc.packed_doubles(F.col("x"), most).alias("p")).collect()}
    want = lambda x: None if x is None or len(x) > most else b"".join(struct.pack("<d", v) for v in x if v is not None)
    assert {i: x if x is None else bytes(x) for i, x in got.items()} == {i: want(x) for i, x in enumerate(NUMBERS)}


def test_packing_of_copies_and_missing_values(spark, tmp_path):
    rows = [(o, n, p, s, q) for o in (1, 2, None) for n in (1, 2, 3) for p, s, q in ((5, 6, 7.0), (5, 6, 7.0), (4, 9, 50.0), (4, 8, None), (5, 6, 1.0))] * 3
    frame = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).astype({"l_orderkey": "Int64", "l_linenumber": "int32"})
    frame.to_parquet(tmp_path / "lineitem.parquet")
    name = "f15_interval_packing"
    assert rows_of_spark(catalogue.QUERIES[name](spark, str(tmp_path))) == rows_of_sql(catalogue.ORACLES[name], SMALL, {"lineitem": frame})


def test_packing_shuffles_once_and_packs_whole_batches(spark):
    plan = catalogue.QUERIES["f15_interval_packing"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "ArrowEvalPython" in plan

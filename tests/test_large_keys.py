"""Queries whose rows are made from a key, on keys beyond those of the given tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronostrata.functions import scalars as sc
from chronostrata.plans import catalogue
from oracle import rows_of_spark, rows_of_sql

SMALL = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, **tables):
    for table, frame in tables.items():
        frame.to_parquet(f"{folder}/{table}.parquet")
    assert rows_of_spark(catalogue.QUERIES[name](spark, str(folder))) == rows_of_sql(catalogue.ORACLES[name], SMALL, tables)


def events(*starts):
    return pd.DataFrame({"event_id": [a + k for a in starts for k in range(8)]})


def test_stream_info_of_36_bit_sample_counts(spark, tmp_path):
    same_as_sql(spark, tmp_path, "s15_stream_info", events=events(4_294_962, 36_000_000, 68_719_469))


def test_range_responses_beyond_ten_million_bytes(spark, tmp_path):
    same_as_sql(spark, tmp_path, "s6_range_responses", events=events(99_992, 100_000, 36_000_000))


@pytest.mark.parametrize("total, problem", [(200, None), (201, None), (199, "range"), (0, "range")])
def test_range_total(spark, total, problem):
    df = spark.range(1).select(sc.range_problem(F.lit(206), F.lit(None), F.lit(f"bytes 100-199/{total}"), F.lit(100), F.lit(200), F.lit(100)))
    assert df.first()[0] == problem

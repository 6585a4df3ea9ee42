"""Prefix sums and neighbours in an order, without a task that holds all rows of a key.

The order of a key is cut into ranges: ``ranges`` are columns that do not fall along it, so that a range
holds a bounded number of rows. Rows are sorted within their range; a range starts from the sums of those
before it, which are one row a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ranged(rows: DataFrame, keys: Sequence[str], ranges: Sequence[Column]) -> tuple[DataFrame, list[str], W]:
    names = [f"_range{i}" for i in range(len(ranges))]
    over = W.partitionBy(*keys).orderBy(*names)
    return rows.withColumns(dict(zip(names, ranges))), names, over


def with_base(rows: DataFrame, base: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of their range; null keys meet as well."""
    there = base.select(*(F.col(c).alias(f"_of_{c}") for c in on), *(c for c in base.columns if c not in on))
    met = F.lit(True)
    for c in on:
        met = met & rows[c].eqNullSafe(there[f"_of_{c}"])
    return rows.join(there, met).drop(*(f"_of_{c}" for c in on))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], amount: Column, ranges: Sequence[Column], out: str, inclusive: bool = False) -> DataFrame:
    """rows with ``out``: the sum of ``amount`` over the rows of the same keys before each (and it, if inclusive)."""
    rows, names, over = _ranged(rows, keys, ranges)
    on = [*keys, *names]
    sums = rows.groupBy(*on).agg(F.sum(amount).alias("_sum"))
    base = sums.select(*on, F.coalesce(F.sum("_sum").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    own = F.sum(amount).over(W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    done = with_base(rows.withColumn("_own", F.coalesce(own, F.lit(0))), base, on)
    return done.withColumn(out, (F.col("_base") + F.col("_own")).cast("bigint")).drop("_base", "_own", *names)


def previous(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, ranges: Sequence[Column], out: str) -> DataFrame:
    """rows with ``out``: ``value`` of the row of the same keys before each; null for the first."""
    rows, names, over = _ranged(rows, keys, ranges)
    on = [*keys, *names]
    last = rows.groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    base = last.select(*on, F.lag("_last").over(over).alias("_carried"))
    own = W.partitionBy(*on).orderBy(*order)
    done = with_base(rows.withColumns({"_value": F.lag(value).over(own), "_first": F.row_number().over(own) == 1}), base, on)
    return done.withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_value"))).drop("_value", "_first", "_carried", *names)

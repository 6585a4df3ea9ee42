"""Cross-checks between declarations: joins that keep what disagrees, identity dedupe, set equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer join with a status for each key: ok, missing_left, missing_right or mismatch."""
    a = left.select(key, F.lit(True).alias("_l"), *(F.col(f).alias(f"l_{f}") for f in fields))
    b = right.select(key, F.lit(True).alias("_r"), *(F.col(f).alias(f"r_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))
    status = F.when(F.col("_l").isNull(), "missing_left").when(F.col("_r").isNull(), "missing_right").when(same, "ok").otherwise("mismatch")
    return a.join(b, key, "full_outer").withColumn("status", status).drop("_l", "_r")


def first_mismatch(joined: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The first field, in the order given, in which the two sides differ; one row a differing key."""
    name = F.lit(None).cast("string")
    for f in reversed(fields):
        name = F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)).otherwise(name)
    return joined.select(key, name.alias("field")).filter("field is not null")


def unique_by_identity(rows: DataFrame, identity: str, position: str, shape: Sequence[str]) -> DataFrame:
    """One row an identity: its first position, how many rows share it, and whether their shapes conflict."""
    return rows.groupBy(identity).agg(F.min(position).alias("first_position"), F.count("*").alias("rows"), (F.countDistinct(F.struct(*shape)) > 1).alias("conflict"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("times")).filter("times > 1")


def two_way_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, counted as often as they are missing; none: equal sets."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def unreferenced_and_missing(sources: DataFrame, assets: DataFrame, key: str) -> DataFrame:
    """Sources without an asset and assets without a source."""
    return sources.select(key).distinct().join(assets, key, "left_anti").select(key, F.lit("missing").alias("problem")).union(assets.select(key).distinct().join(sources, key, "left_anti").select(key, F.lit("unreferenced").alias("problem")))


def with_pin(pins: Column, pin: Column) -> Column:
    """Pins with one more, in place; the same array where it is there already."""
    return F.when(F.array_contains(pins, pin), pins).otherwise(F.concat(pins, F.array(pin)))


def without_pin(pins: Column, pin: Column) -> Column:
    return F.filter(pins, lambda p: p != pin)

"""Counters over event logs: sweep lines, running peaks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronostrata.operators.prefix import running


#: Steps of an order (whole numbers) that are sorted together.
RANGE = 1 << 16


def residency(deltas: DataFrame, key: str, order: str, delta: Column, width: int = RANGE) -> DataFrame:
    """For each key the final and the greatest running total of signed changes, and their number. ``order``
    is a whole number, different for each change of a key."""
    rows = running(deltas.select(key, order, delta.alias("_d")), [key], [order], F.col("_d"), [F.floor(F.col(order) / width)], "_t", inclusive=True)
    return rows.groupBy(key).agg(F.max_by("_t", order).cast("bigint").alias("final"), F.max("_t").cast("bigint").alias("peak"), F.count("*").alias("changes"))


def stage_counters(stages: DataFrame, key: str, start: str, end: str, width: int = RANGE) -> DataFrame:
    """Runs, their summed length and how many ran at once: an end frees its slot before a start at its time."""
    edges = stages.select(key, F.col(start).alias("at"), F.lit(1).alias("d")).union(stages.select(key, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = edges.groupBy(key, "at", "d").agg(F.sum("d").alias("by"))
    peaks = running(steps, [key], ["at", "d"], F.col("by"), [F.floor(F.col("at") / width)], "_a", inclusive=True).groupBy(key).agg(F.max("_a").cast("bigint").alias("peak"))
    sums = stages.groupBy(key).agg(F.count("*").alias("runs"), F.sum(F.col(end) - F.col(start)).cast("bigint").alias("length"))
    return sums.join(peaks, key)


def within_budget(rows: DataFrame, key: str, order: str, charge: Column, budget: int, width: int = RANGE) -> DataFrame:
    """Rows with their running charge and whether it is still within the budget; ``order`` is a whole number."""
    out = running(rows.withColumn("_charge", charge), [key], [order], F.col("_charge"), [F.floor(F.col(order) / width)], "charged", inclusive=True)
    return out.drop("_charge").withColumn("funded", F.col("charged") <= budget)

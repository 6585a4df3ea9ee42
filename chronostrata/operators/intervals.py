"""Interval algebra over integer timelines: coalescing, complement, tiling, overlap, seek, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.operators.prefix import with_base

SAFE = 9007199254740991  # the largest whole number that admitted records may hold


def before(*order: str, key: str) -> W:
    return W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def tiles(total: Column, width: Column | int) -> Column:
    """Starts of the tiles of ``width`` over [0, total): empty where total is 0 (sequence alone is not)."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.when(total > 0, F.sequence(F.lit(0).cast("bigint"), (total - 1).cast("bigint"), width.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


#: Units of a timeline that are sorted together: spans do not overlap, so a range holds at most so many.
RANGE = 1 << 16


def coalesce_islands(spans: DataFrame, key: str, start: str, length: str, width: int = RANGE) -> DataFrame:
    """Merge touching spans of each key; packed_offset is the exclusive prefix sum of merged lengths.

    Spans of a key must not overlap. Returns key, start, frames, packed_offset. A key's timeline is cut into
    ranges of ``width`` units, so that no task sorts a whole key.
    """
    rows = spans.select(key, F.col(start).alias("s"), F.col(length).alias("n")).withColumn("_range", F.floor(F.col("s") / width))
    own = W.partitionBy(key, "_range").orderBy("s")
    end = F.col("s") + F.col("n")
    # Whether the first span of a range begins an island, the ranges tell below.
    rows = rows.withColumn("_fresh", F.coalesce((F.lag(end).over(own) != F.col("s")).cast("int"), F.lit(0)))
    rows = rows.withColumn("_island", F.sum("_fresh").over(own.rowsBetween(W.unboundedPreceding, 0))).withColumn("_packed", F.coalesce(F.sum("n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranges = rows.groupBy(key, "_range").agg(F.min("s").alias("first"), F.max(end).alias("last"), F.sum("_fresh").alias("fresh"), F.sum("n").alias("total"))
    over = W.partitionBy(key).orderBy("_range")
    past = over.rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_begins", F.when(F.lag("last").over(over) == F.col("first"), 0).otherwise(1))
    islands = F.sum("_begins").over(over.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("fresh").over(past), F.lit(0))
    base = ranges.select(key, "_range", islands.alias("_islands"), F.coalesce(F.sum("total").over(past), F.lit(0)).alias("_before"))
    merged = with_base(rows, base, [key, "_range"]).groupBy(key, (F.col("_islands") + F.col("_island")).alias("_i")).agg(F.min("s").alias("start"), F.sum("n").alias("frames"), F.min(F.col("_before") + F.col("_packed")).cast("bigint").alias("packed_offset"))
    return merged.select(key, "start", "frames", "packed_offset")


def pcm_index(intervals: DataFrame, key: str, frame_bytes: Column) -> DataFrame:
    """Intervals as byte runs of a packed payload: byte_offset and the totals of each key."""
    rows = intervals.withColumn("fb", frame_bytes)
    totals = intervals.groupBy(F.col(key).alias("_k")).agg(F.sum("frames").alias("_total"))
    rows = rows.join(totals, rows[key].eqNullSafe(totals["_k"]))
    return rows.select(key, F.col("start").alias("start_frame"), "frames", (F.col("packed_offset") * F.col("fb")).cast("bigint").alias("byte_offset"), (F.col("_total") * F.col("fb")).cast("bigint").alias("active_bytes"))


def gaps(intervals: DataFrame, key: str, keys: DataFrame, horizon: int) -> DataFrame:
    """The complement of the intervals within [0, horizon): leading, inner and trailing gaps, all-silent
    keys included."""
    w = W.partitionBy(key).orderBy("start")
    inner = intervals.select(key, F.coalesce(F.lag(F.col("start") + F.col("frames")).over(w), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end"))
    ends = intervals.groupBy(key).agg(F.max(F.col("start") + F.col("frames")).alias("last"))
    tail = keys.join(ends, key, "left").select(key, F.coalesce("last", F.lit(0)).alias("gap_start"), F.lit(horizon).alias("gap_end"))
    return inner.union(tail).filter("gap_end > gap_start").select(key, F.col("gap_start").cast("bigint").alias("gap_start"), (F.col("gap_end") - F.col("gap_start")).cast("bigint").alias("gap_frames"))


def tiled(rows: DataFrame, total: str, width: Column | int, at: str = "tile_start", size: str = "tile_size") -> DataFrame:
    """One row for each tile of ``width`` over [0, total); the last may be shorter."""
    w = F.lit(width) if isinstance(width, int) else width
    out = rows.withColumn("_w", w).withColumn(at, F.explode(tiles(F.col(total), F.col("_w"))))
    return out.withColumn(size, F.least(F.col("_w").cast("bigint"), F.col(total) - F.col(at))).drop("_w")


def window_frames(capacity: int, quantum: int) -> int:
    """The largest multiple of the quantum within the capacity."""
    return max(quantum, capacity // quantum * quantum)


def overlaps(windows: DataFrame, intervals: DataFrame, key: str, bin_width: int) -> DataFrame:
    """Windows (w_start, w_end) with the stretches of intervals inside them.

    Both sides are cut along bins of ``bin_width`` and joined on (key, bin): an equi join, however long
    the timelines are. A pair is reported in the bin where its overlap begins, so exactly once.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_width), F.floor((b - 1) / bin_width)))
    w = windows.filter("w_end > w_start").withColumn("bin", bins(F.col("w_start"), F.col("w_end")))
    i = intervals.filter("frames > 0").select(F.col(key).alias("_k"), F.col("start").alias("i_start"), (F.col("start") + F.col("frames")).alias("i_end"), "packed_offset").withColumn("_bin", bins(F.col("i_start"), F.col("i_end")))
    met = w.join(i, (w[key] == i["_k"]) & (w["bin"] == i["_bin"]) & (w["w_start"] < i["i_end"]) & (w["w_end"] > i["i_start"]))
    a, b = F.greatest("w_start", "i_start"), F.least("w_end", "i_end")
    return met.filter(F.floor(a / bin_width) == F.col("bin")).select(key, "w_start", "w_end", a.cast("bigint").alias("from_frame"), (b - a).cast("bigint").alias("frames"), (F.col("packed_offset") + a - F.col("i_start")).cast("bigint").alias("packed_frame"))


def seek(targets: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """For each target frame the first interval that ends after it (null: silence to the end)."""
    ends = intervals.select(key, (F.col("start") + F.col("frames") - 1).alias("at"), F.struct("start", "frames").alias("hit"), F.lit(None).cast("bigint").alias("target"))
    asked = targets.select(key, F.col("target").alias("at"), F.lit(None).cast("struct<start:bigint,frames:bigint>").alias("hit"), "target")
    w = W.partitionBy(key).orderBy(F.desc("at"), F.asc_nulls_first("target")).rowsBetween(W.unboundedPreceding, 0)
    found = ends.unionByName(asked).withColumn("next", F.last("hit", ignorenulls=True).over(w)).filter("target is not null")
    return found.select(key, "target", F.col("next.start").alias("start"), F.col("next.frames").alias("frames"))


def invalid_intervals(intervals: DataFrame, key: str, pos: str, total: int, adjacent_allowed: bool) -> DataFrame:
    """The first broken rule of each key's interval list, by position; nothing for sound lists.

    Rules: range (starts and lengths are safe and inside the timeline), order (no overlap; touching
    intervals only where allowed), offset (packed offsets are the exclusive prefix sums).
    """
    w = W.partitionBy(key).orderBy(pos)
    end = F.lag(F.col("start") + F.col("frames")).over(w)
    packed = F.coalesce(F.sum("frames").over(before(pos, key=key)), F.lit(0))
    order = (F.col("start") < end) if adjacent_allowed else (F.col("start") <= end)
    rule = F.when((F.col("start") < 0) | (F.col("frames") < 1) | (F.col("start") > SAFE) | (F.col("start") + F.col("frames") > total), "range").when(order, "order").when(F.col("packed_offset") != packed, "offset")
    return intervals.withColumn("rule", rule).filter("rule is not null").groupBy(key).agg(F.min(F.struct(pos, "rule")).alias("first")).select(key, F.col(f"first.{pos}").alias("pos"), F.col("first.rule").alias("rule"))


def expected_counts(intervals: DataFrame, key: str, total: int, frame_bytes: Column, read: int, zero: int) -> DataFrame:
    """read_calls, zero_updates, hash_updates of verifying each key: tiles of its intervals and gaps."""
    w = W.partitionBy(key).orderBy("start")
    up = lambda x, n: F.floor((x + (n - 1)) / n)
    rows = intervals.withColumn("fb", frame_bytes).withColumn("gap", (F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("frames")).over(w), F.lit(0))) * F.col("fb"))
    sums = rows.groupBy(key).agg(F.sum(up(F.col("frames") * F.col("fb"), read)).alias("read_calls"), F.sum(up(F.col("gap"), zero)).alias("inner"), F.max(F.col("start") + F.col("frames")).alias("end"), F.first("fb").alias("fb"))
    zeros = (F.col("inner") + up((F.lit(total) - F.col("end")) * F.col("fb"), zero)).cast("bigint")
    return sums.select(key, F.col("read_calls").cast("bigint").alias("read_calls"), zeros.alias("zero_updates"), (F.col("read_calls") + zeros).cast("bigint").alias("hash_updates"))

"""Playback: windows, render quanta, the order of fair passes, blocks mapped to spans, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.operators import intervals as iv

# Frames of a window, passes of a tick, windows read at once, bytes of a decoded block and of a span.
WINDOW_FRAMES, PASSES_A_TICK, READS = 8192, 8, 4
MOST_BLOCK_BYTES, MOST_SPAN_BYTES = 384 << 10, 128 << 10


def read_bounds(sources: DataFrame, frame_bytes: Column, window: int = WINDOW_FRAMES) -> DataFrame:
    """window_bytes (two windows a source) and scratch_bytes (the largest READS windows) of a pump."""
    sizes = sources.select((F.lit(window).cast("bigint") * frame_bytes).alias("size"))
    largest = sizes.orderBy(F.desc("size")).limit(READS).agg(F.sum("size").alias("scratch_bytes"))
    return sizes.agg(F.sum(F.col("size") * 2).alias("window_bytes")).crossJoin(F.broadcast(largest))  # one row each


def commits(sources: DataFrame, source: str, frames: str, cursor: str, quantum: int, generation: Column) -> DataFrame:
    """What a pump commits to the rings when nothing blocks: each source's quanta from its cursor on, as
    (generation, start_frame, frames, end_of_region), with the pass that writes each, the tick it falls in,
    and its turn in the pass: passes begin one source further each time. ``pos`` numbers sources from 0."""
    count = sources.agg(F.count("*").alias("_count"))
    left = sources.withColumn("_left", F.greatest(F.lit(0), F.col(frames) - F.col(cursor)).cast("bigint"))
    rows = iv.tiled(left, "_left", quantum, "_at", "_size").crossJoin(F.broadcast(count))  # one row
    turn = F.floor(F.col("_at") / quantum)
    return rows.select(
        source,
        turn.alias("pass"),
        F.floor(turn / PASSES_A_TICK).alias("tick"),
        F.pmod(F.col("pos") - turn, F.col("_count")).alias("turn"),
        generation.alias("generation"),
        (F.col(cursor) + F.col("_at")).cast("bigint").alias("start_frame"),
        F.col("_size").cast("bigint").alias("frames"),
        (F.col("_at") + F.col("_size") == F.col("_left")).alias("end_of_region"),
    )


def window_at(frames: Column, cursor: Column, window: int = WINDOW_FRAMES, quantum: int = 128) -> Column:
    """start and frames of the window that a source reads next: whole quanta, or its tail."""
    size = F.least(F.lit(iv.window_frames(window, quantum)).cast("bigint"), frames - cursor)
    return F.struct(cursor.cast("bigint").alias("start"), F.greatest(F.lit(0).cast("bigint"), size).cast("bigint").alias("frames"))


def valid_reads(reads: DataFrame, seeks: DataFrame, key: str, begun: str, ended: str, at: str) -> DataFrame:
    """reads (read_id, key, begun, ended) with ``generation`` (seeks until they began) and ``kept``: no seek came until they ended.

    Both are counts of seeks up to a time: one running count over the edges of each key, no range join."""
    edges = seeks.select(key, F.col(at).alias("_t"), F.lit(1).alias("_n"), F.lit(None).cast("struct<id:bigint,last:boolean>").alias("_r"))
    ids = reads.select(key, "read_id", F.col(begun).alias("_a"), F.col(ended).alias("_b"))
    point = lambda c, last: ids.select(key, F.col(c).alias("_t"), F.lit(0).alias("_n"), F.struct(F.col("read_id").cast("bigint").alias("id"), F.lit(last).alias("last")).alias("_r"))
    w = W.partitionBy(key).orderBy("_t").rangeBetween(W.unboundedPreceding, W.currentRow)
    counted = edges.unionByName(point("_a", False)).unionByName(point("_b", True)).withColumn("_seen", F.sum("_n").over(w)).filter("_r is not null")
    both = counted.groupBy(F.col("_r.id").alias("read_id")).agg(F.max(F.when(~F.col("_r.last"), F.col("_seen"))).alias("generation"), F.max(F.when(F.col("_r.last"), F.col("_seen"))).alias("_after"))
    return reads.join(both, "read_id").withColumn("kept", F.col("generation") == F.col("_after")).drop("_after")


def gated(runways: DataFrame, session: str, ready: str) -> DataFrame:
    """A session is ready once every source of it has its runway."""
    return runways.groupBy(session).agg(F.bool_and(ready).alias("ready"), F.sum(F.when(F.col(ready), 0).otherwise(1)).alias("waiting"))


def chunk_coverage(blocks: DataFrame, chunks: DataFrame, keys: list[str], frame_bytes: int) -> DataFrame:
    """chunks (keys, frames) with ``status`` of the decoder's blocks (keys, bytes): covered; shape for a block
    that is empty, not of whole frames or over 384 KiB; short, long or missing."""
    bad = (F.col("bytes") < 1) | (F.col("bytes") % frame_bytes != 0) | (F.col("bytes") > MOST_BLOCK_BYTES)
    sums = blocks.groupBy(*keys).agg(F.sum("bytes").alias("_bytes"), F.bool_or(bad).alias("_bad"))
    actual = F.col("_bytes") / frame_bytes
    status = F.when(F.col("_bytes").isNull(), "missing").when(F.col("_bad"), "shape").when(actual < F.col("frames"), "short").when(actual > F.col("frames"), "long").otherwise("covered")
    return chunks.join(sums, keys, "left").withColumn("status", status).drop("_bytes", "_bad")


def mapped_spans(blocks: DataFrame, intervals: DataFrame, key: str, order: str, bin_width: int, most_frames: int) -> DataFrame:
    """Decoded blocks (key, order, frames), packed one behind another, cut at the intervals (key, start,
    frames, packed_offset) whose packed frames they hold and at ``most_frames``: (key, start_frame, frames,
    packed_frame) on the timeline. An equi join on bins of the packed axis."""
    before = F.coalesce(F.sum("frames").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    windows = blocks.withColumn("w_start", before).withColumn("w_end", F.col("w_start") + F.col("frames")).select(key, "w_start", "w_end")
    packed = intervals.select(key, F.col("packed_offset").alias("start"), "frames", F.col("start").alias("packed_offset"))
    met = iv.overlaps(windows, packed, key, bin_width).select(key, F.col("packed_frame").alias("_start"), F.col("frames").alias("_frames"), F.col("from_frame").alias("_packed"))
    cut = iv.tiled(met, "_frames", most_frames, "_at", "_size")
    return cut.select(key, (F.col("_start") + F.col("_at")).cast("bigint").alias("start_frame"), F.col("_size").cast("bigint").alias("frames"), (F.col("_packed") + F.col("_at")).cast("bigint").alias("packed_frame"))


def stalled(pulls: DataFrame, key: str, order: str, at: str, deadline: int) -> DataFrame:
    """The pulls of a stream up to its first that took longer than the deadline, which is refused."""
    w = W.partitionBy(key).orderBy(order)
    late = F.coalesce(F.col(at) - F.lag(at).over(w) > deadline, F.lit(False))
    seen = pulls.withColumn("_late", late).withColumn("_count", F.sum(F.col("_late").cast("int")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return seen.filter((F.col("_count") == 0) | ((F.col("_count") == 1) & F.col("_late"))).withColumn("status", F.when(F.col("_late"), "stem.read_deadline").otherwise("delivered")).drop("_late", "_count")

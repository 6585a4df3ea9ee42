"""Ingest into a store: bytes are proven before a row makes them visible."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronostrata.functions.digests import BATCH, Blake3, blake3_hex, finished, ordered_digests

# The names of published objects, and the bounds of sparse objects.
FINAL_PREFIX = "blake3-"
MOST_INTERVALS, MOST_SPAN_BYTES, MOST_MARKER_BYTES = 65_536, 128 << 10, 8 << 20
ATTEMPTS = 8


def dense_ingest(pieces: DataFrame, declared: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """declared (key, identity, bytes) with ``status``: stored, overrun, truncated, mismatch or unresolved,
    and ``observed_bytes``. Pieces go through a running digest in order; only stored objects may be published."""
    seen = ordered_digests(pieces, key, order, data, "blake3").select(key, F.col("digest").alias("_digest"), F.col("bytes").alias("observed_bytes"))
    status = (
        F.when(F.col("observed_bytes").isNull(), "unresolved")
        .when(F.col("observed_bytes") > F.col("bytes"), "overrun")
        .when(F.col("observed_bytes") < F.col("bytes"), "truncated")
        .when(F.concat(F.lit("blake3:"), "_digest") != F.col("identity"), "mismatch")
        .otherwise("stored")
    )
    return declared.join(seen, key, "left").withColumn("status", status).drop("_digest")


def index_rows(ingested: DataFrame, now: Column) -> DataFrame:
    """The index rows of what was stored: identity, bytes, pins (none yet), last_used. One row an identity."""
    return ingested.filter("status = 'stored'").groupBy("identity").agg(F.max("bytes").alias("bytes")).select("identity", "bytes", F.array().cast("array<string>").alias("pins"), now.alias("last_used"))


def rebuilt_index(finals: DataFrame, name: str, data: str, live: DataFrame | None) -> DataFrame:
    """What happens to each file of a store whose index is lost: foreign (not named as an object), live
    (locked: left alone), kept (its bytes have its name: an index row), removed, or, where locks are not
    known, refused. ``live``: the locked names."""
    sound = F.col(name).rlike(rf"\A{FINAL_PREFIX}[0-9a-f]{{64}}\z")
    rows = finals
    if live is not None:
        rows = rows.join(live.select(F.col(name), F.lit(True).alias("_live")).distinct(), name, "left")
    else:
        rows = rows.withColumn("_live", F.lit(None).cast("boolean"))
    checked = F.when(sound & F.col("_live").isNull(), F.col(data))
    rows = rows.withColumn("_digest", blake3_hex(checked))
    action = (
        F.when(~sound, "foreign")
        .when(F.col("_live"), "live")
        .when(F.concat(F.lit(FINAL_PREFIX), "_digest") == F.col(name), "kept")
        .otherwise("removed" if live is not None else "refused")
    )
    return rows.withColumn("action", action).withColumn("bytes", F.octet_length(data).cast("bigint")).drop("_live", "_digest")


def sparse_ingest(spans: DataFrame, expected: DataFrame, key: str, order: str) -> DataFrame:
    """For each expected object (key, frames, frame_bytes, identity): status, intervals, active_bytes and
    the packed index as an array of (start, frames, byte_offset).

    Spans (key, ``order``, start, bytes) go through in order. Each must start at or after the end of the one
    before, hold whole frames, 128 KiB at most, and end inside the timeline; touching spans are one interval.
    The digest runs over the timeline with silence in its gaps. status: committed, or the first rule broken
    (length, alignment, order, outside, intervals), or mismatch. A marker is written for committed objects
    only, after their data; readers join it.
    """
    declared = expected.select(key, F.lit(None).cast("bigint").alias("_order"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("binary").alias("bytes"), "frames", "frame_bytes", "identity")
    rows = spans.select(key, F.col(order).cast("bigint").alias("_order"), "start", "bytes", F.lit(None).cast("bigint").alias("frames"), F.lit(None).cast("bigint").alias("frame_bytes"), F.lit(None).cast("string").alias("identity"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        at, o, done, held = none, None, [], 0
        for frame in frames:
            for k, start, data, total, width, identity in zip(frame[key], frame["start"], frame["bytes"], frame["frames"], frame["frame_bytes"], frame["identity"]):
                if identity is not None:
                    if at is not none:
                        o.ended()
                        done.append(o)
                        held += len(o.digest.rest)
                    at, o = k, _Sparse(k, int(total), int(width), identity)
                elif at is not none and k == at:
                    o.span(int(start), bytes(data) if data is not None else b"")
            if held > BATCH or len(done) > 10_000:
                yield pd.DataFrame(_rows(done), columns=columns)
                done, held = [], 0
        if at is not none:
            o.ended()
            yield pd.DataFrame(_rows([*done, o]), columns=columns)

    columns = [key, "status", "intervals", "active_bytes", "index"]
    kind = dict(expected.dtypes)[key]
    both = declared.unionByName(rows).repartition(key).sortWithinPartitions(key, F.asc_nulls_first("_order"))
    return both.mapInPandas(run, f"{key} {kind}, status string, intervals long, active_bytes long, index array<struct<start:bigint,frames:bigint,byte_offset:bigint>>")


class _Sparse:
    """The state of one object while its spans go through: the digest, the end, the intervals."""

    def __init__(self, key, frames: int, width: int, identity: str):
        self.key, self.frames, self.width, self.identity = key, frames, width, identity
        self.digest, self.end, self.active, self.problem = Blake3(), 0, 0, None
        self.index: list[list[int]] = []

    def span(self, start: int, data: bytes) -> None:
        if self.problem:
            return
        n = len(data) // self.width
        joins = bool(self.index) and self.index[-1][0] + self.index[-1][1] == start
        if not 1 <= len(data) <= MOST_SPAN_BYTES:
            self.problem = "length"
        elif len(data) % self.width:
            self.problem = "alignment"
        elif start < self.end:
            self.problem = "order"
        elif start + n > self.frames:
            self.problem = "outside"
        elif not joins and len(self.index) >= MOST_INTERVALS:
            self.problem = "intervals"
        else:
            self.digest.zeros((start - self.end) * self.width)
            self.digest.update(data)
            if joins:
                self.index[-1][1] += n
            else:
                self.index.append([start, n, self.active])
            self.active, self.end = self.active + len(data), start + n

    def ended(self) -> None:
        if not self.problem:
            self.digest.zeros((self.frames - self.end) * self.width)


def _rows(objects: list[_Sparse]) -> list[tuple]:
    out = []
    for o, digest in zip(objects, finished([o.digest for o in objects])):
        problem = o.problem or (None if "blake3:" + digest == o.identity else "mismatch")
        index = [{"start": a, "frames": n, "byte_offset": b} for a, n, b in o.index]
        out.append((o.key, problem or "committed", len(o.index), o.active, None if problem else index))
    return out


def unpublished(wanted: DataFrame, existing: DataFrame, key: str, stem: Column, attempts: int = ATTEMPTS) -> DataFrame:
    """wanted with ``generation``: the first of ``attempts`` candidate names that no published object has;
    null: all collide, a conflict. ``stem`` gives the candidates' common part."""
    tries = wanted.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1)))).withColumn("_name", F.concat_ws("-", stem, F.col("_try").cast("string")))
    free = tries.join(existing.select(F.col("name").alias("_name")).distinct(), "_name", "left_anti").groupBy(key).agg(F.min_by("_name", "_try").alias("generation"))
    return wanted.join(free, key, "left")


def lease_reads(reads: DataFrame, pins: DataFrame, closed: DataFrame, lease: str, identity: str) -> DataFrame:
    """reads with ``verdict``: session.closed for a lease that is closed, stem.not_found for an object that
    it does not hold, else granted."""
    held = pins.select(lease, identity, F.lit(True).alias("_held")).distinct()
    shut = closed.select(lease, F.lit(True).alias("_closed")).distinct()
    verdict = F.when(F.col("_closed"), "session.closed").when(F.col("_held").isNull(), "stem.not_found").otherwise("granted")
    return reads.join(shut, lease, "left").join(held, [lease, identity], "left").withColumn("verdict", verdict).drop("_held", "_closed")


def first_failure(steps: DataFrame, key: str, position: str, error: str) -> DataFrame:
    """Cleanup in the reverse of the order of registration: all steps run, the first error met is kept."""
    return steps.groupBy(key).agg(F.count("*").alias("ran"), F.max_by(error, F.when(F.col(error).isNotNull(), F.col(position))).alias("error"))


def aggregated_causes(causes: DataFrame, key: str, position: str, code: str) -> DataFrame:
    """One error for each operation: the code of the first cause, how many causes it stands for, and whether
    it wraps several. Causes are counted, not collected."""
    return causes.groupBy(key).agg(F.min_by(code, position).alias("code"), F.count("*").alias("causes"), (F.count("*") > 1).alias("wraps"))

"""A store of verified objects: reclaim under a quota, index changes, commit rows, scheduling order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronostrata.operators.control import replayed
from chronostrata.operators.prefix import running


def reclaimed(entries: DataFrame, need: int, pinned: Column, last_used: str, identity: str, size: str, width: int = 1 << 16) -> DataFrame:
    """The unpinned entries to evict, least recently used first, until ``need`` bytes are free. A time that
    many entries share is cut along their identities, which are whole numbers."""
    free = entries.filter(~pinned)
    ranges = [F.col(last_used), F.floor(F.col(identity) / width)]
    return running(free, [], [last_used, identity], F.col(size), ranges, "freed_before").filter(F.col("freed_before") < need)


def committed(payloads: DataFrame, commits: DataFrame, key: str, generation: str) -> DataFrame:
    """Payload rows that a commit row makes visible; all others are unfinished or superseded."""
    return payloads.join(commits.select(key, generation), [key, generation], "left_semi")


def merged_index(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The index after a change: rows of ``new`` replace or join those of ``old``; action tells which."""
    a = old.select(key, F.lit(1).alias("_o"), *(F.col(f).alias(f"o_{f}") for f in fields))
    b = new.select(key, F.lit(1).alias("_n"), *(F.col(f).alias(f"n_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"o_{f}").eqNullSafe(F.col(f"n_{f}"))
    action = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull() | same, "kept").otherwise("changed")
    picked = [F.when(F.col("_n").isNull(), F.col(f"o_{f}")).otherwise(F.col(f"n_{f}")).alias(f) for f in fields]
    return a.join(b, key, "full_outer").select(key, *picked, action.alias("action"))


def demoted(entries: DataFrame, corrupt: DataFrame, key: str, pins: Column) -> DataFrame:
    """Entries after corrupt ones are demoted: gone without pins, kept as metadata with them."""
    bad = corrupt.select(key, F.lit(True).alias("_bad"))
    return entries.join(bad, key, "left").filter(F.col("_bad").isNull() | (pins > 0)).withColumn("verified", F.col("_bad").isNull()).drop("_bad")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: later opens supersede earlier ones."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("_r")).select(key, "_r.*")


def in_turn(states: DataFrame, round_robin: int) -> DataFrame:
    """states with ``turn``: their place in a round-robin pass over all of them. ``pos`` numbers them without gaps."""
    count = states.agg(F.count("*").alias("_count"))
    return states.crossJoin(F.broadcast(count)).withColumn("turn", F.pmod(F.col("pos") - round_robin, F.col("_count"))).drop("_count")


def read_order(states: DataFrame, round_robin: int, slots: int) -> DataFrame:
    """The next sources to read: without a window first, then the emptiest, ties in turn."""
    return in_turn(states, round_robin).orderBy("has_window", "occupancy", "turn").limit(slots)


def within_quota(writes: DataFrame, backend: str, order: str, size: str, quota: int) -> DataFrame:
    """writes with ``status`` and ``usage`` after each: one that would pass the quota of its backend is
    refused and takes no room, so later and smaller ones may still be stored."""
    at = writes.columns.index(size)

    def new():
        usage = [0]

        def take(row: tuple) -> tuple:
            if fits := usage[0] + row[at] <= quota:
                usage[0] += int(row[at])
            return "stored" if fits else "stem.quota", usage[0]

        return take

    return replayed(writes, backend, order, "status string, usage long", new)

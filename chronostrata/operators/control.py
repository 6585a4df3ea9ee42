"""Sessions as logs: which calls are accepted, what state they leave, and whole-batch edits."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronostrata.operators.prefix import running

RANGE = 1 << 16


def lifecycle(log: DataFrame, key: str, order: str, action: str, width: int = RANGE) -> DataFrame:
    """A log of play, pause, seek, seeked (a seek's end) and close with ``verdict`` and the ``state`` after.

    Nothing is accepted after a close; play is refused while a seek is pending; a close may come again.
    The state is that of the last accepted play, pause or close: ready before any. ``order`` is a whole number.
    """
    ranges = [F.floor(F.col(order) / width)]
    a = F.col(action)
    rows = running(log, [key], [order], F.when(a == "close", 1).otherwise(0), ranges, "_closed")
    rows = running(rows, [key], [order], F.when(F.col("_closed") > 0, 0).when(a == "seek", 1).when(a == "seeked", -1).otherwise(0), ranges, "_pending")
    verdict = F.when((F.col("_closed") > 0) & a.isin("play", "pause", "seek"), "session.closed").when((a == "play") & (F.col("_pending") > 0), "session.busy").otherwise("accepted")
    rows = rows.withColumn("verdict", verdict)
    moves = (F.col("verdict") == "accepted") & a.isin("play", "pause", "close")
    # Which move is the last so far: a running count names it, and one row for each move gives its state.
    rows = running(rows, [key], [order], F.when(moves, 1).otherwise(0), ranges, "_moves", inclusive=True)
    states = rows.filter(moves).groupBy(key, "_moves").agg(F.max_by(F.when(a == "play", "playing").when(a == "pause", "paused").otherwise("closed"), order).alias("_state"))
    return rows.join(states.withColumnRenamed(key, "_k").withColumnRenamed("_moves", "_m"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_moves") == F.col("_m")), "left").withColumn("state", F.coalesce("_state", F.lit("ready"))).drop("_closed", "_pending", "_moves", "_k", "_m", "_state")


def submitted(edits: DataFrame, batch: str, position: str, refused: Column) -> DataFrame:
    """One receipt for each batch of edits: all are admitted, or none. rejected_index is the first refused
    one's position, 0 where there is none."""
    first = F.min(F.when(refused, F.col(position)))
    return edits.groupBy(batch).agg(first.isNull().alias("ok"), F.coalesce(first, F.lit(0)).alias("rejected_index"), F.when(first.isNull(), F.count("*")).otherwise(0).alias("admitted"))


def replayed(rows: DataFrame, key: str, order: str, added: str, new: Callable) -> DataFrame:
    """rows of each key in order through a state of a few numbers; ``new()`` makes the function that takes a
    row, as a tuple of the columns' values, and gives those of ``added``."""
    columns = rows.columns
    names = [*columns, *(part.split()[0] for part in added.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, take = object(), None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if (k := row[columns.index(key)]) != at:
                    at, take = k, new()
                out.append((*row, *take(row)))
            yield pd.DataFrame(out, columns=names)

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, f"{kinds}, {added}")


def admitted(requests: DataFrame, pool: str, arrival: str, duration: str, width: int, queue: int) -> DataFrame:
    """requests with ``status`` and ``started``: ``width`` run at once in each pool, others wait in the order
    of their arrival, and one that finds ``queue`` waiting is refused (started: null)."""
    columns = requests.columns
    a, d = columns.index(arrival), columns.index(duration)

    def new() -> Callable:
        ends, waiting = [0] * width, deque()

        def take(row: tuple) -> tuple:
            while waiting and waiting[0] <= row[a]:
                waiting.popleft()
            if len(waiting) >= queue:
                return "refused", None
            start = max(int(row[a]), ends[0])
            heapq.heapreplace(ends, start + int(row[d]))
            if start > row[a]:
                waiting.append(start)
            return "admitted", start

        return take

    return replayed(requests, pool, arrival, "status string, started long", new)


def single_flight(requests: DataFrame, key: str, arrival: str, duration: str) -> DataFrame:
    """requests with ``loads`` and ``settled``: one that comes while a load of its key is under way waits for
    that load, any other begins one."""
    columns = requests.columns
    a, d = columns.index(arrival), columns.index(duration)

    def new() -> Callable:
        until = [-1]

        def take(row: tuple) -> tuple:
            if loads := row[a] >= until[0]:
                until[0] = int(row[a] + row[d])
            return bool(loads), until[0]

        return take

    return replayed(requests, key, arrival, "loads boolean, settled long", new)

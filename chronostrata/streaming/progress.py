"""Progress events, coalesced, and ordered ingest of spans: batch and streaming forms of one rule each.

The rules depend on what was delivered or stored before, so they run in order for each key, with a state
of a few numbers; nothing else of a key is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COALESCE_MS = 50
STATE = "last long, delivered long, delivered_at long"
SPAN_STATE = "ends long, packed long, broken int, last long"


class Coalescer:
    """Delivers the first event of a key, the last (bytes reach the total), steps of a twentieth of the
    total, and one event in COALESCE_MS; refuses what falls back or overruns its total."""

    def __init__(self, last: int = -1, delivered: int = 0, delivered_at: int = -(1 << 60)):
        self.last, self.delivered, self.delivered_at = last, delivered, delivered_at

    def takes(self, count: int, total: int, at: int) -> bool:
        if count < 0 or total < 0 or count > total or count < self.last:
            return False
        start, self.last = self.last <= 0, count
        step = count - self.delivered >= max(1, -(-total // 20))
        if start or count >= total or step or at - self.delivered_at >= COALESCE_MS:
            self.delivered, self.delivered_at = count, at
            return True
        return False


def coalesced(events: DataFrame, key: str, order: str, count: str, total: str, at: str) -> DataFrame:
    """The delivered events of each key, in batch. Keys are sources of one session: each is small, and
    many are dealt over the tasks; rows of a key pass through in order."""
    schema = events.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, rule = object(), Coalescer()
        for frame in frames:
            keep = []
            for k, n, t, ms in zip(frame[key], frame[count], frame[total], frame[at]):
                if k != at_key:
                    at_key, rule = k, Coalescer()
                keep.append(rule.takes(int(n), int(t), int(ms)))
            yield frame[keep]

    return events.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def _in_order(frames: Iterator[pd.DataFrame], order: str) -> pd.DataFrame:
    """The rows that one key has in a micro-batch, which come in frames of any order, by ``order``."""
    return pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")


def coalesced_stream(events: DataFrame, key: str, order: str, count: str, total: str, at: str) -> DataFrame:
    """The same on a stream: the state of a key is three numbers. A micro-batch may hold its rows in any order."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule = Coalescer(*state.get) if state.exists else Coalescer()
        frame = _in_order(frames, order)
        keep = [rule.takes(int(n), int(t), int(ms)) for n, t, ms in zip(frame[count], frame[total], frame[at])]
        state.update((rule.last, rule.delivered, rule.delivered_at))
        yield frame[keep]

    return events.groupBy(key).applyInPandasWithState(run, events.schema.simpleString()[7:-1].replace(":", " "), STATE, "append", GroupStateTimeout.NoTimeout)


def ingested_stream(spans: DataFrame, key: str, order: str, start: str, length: str) -> DataFrame:
    """Ordered ingest by the sequence number ``order``: each span with its packed offset; one that starts
    before the stored end is refused with status ``late``, and so is all that follows of its key. There is
    no watermark: late is an error. Rows of a micro-batch are put in order first, as an exchange keeps none;
    a number at or below the last of the batches before is late, too."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ends, packed, broken, last = state.get if state.exists else (0, 0, 0, -(1 << 62))
        frame, out = _in_order(frames, order), []
        for o, s, n in zip(frame[order], frame[start], frame[length]):
            broken = broken or int(s < ends or n < 1 or o <= last)
            out.append((k[0], int(o), int(s), int(n), packed, "late" if broken else "stored"))
            if not broken:
                ends, packed, last = int(s + n), packed + int(n), int(o)
        state.update((ends, packed, broken, last))
        yield pd.DataFrame(out, columns=[key, order, start, length, "packed_offset", "status"])

    kind = dict(spans.dtypes)[key]
    return spans.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {order} long, {start} long, {length} long, packed_offset long, status string", SPAN_STATE, "append", GroupStateTimeout.NoTimeout)


def metered(updates: DataFrame, left: str, right: str) -> DataFrame:
    """Meter updates with the peak of both sides; every other field as it came. Stateless: batch or stream."""
    return updates.withColumn("peak", F.greatest(left, right))

"""Queries that run as Structured Streaming over a table until it is read, with their replay in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronostrata.streaming import progress
from chronostrata.streaming.running import drained, streamed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


SPANS_SQL = """s as (select user_id, event_id, event_id * 10 - case when user_id % 7 = 3 and event_id % 41 = 5 then 100000 else 0 end as start, 1 + event_id % 9 as frames from events),
v as (select *, start < coalesce(lag(start + frames) over (partition by user_id order by event_id), 0) as bad from s),
b as (select *, bool_or(bad) over (partition by user_id order by event_id rows unbounded preceding) as broken from v),
p as (select *, cast(coalesce(sum(case when broken then 0 else frames end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as bigint) as packed_offset from b)"""


def spans(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    start = e * 10 - F.when((u % 7 == 3) & (e % 41 == 5), 100000).otherwise(0)
    return streamed(spark, f"{sf_dir}/events.parquet").select("user_id", e.cast("bigint").alias("event_id"), start.cast("bigint").alias("start"), (e % 9 + 1).cast("bigint").alias("frames"))


@query("r2_ordered_ingest", f"with {SPANS_SQL} select user_id, event_id, start, frames, packed_offset from p where not broken")
def r2(spark, sf_dir):
    return drained(progress.ingested_stream(spans(spark, sf_dir), "user_id", "event_id", "start", "frames")).filter("status = 'stored'").drop("status")


@query("r3_late_spans", f"with {SPANS_SQL} select user_id, min(event_id) as first_late, count(*) as refused from p where broken group by user_id")
def r3(spark, sf_dir):
    late = drained(progress.ingested_stream(spans(spark, sf_dir), "user_id", "event_id", "start", "frames")).filter("status = 'late'")
    return late.groupBy("user_id").agg(F.min("event_id").alias("first_late"), F.count("*").alias("refused"))


#: Bytes rise by 3 % to 7 % of the total with each event, 7 ms an event of the whole log apart: what is
#: delivered depends on what was delivered last, so the SQL goes through each key's events one by one.
PROGRESS_SQL = """e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from events),
p as (select user_id, event_id, k, least(20000, k * 650) as bytes, 20000 as total, event_id % 1000 + k * 30 as at_ms from e),
r(user_id, event_id, k, bytes, total, at_ms, taken, delivered, delivered_at) as (
  select user_id, event_id, k, bytes, total, at_ms, true, bytes, at_ms from p where k = 1
  union all
  select p.user_id, p.event_id, p.k, p.bytes, p.total, p.at_ms, t, case when t then p.bytes else r.delivered end, case when t then p.at_ms else r.delivered_at end
  from r join p on p.user_id = r.user_id and p.k = r.k + 1, lateral (select p.bytes >= p.total or p.bytes - r.delivered >= 1000 or p.at_ms - r.delivered_at >= 50 as t))"""


def progress_rows(events):
    return events.select("user_id", F.col("event_id").cast("bigint").alias("event_id"), F.least(F.lit(20000), F.col("k") * 650).cast("bigint").alias("bytes"), F.lit(20000).cast("bigint").alias("total"), (F.col("event_id") % 1000 + F.col("k") * 30).cast("bigint").alias("at_ms"))


def numbered(spark, sf_dir):
    from pyspark.sql import Window as W

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("k"))


@query("w9_coalesced_progress", f"with recursive {PROGRESS_SQL} select user_id, event_id, bytes::bigint as bytes, total::bigint as total, at_ms::bigint as at_ms from r where taken")
def w9(spark, sf_dir):
    return progress.coalesced(progress_rows(numbered(spark, sf_dir)), "user_id", "event_id", "bytes", "total", "at_ms")


@query("r10_progress_stream", f"with recursive {PROGRESS_SQL} select user_id, event_id, bytes::bigint as bytes, total::bigint as total, at_ms::bigint as at_ms from r where taken")
def r10(spark, sf_dir):
    from chronostrata.streaming.running import work_folder

    folder = work_folder(spark)
    progress_rows(numbered(spark, sf_dir)).write.parquet(folder)
    return drained(progress.coalesced_stream(streamed(spark, folder), "user_id", "event_id", "bytes", "total", "at_ms"))


@query("r11_meter_subscription", "select event_id, user_id, value as peak_left, value * (event_id % 3) as peak_right, greatest(value, value * (event_id % 3)) as peak from events")
def r11(spark, sf_dir):
    updates = streamed(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("value").alias("peak_left"), (F.col("value") * (F.col("event_id") % 3)).alias("peak_right"))
    return drained(progress.metered(updates, "peak_left", "peak_right"))


@query("r12_telemetry_subscription", "select event_id, user_id, event_type, value, props from events")
def r12(spark, sf_dir):
    return drained(streamed(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value", "props"))

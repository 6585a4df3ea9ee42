"""Session queries: logs of calls, batches of edits, windows and samples of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronostrata import session
from chronostrata.operators import control
from chronostrata.sources import packages

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LOG_SQL = """l as (select user_id, event_id, case when event_id % 211 = 7 then 'close' when event_id % 7 in (0, 1) then 'play' when event_id % 7 = 2 then 'pause' when event_id % 7 in (3, 4) then 'seek' else 'seeked' end as action from events),
c as (select *, coalesce(max(case when action = 'close' then 1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as closed from l),
p as (select *, coalesce(sum(case when closed = 1 then 0 when action = 'seek' then 1 when action = 'seeked' then -1 else 0 end) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as pending from c),
v as (select *, case when closed = 1 and action in ('play', 'pause', 'seek') then 'session.closed' when action = 'play' and pending > 0 then 'session.busy' else 'accepted' end as verdict from p),
s as (select *, last_value(case when verdict <> 'accepted' then null when action = 'play' then 'playing' when action = 'pause' then 'paused' when action = 'close' then 'closed' end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as state from v)"""


@query("api_session_lifecycle", f"with {LOG_SQL} select user_id, event_id, action, verdict, coalesce(state, 'ready') as state from s")
def lifecycle(spark, sf_dir):
    e = F.col("event_id")
    action = F.when(e % 211 == 7, "close").when((e % 7).isin(0, 1), "play").when(e % 7 == 2, "pause").when((e % 7).isin(3, 4), "seek").otherwise("seeked")
    return control.lifecycle(table(spark, sf_dir, "events").select("user_id", "event_id", action.alias("action")), "user_id", "event_id", "action").select("user_id", "event_id", "action", "verdict", "state")


@query("api_console_submit", "select l_orderkey, bool_and(l_quantity <= 48) as ok, coalesce(min(l_linenumber) filter (l_quantity > 48), 0)::bigint as rejected_index, case when bool_and(l_quantity <= 48) then count(*) else 0 end as admitted from lineitem group by 1")
def submit(spark, sf_dir):
    return control.submitted(table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("bigint")), "l_orderkey", "l_linenumber", F.col("l_quantity") > 48)


def objects(spark, sf_dir):
    """Every document's bytes as an object of 16 bits, with a gap of 5 frames after every 50: shapes, index and pieces."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.concat("text", "text"), "UTF-8").alias("data"), (F.col("doc_id") % 2 + 1).cast("bigint").alias("channels"))
    d = d.withColumn("identity", F.concat(F.lit("blake3:"), F.col("doc_id").cast("string"))).withColumn("packed", F.coalesce(F.floor(F.octet_length("data") / (2 * F.col("channels"))), F.lit(0)))
    runs = F.explode(F.when(F.col("packed") > 0, F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("packed") - 1) / 50))))
    index = d.withColumn("k", runs).select("identity", (F.col("k") * 55).alias("start"), F.least(F.lit(50), F.col("packed") - F.col("k") * 50).alias("frames"), (F.col("k") * 50).alias("packed_offset"))
    pieces = packages.chunked(d.select("identity", "data"), "data", 120).select("identity", (F.col("chunk") * 120).cast("bigint").alias("at"), "bytes")
    frames = F.col("packed") + F.greatest(F.lit(0), F.floor((F.col("packed") - 1) / 50)) * 5
    return d.select("doc_id", "identity", "channels", F.lit(16).alias("depth"), frames.alias("frames")), index, pieces


def opened(spark, sf_dir) -> session.Session:
    shapes, index, pieces = objects(spark, sf_dir)
    return session.Session(shapes.withColumn("source_id", F.concat(F.lit("s"), F.col("doc_id").cast("string"))).drop("doc_id"), index, pieces)


API_SQL = "d as (select doc_id, text || text as t, 1 + doc_id % 2 as channels from documents), p as (select *, coalesce(strlen(t) // (2 * channels), 0) as packed from d), f as (select *, packed + greatest(0, (packed - 1) // 50) * 5 as frames from p)"


@query("api_window_at", f"with {API_SQL} select 's' || doc_id as source_id, cast(least(130, frames) as bigint) as start, cast(greatest(0, least(256, frames - least(130, frames))) as bigint) as frames from f")
def window_at(spark, sf_dir):
    return opened(spark, sf_dir).window_at(130, 300, 128)


@query(
    "api_observed_samples",
    f"""with {API_SQL}, g as (select *, unnest(range(30, least(330, frames))) as frame from f where doc_id = 1), h as (select *, unnest(range(0, channels)) as channel from g),
    b as (select frame, channel, case when frame % 55 < 50 then 2 * channels * (frame // 55 * 50 + frame % 55) + 2 * channel end as ofs, hex(encode(t)) as x from h),
    v as (select frame, channel, cast('0x' || substr(x, 2 * ofs + 1, 2) as bigint) + 256 * cast('0x' || substr(x, 2 * ofs + 3, 2) as bigint) as v from b)
    select cast(frame as bigint) as frame, cast(channel as integer) as channel, coalesce((v - case when v >= 32768 then 65536 else 0 end)::double / 32768, 0::double) as sample from v""",
)
def observed(spark, sf_dir):
    return opened(spark, sf_dir).samples("s1", 30, 300)


REQUESTS_SQL = "q as (select user_id, event_id, 300 + event_id % 400 as d, row_number() over (partition by user_id order by event_id) as k from events)"


def requests(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("bigint").alias("event_id"), (F.col("event_id") % 400 + 300).cast("bigint").alias("d"))


@query(
    "c1_fifo_admission",
    f"""with recursive {REQUESTS_SQL}, r(user_id, k, event_id, a, b, waiting, status, started) as (
      select distinct user_id, 0::bigint, 0::bigint, 0::bigint, 0::bigint, []::bigint[], '', 0::bigint from q
      union all
      select q.user_id, q.k, q.event_id, case when full_ then r.a else least(r.b, s + q.d) end, case when full_ then r.b else greatest(r.b, s + q.d) end,
        case when not full_ and s > q.event_id then list_append(live, s) else live end, case when full_ then 'refused' else 'admitted' end, case when not full_ then s end
      from r join q on q.user_id = r.user_id and q.k = r.k + 1, lateral (select list_filter(r.waiting, lambda x: x > q.event_id) as live, greatest(q.event_id, r.a) as s), lateral (select len(live) >= 2 as full_))
    select user_id, event_id, status, cast(started as bigint) as started from r where k > 0""",
)
def c1(spark, sf_dir):
    return control.admitted(requests(spark, sf_dir), "user_id", "event_id", "d", 2, 2).select("user_id", "event_id", "status", "started")


@query(
    "c7_single_flight",
    f"""with recursive {REQUESTS_SQL}, r(user_id, k, event_id, loads, settled) as (
      select user_id, k, event_id, true, cast(event_id + d as bigint) from q where k = 1
      union all
      select q.user_id, q.k, q.event_id, q.event_id >= r.settled, cast(case when q.event_id >= r.settled then q.event_id + q.d else r.settled end as bigint) from r join q on q.user_id = r.user_id and q.k = r.k + 1)
    select user_id, event_id, loads, settled from r""",
)
def c7(spark, sf_dir):
    return control.single_flight(requests(spark, sf_dir), "user_id", "event_id", "d").select("user_id", "event_id", "loads", "settled")

"""Pump, mapping and gate queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.functions import scalars as sc
from chronostrata.operators import pump

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUANTUM = 128
SOURCES_SQL = "s as (select c_custkey, c_custkey - 1 as pos, 300 + c_custkey * 37 % 3000 as frames, c_custkey % 5 * 64 as cursor from customer), n as (select count(*) as n from s)"


def sources(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (c - 1).alias("pos"), (c * 37 % 3000 + 300).cast("bigint").alias("frames"), (c % 5 * 64).cast("bigint").alias("cursor"))


@query(
    "r6_pump_commits",
    f"""with {SOURCES_SQL}, q as (select *, frames - cursor as l, unnest(range(0, frames - cursor, {QUANTUM})) as x0 from s)
    select c_custkey, cast(x0 // {QUANTUM} as bigint) as pass, cast(x0 // {QUANTUM} // 8 as bigint) as tick, cast(((pos - x0 // {QUANTUM}) % n + n) % n as bigint) as turn, 3::bigint as generation, cast(cursor + x0 as bigint) as start_frame, cast(least({QUANTUM}, l - x0) as bigint) as frames, x0 + least({QUANTUM}, l - x0) = l as end_of_region from q cross join n""",
)
def r6(spark, sf_dir):
    return pump.commits(sources(spark, sf_dir), "c_custkey", "frames", "cursor", QUANTUM, F.lit(3).cast("bigint"))


@query("t3_fair_pass", f"with {SOURCES_SQL} select c_custkey, cast(((pos - 4) % n + n) % n as bigint) as turn from s cross join n where frames - cursor > 4 * {QUANTUM}")
def t3(spark, sf_dir):
    """The fifth pass: the sources that still have frames, in the order in which it writes them."""
    return r6(spark, sf_dir).filter("pass = 4").select("c_custkey", "turn")


@query("k9_ring_commits", f"with {SOURCES_SQL} select c_custkey, cast((frames - cursor + {QUANTUM - 1}) // {QUANTUM} as bigint) as chunks, cast(frames - cursor as bigint) as frames, cast(frames - (frames - cursor - 1) % {QUANTUM} - 1 as bigint) as last_start from s")
def k9(spark, sf_dir):
    g = r6(spark, sf_dir).groupBy("c_custkey").agg(F.count("*").alias("chunks"), F.sum("frames").alias("frames"), F.max(F.when(F.col("end_of_region"), F.col("start_frame"))).alias("last_start"))
    return g.select("c_custkey", "chunks", "frames", "last_start")


@query("r5_pump_ticks", f"with {SOURCES_SQL}, q as (select c_custkey, frames - cursor as l, unnest(range(0, frames - cursor, {QUANTUM})) as x0 from s) select cast(x0 // {QUANTUM} // 8 as bigint) as tick, count(*) as chunks, cast(sum(least({QUANTUM}, l - x0)) as bigint) as frames, cast(count(*) filter (x0 + {QUANTUM} >= l) as bigint) as finished from q group by 1")
def r5(spark, sf_dir):
    return r6(spark, sf_dir).groupBy("tick").agg(F.count("*").alias("chunks"), F.sum("frames").alias("frames"), F.count(F.when(F.col("end_of_region"), 1)).alias("finished"))


@query("r6_pump_bounds", f"with {SOURCES_SQL}, b as (select 8192 * (1 + c_custkey % 2) * case when c_custkey % 3 = 0 then 3 else 2 end as size from s) select cast((select sum(2 * size) from b) as bigint) as window_bytes, cast((select sum(size) from (select size from b order by size desc limit 4)) as bigint) as scratch_bytes")
def r6_bounds(spark, sf_dir):
    c = F.col("c_custkey")
    return pump.read_bounds(sources(spark, sf_dir), (c % 2 + 1) * F.when(c % 3 == 0, 3).otherwise(2))


@query("r7_generation_invalidation", "with s as (select user_id, event_id as t from events where event_type = 'click'), r as (select event_id as read_id, user_id, event_id as a, event_id + 40 as b from events where event_type <> 'click') select read_id, user_id, (select count(*) from s where s.user_id = r.user_id and s.t <= r.a) as generation, (select count(*) from s where s.user_id = r.user_id and s.t > r.a and s.t <= r.b) = 0 as kept from r")
def r7(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    reads = e.filter("event_type <> 'click'").select(F.col("event_id").alias("read_id"), "user_id", F.col("event_id").alias("a"), (F.col("event_id") + 40).alias("b"))
    seeks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("t"))
    return pump.valid_reads(reads, seeks, "user_id", "a", "b", "t").select("read_id", "user_id", "generation", "kept")


@query("r13_runway_gate", "with u as (select user_id, count(*) as n from events group by 1) select user_id % 10 as session, bool_and(n >= 50) as ready, cast(sum(case when n >= 50 then 0 else 1 end) as bigint) as waiting from u group by 1")
def r13(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return pump.gated(u.select((F.col("user_id") % 10).alias("session"), (F.col("n") >= 50).alias("full")), "session", "full")


@query("r1_pull_deadline", "with p as (select user_id, event_id, event_id - lag(event_id) over (partition by user_id order by event_id) > 400 as late from events), c as (select *, sum(case when late then 1 else 0 end) over (partition by user_id order by event_id rows unbounded preceding) as n from p) select user_id, event_id, case when late then 'stem.read_deadline' else 'delivered' end as status from c where n = 0 or (n = 1 and late)")
def r1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return pump.stalled(e, "user_id", "event_id", "event_id", 400).select("user_id", "event_id", "status")


BLOCKS_SQL = "b as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, cast(l_quantity as bigint) as frames from lineitem)"


def blocks(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("pos"), F.col("l_quantity").cast("bigint").alias("frames"))


#: The timeline of every object: 40 frames, then a gap of 10.
@query(
    "r4_mapped_spans",
    f"with {BLOCKS_SQL}, p as (select *, cast(coalesce(sum(frames) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as a from b), i as (select l_orderkey, a, frames, unnest(range(a // 40, (a + frames + 39) // 40)) as k from p), c as (select l_orderkey, greatest(a, 40 * k) as x, least(a + frames, 40 * k + 40) as y, k from i), t as (select *, unnest(range(x, y, 16)) as f from c) select l_orderkey, cast(f + 10 * k as bigint) as start_frame, cast(least(16, y - f) as bigint) as frames, cast(f as bigint) as packed_frame from t",
)
def r4(spark, sf_dir):
    b = blocks(spark, sf_dir)
    totals = b.groupBy("l_orderkey").agg(F.sum("frames").alias("total"))
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / 40)))
    intervals = totals.withColumn("k", k).select("l_orderkey", (F.col("k") * 50).alias("start"), F.least(F.lit(40), F.col("total") - F.col("k") * 40).alias("frames"), (F.col("k") * 40).alias("packed_offset"))
    return pump.mapped_spans(b, intervals, "l_orderkey", "pos", 64, 16)


@query(
    "r4_chunk_coverage",
    "with b as (select l_orderkey, l_linenumber, sum(cast(l_quantity as bigint) * 4 + case when l_orderkey % 17 = 5 then 1 else 0 end) as bytes, bool_or(l_orderkey % 17 = 5) as bad from lineitem group by 1, 2), c as (select o_orderkey as l_orderkey, unnest(range(1, 4)) as l_linenumber, 20 + o_orderkey % 30 as frames from orders) select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, case when bytes is null then 'missing' when bad then 'shape' when bytes < 4 * frames then 'short' when bytes > 4 * frames then 'long' else 'covered' end as status from c left join b using (l_orderkey, l_linenumber)",
)
def r4_coverage(spark, sf_dir):
    size = F.col("l_quantity").cast("bigint") * 4 + F.when(F.col("l_orderkey") % 17 == 5, 1).otherwise(0)
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), size.alias("bytes"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(3).cast("bigint"))).alias("l_linenumber"), (F.col("o_orderkey") % 30 + 20).alias("frames"))
    return pump.chunk_coverage(b, c, ["l_orderkey", "l_linenumber"], 4).select("l_orderkey", "l_linenumber", "status")


HEXED = "sha256(cast(event_id as varchar))"
SAMPLE_SQL = "unnest(range(0, {n})) as position, {h} as h"


def sample_sql(depth: int) -> str:
    size = depth // 8
    value = " + ".join(f"cast('0x' || substr(h, position * {2 * size} + {2 * j + 1}, 2) as bigint) * {1 << (8 * j)}" for j in range(size))
    return f"select event_id, {depth} as depth, position, (v - case when v >= {1 << (depth - 1)} then {1 << depth} else 0 end)::double / {1 << (depth - 1)} as sample from (select event_id, cast(position as integer) as position, {value} as v from (select event_id, unnest(range(0, {32 // size})) as position, {HEXED} as h from events))"


@query("f4_pcm_samples", f"{sample_sql(16)} union all {sample_sql(24)}")
def f4(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", F.unhex(F.sha2(F.col("event_id").cast("string"), 256)).alias("data"))
    one = lambda depth: d.select("event_id", F.lit(depth).alias("depth"), F.posexplode(sc.samples(F.col("data"), depth)).alias("position", "sample"))
    return one(16).union(one(24))


@query("f4_planes", f"with s as ({sample_sql(16)}) select event_id, position % 2 as channel, max(sample) as highest, min(sample) as lowest from s group by 1, 2")
def f4_planes(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_id", sc.planes(F.unhex(F.sha2(F.col("event_id").cast("string"), 256)), 2, 16).alias("planes"))
    p = d.select("event_id", F.posexplode("planes").alias("channel", "plane"))
    return p.select("event_id", "channel", F.array_max("plane").alias("highest"), F.array_min("plane").alias("lowest"))

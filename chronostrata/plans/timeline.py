"""Interval queries on the events table: hours with events of each user, on a timeline of 768 hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.operators import intervals as iv
from chronostrata.operators.prefix import previous, running

FIRST_HOUR, HORIZON = 473_352, 768
WINDOW, QUANTUM = 100, 16
QUERIES: dict = {}
ORACLES: dict = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - FIRST_HOUR
    return events(spark, sf_dir).select("user_id", hour.cast("bigint").alias("hour")).distinct().withColumn("hours", F.lit(1).cast("bigint"))


def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coalesce_islands(hours(spark, sf_dir), "user_id", "hour", "hours")


def frame_bytes():
    return ((F.col("user_id") % 2) + 1) * (2 + F.col("user_id") % 3 % 2)


FRAME_BYTES_SQL = "((user_id % 2) + 1) * (2 + user_id % 3 % 2)"

ISLANDS_SQL = f"""hours as (select distinct user_id, cast(floor(epoch(ts) / 3600) as bigint) - {FIRST_HOUR} as hour from events),
fresh as (select user_id, hour, case when lag(hour + 1) over (partition by user_id order by hour) = hour then 0 else 1 end as f from hours),
numbered as (select user_id, hour, sum(f) over (partition by user_id order by hour) as island from fresh),
merged as (select user_id, min(hour) as start, count(*) as frames from numbered group by user_id, island),
islands as (select user_id, start, frames, cast(coalesce(sum(frames) over (partition by user_id order by start rows between unbounded preceding and 1 preceding), 0) as bigint) as packed_offset from merged)"""


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, f"with {ISLANDS_SQL}{sql}" if sql.startswith(",") else f"with {ISLANDS_SQL} {sql}"
        return f

    return register


@query("w1_coalesce_islands", "select user_id, start, frames, packed_offset from islands")
def w1(spark, sf_dir):
    return islands(spark, sf_dir)


@query("w2_pcm_index", f"select user_id, start as start_frame, frames, cast(packed_offset * ({FRAME_BYTES_SQL}) as bigint) as byte_offset, cast(sum(frames) over (partition by user_id) * ({FRAME_BYTES_SQL}) as bigint) as active_bytes from islands")
def w2(spark, sf_dir):
    return iv.pcm_index(islands(spark, sf_dir), "user_id", frame_bytes())


GAPS_SQL = f""", g as (select user_id, coalesce(lag(start + frames) over (partition by user_id order by start), 0) as a, start as b from islands
union all select user_id, max(start + frames), {HORIZON} from islands group by user_id)"""


@query("w3_gap_complement", GAPS_SQL + " select user_id, cast(a as bigint) as gap_start, cast(b - a as bigint) as gap_frames from g where b > a")
def w3(spark, sf_dir):
    i = islands(spark, sf_dir)
    return iv.gaps(i, "user_id", i.select("user_id").distinct(), HORIZON)


@query("w3_zero_tiles", GAPS_SQL + ", z as (select user_id, a, unnest(range(0, b - a, 24)) as t, b - a as n from g where b > a) select user_id, cast(a as bigint) as gap_start, cast(t as bigint) as tile_start, cast(least(24, n - t) as bigint) as tile_size from z")
def w3_tiles(spark, sf_dir):
    return iv.tiled(w3(spark, sf_dir), "gap_frames", 24).select("user_id", "gap_start", "tile_start", "tile_size")


@query("w4_dense_zero_fill", f", n as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) - {FIRST_HOUR} as frame, count(*) as c from events group by 1, 2), d as (select u.user_id, unnest(range(0, {HORIZON})) as frame from (select distinct user_id from events) u) select d.user_id, cast(d.frame as bigint) as frame, coalesce(c, 0) as value from d left join n using (user_id, frame)")
def w4(spark, sf_dir):
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) - FIRST_HOUR).cast("bigint")
    counts = events(spark, sf_dir).groupBy("user_id", hour.alias("frame")).agg(F.count("*").alias("c"))
    dense = counts.select("user_id").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HORIZON - 1).cast("bigint"))))
    return dense.join(counts, ["user_id", "frame"], "left").select("user_id", "frame", F.coalesce("c", F.lit(0)).cast("bigint").alias("value"))


SIZE = iv.window_frames(WINDOW, QUANTUM)


@query("w5_window_tiling", f", u as (select user_id, unnest(range(0, {HORIZON}, {SIZE})) as t from (select distinct user_id from islands)) select user_id, cast(t as bigint) as window_start, cast(least({SIZE}, {HORIZON} - t) as bigint) as frames from u")
def w5(spark, sf_dir):
    users = islands(spark, sf_dir).select("user_id").distinct().withColumn("total", F.lit(HORIZON).cast("bigint"))
    return iv.tiled(users, "total", SIZE, "window_start", "frames").select("user_id", "window_start", "frames")


@query("w6_range_tiling", ", d as (select doc_id, n_chars, unnest(range(0, n_chars, 1024)) as a from documents where n_chars > 0) select doc_id, cast(a as bigint) as range_start, cast(least(1024, n_chars - a) as bigint) as range_bytes from d")
def w6(spark, sf_dir):
    return iv.tiled(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars"), "n_chars", 1024, "range_start", "range_bytes").drop("n_chars")


@query("w7_warm_read_tiling", f", t as (select user_id, start, frames * {FRAME_BYTES_SQL} as b, packed_offset * {FRAME_BYTES_SQL} as o, unnest(range(0, frames * {FRAME_BYTES_SQL}, 5)) as a from islands) select user_id, start as start_frame, cast(o + a as bigint) as byte_offset, cast(least(5, b - a) as bigint) as bytes from t")
def w7(spark, sf_dir):
    rows = islands(spark, sf_dir).withColumn("total", F.col("frames") * frame_bytes()).withColumn("o", F.col("packed_offset") * frame_bytes())
    return iv.tiled(rows, "total", 5, "a", "bytes").select("user_id", F.col("start").alias("start_frame"), (F.col("o") + F.col("a")).cast("bigint").alias("byte_offset"), "bytes")


PROGRESS_SQL = ", p as (select user_id, event_id, event_type as stage, cast(floor(value * 100) as bigint) as bytes from events)"


def progress(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("user_id", "event_id", F.col("event_type").alias("stage"), F.floor(F.col("value") * 100).cast("bigint").alias("bytes"))


@query("w8_monotone_progress", PROGRESS_SQL + ", m as (select *, max(bytes) over (partition by user_id, stage order by event_id rows between unbounded preceding and 1 preceding) as prior from p) select user_id, stage, event_id, bytes from m where bytes >= 0 and (prior is null or bytes >= prior)")
def w8(spark, sf_dir):
    w = W.partitionBy("user_id", "stage").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return progress(spark, sf_dir).withColumn("prior", F.max("bytes").over(w)).filter("bytes >= 0 and (prior is null or bytes >= prior)").select("user_id", "stage", "event_id", "bytes")


@query("w10_runway", ", c as (select user_id, hour, hour - row_number() over (partition by user_id order by hour) as run from hours where hour >= 240), r as (select user_id, min(hour) as first, count(*) as n, max(hour) as last from c group by user_id, run) select user_id, cast(min(first) as bigint) as first_frame, cast(coalesce(max(n) filter (first = 240), 0) as bigint) as runway, coalesce(max(n) filter (first = 240) >= 2, false) as ready from r group by user_id")
def w10(spark, sf_dir):
    c = hours(spark, sf_dir).filter("hour >= 240").withColumn("run", F.col("hour") - F.row_number().over(W.partitionBy("user_id").orderBy("hour")))
    r = c.groupBy("user_id", "run").agg(F.min("hour").alias("first"), F.count("*").alias("n"))
    at = F.max(F.when(F.col("first") == 240, F.col("n")))
    return r.groupBy("user_id").agg(F.min("first").alias("first_frame"), F.coalesce(at, F.lit(0)).alias("runway"), F.coalesce(at >= 2, F.lit(False)).alias("ready"))


@query("w11_latest_generation", ", e as (select user_id, event_id, event_id % 7 as generation from events), m as (select *, max(generation) over (partition by user_id) as top from e) select user_id, event_id, generation from m where generation = top")
def w11(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", (F.col("event_id") % 7).alias("generation"))
    return e.withColumn("top", F.max("generation").over(W.partitionBy("user_id"))).filter("generation = top").drop("top")


@query("w12_counter_deltas", PROGRESS_SQL + ", c as (select user_id, event_id, bytes, cast(sum(bytes) over (partition by user_id order by event_id) as bigint) as total from p) select user_id, event_id, total, cast(total - lag(total, 1, 0) over (partition by user_id order by event_id) as bigint) as delta from c")
def w12(spark, sf_dir):
    at = [F.floor(F.col("event_id") / (1 << 16))]
    c = running(progress(spark, sf_dir), ["user_id"], ["event_id"], F.col("bytes"), at, "total", inclusive=True)
    before = previous(c, ["user_id"], ["event_id"], F.col("total"), at, "_before")
    return before.select("user_id", "event_id", "total", (F.col("total") - F.coalesce("_before", F.lit(0))).alias("delta"))


def windows(spark, sf_dir) -> DataFrame:
    return w5(spark, sf_dir).select("user_id", F.col("window_start").alias("w_start"), (F.col("window_start") + F.col("frames")).alias("w_end"))


WINDOWS_SQL = f", u as (select user_id, unnest(range(0, {HORIZON}, {SIZE})) as t from (select distinct user_id from islands)), w as (select user_id, cast(t as bigint) as w_start, cast(least(t + {SIZE}, {HORIZON}) as bigint) as w_end from u)"


@query("j6_window_overlap", WINDOWS_SQL + " select w.user_id, w_start, w_end, cast(greatest(w_start, start) as bigint) as from_frame, cast(least(w_end, start + frames) - greatest(w_start, start) as bigint) as frames, cast(packed_offset + greatest(w_start, start) - start as bigint) as packed_frame from w join islands i on i.user_id = w.user_id and w_start < start + frames and w_end > start")
def j6(spark, sf_dir):
    return iv.overlaps(windows(spark, sf_dir), islands(spark, sf_dir), "user_id", SIZE)


@query("j7_index_seek", ", t as (select user_id, unnest(range(0, 768, 37)) as target from (select distinct user_id from islands)) select t.user_id, cast(target as bigint) as target, coalesce(min(start), -1) as start, coalesce(arg_min(frames, start), 0) as frames from t left join islands i on i.user_id = t.user_id and start + frames > target group by all")
def j7(spark, sf_dir):
    i = islands(spark, sf_dir)
    targets = i.select("user_id").distinct().withColumn("target", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(HORIZON - 1).cast("bigint"), F.lit(37).cast("bigint"))))
    return iv.seek(targets, i, "user_id").select("user_id", "target", F.coalesce("start", F.lit(-1)).alias("start"), F.coalesce("frames", F.lit(0)).alias("frames"))


@query("j8_packed_blocks", ", n as (select user_id, cast(sum(frames) as bigint) as total from islands group by user_id), b as (select user_id, unnest(range(0, total, 3)) as a, total from n), c as (select user_id, a, least(a + 3, total) as z from b) select c.user_id, cast(greatest(a, packed_offset) as bigint) as packed_frame, cast(start + greatest(a, packed_offset) - packed_offset as bigint) as start_frame, cast(least(z, packed_offset + frames) - greatest(a, packed_offset) as bigint) as frames from c join islands i on i.user_id = c.user_id and a < packed_offset + frames and z > packed_offset")
def j8(spark, sf_dir):
    i = islands(spark, sf_dir)
    totals = i.groupBy("user_id").agg(F.sum("frames").alias("total"))
    blocks = iv.tiled(totals, "total", 3, "w_start", "n").select("user_id", "w_start", (F.col("w_start") + F.col("n")).alias("w_end"))
    packed = i.select("user_id", F.col("packed_offset").alias("start"), "frames", F.col("start").alias("packed_offset"))
    return iv.overlaps(blocks, packed, "user_id", 3).select("user_id", F.col("from_frame").alias("packed_frame"), F.col("packed_frame").alias("start_frame"), "frames")


BROKEN_SQL = f", b as (select user_id, row_number() over (partition by user_id order by start) as pos, case when user_id % 5 = 1 and start > 400 then start - 3 else start end as start, case when user_id % 7 = 2 then frames + 700 else frames end as frames, case when user_id % 11 = 3 then packed_offset + 1 else packed_offset end as packed_offset from islands), l as (select *, lag(start + frames) over (partition by user_id order by pos) as prev, coalesce(sum(frames) over (partition by user_id order by pos rows between unbounded preceding and 1 preceding), 0) as packed from b), r as (select user_id, pos, case when start < 0 or frames < 1 or start + frames > {HORIZON} then 'range' when start {{op}} prev then 'order' when packed_offset <> packed then 'offset' end as rule from l) select user_id, cast(min(pos) as integer) as pos, arg_min(rule, pos) as rule from r where rule is not null group by user_id"


def broken(spark, sf_dir) -> DataFrame:
    i = islands(spark, sf_dir).withColumn("pos", F.row_number().over(W.partitionBy("user_id").orderBy("start")))
    u = F.col("user_id")
    return i.select(
        "user_id",
        "pos",
        F.when((u % 5 == 1) & (F.col("start") > 400), F.col("start") - 3).otherwise(F.col("start")).alias("start"),
        F.when(u % 7 == 2, F.col("frames") + 700).otherwise(F.col("frames")).alias("frames"),
        F.when(u % 11 == 3, F.col("packed_offset") + 1).otherwise(F.col("packed_offset")).alias("packed_offset"),
    )


@query("p3_interval_order", BROKEN_SQL.format(op="<="))
def p3(spark, sf_dir):
    return iv.invalid_intervals(broken(spark, sf_dir), "user_id", "pos", HORIZON, adjacent_allowed=False)


@query("p19_worker_intervals", BROKEN_SQL.format(op="<"))
def p19(spark, sf_dir):
    return iv.invalid_intervals(broken(spark, sf_dir), "user_id", "pos", HORIZON, adjacent_allowed=True)


@query("p5_endpoint_equality", ", s as (select user_id, sum(frames) as active from islands group by user_id), c as (select user_id, count(distinct floor(epoch(ts) / 3600)) - case when user_id % 6 = 0 then 1 else 0 end as chunk_frames from events group by user_id) select user_id, cast(active as bigint) as active, cast(chunk_frames as bigint) as chunk_frames, active = chunk_frames as equal from s join c using (user_id)")
def p5(spark, sf_dir):
    s = islands(spark, sf_dir).groupBy("user_id").agg(F.sum("frames").alias("active"))
    c = hours(spark, sf_dir).groupBy("user_id").agg((F.count("*") - F.when(F.col("user_id") % 6 == 0, 1).otherwise(0)).alias("chunk_frames"))
    return s.join(c, "user_id").select("user_id", "active", "chunk_frames", (F.col("active") == F.col("chunk_frames")).alias("equal"))


COUNTS_SQL = f", z as (select user_id, frames * {FRAME_BYTES_SQL} as active, (start - coalesce(lag(start + frames) over (partition by user_id order by start), 0)) * {FRAME_BYTES_SQL} as gap, start + frames as e, {FRAME_BYTES_SQL} as fb from islands), s as (select user_id, sum((active + 4) // 5) as r, sum((gap + 63) // 64) + (({HORIZON} - max(e)) * min(fb) + 63) // 64 as z from z group by user_id) select user_id, cast(r as bigint) as read_calls, cast(z as bigint) as zero_updates, cast(r + z as bigint) as hash_updates from s"


@query("a8_expected_counts", COUNTS_SQL)
def a8(spark, sf_dir):
    return iv.expected_counts(islands(spark, sf_dir), "user_id", HORIZON, frame_bytes(), 5, 64)

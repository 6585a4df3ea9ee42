"""Whole-record validation: manifests, chunk lists, documents and worker responses."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.functions import scalars as sc
from chronostrata.operators import intervals as iv
from chronostrata.plans import timeline as tl

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHUNKS_SQL = "c as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, cast(l_quantity as bigint) as frames from lineitem), d as (select *, coalesce(sum(frames) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) + case when l_orderkey % 9 = 4 and pos = 2 then 1 else 0 end as packed_start, coalesce(sum(frames * 3) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) + case when l_orderkey % 11 = 5 and pos = 3 then 1 else 0 end as byte_offset from c)"


def chunks(spark, sf_dir):
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(order).alias("pos"), F.col("l_quantity").cast("bigint").alias("frames"))
    before = iv.before("pos", key="l_orderkey")
    o = F.col("l_orderkey")
    return c.select(
        "l_orderkey",
        "pos",
        "frames",
        (F.coalesce(F.sum("frames").over(before), F.lit(0)) + F.when((o % 9 == 4) & (F.col("pos") == 2), 1).otherwise(0)).alias("packed_start"),
        (F.coalesce(F.sum(F.col("frames") * 3).over(before), F.lit(0)) + F.when((o % 11 == 5) & (F.col("pos") == 3), 1).otherwise(0)).alias("byte_offset"),
    )


@query("p4_chunk_contiguity", f"with {CHUNKS_SQL}, e as (select *, coalesce(sum(frames) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) as f, coalesce(sum(frames * 3) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) as b from d), r as (select l_orderkey, pos, case when packed_start <> f then 'frames' when byte_offset <> b then 'offset' when frames > 48 then 'length' end as rule from e) select l_orderkey, cast(min(pos) as integer) as pos, arg_min(rule, pos) as rule from r where rule is not null group by l_orderkey")
def p4(spark, sf_dir):
    before = iv.before("pos", key="l_orderkey")
    rule = (
        F.when(F.col("packed_start") != F.coalesce(F.sum("frames").over(before), F.lit(0)), "frames")
        .when(F.col("byte_offset") != F.coalesce(F.sum(F.col("frames") * 3).over(before), F.lit(0)), "offset")
        .when(F.col("frames") > 48, "length")
    )
    bad = chunks(spark, sf_dir).withColumn("rule", rule).filter("rule is not null").groupBy("l_orderkey").agg(F.min(F.struct("pos", "rule")).alias("x"))
    return bad.select("l_orderkey", F.col("x.pos").alias("pos"), F.col("x.rule").alias("rule"))


@query("p6_pcm_index", f"with {tl.ISLANDS_SQL}, r as (select user_id, row_number() over (partition by user_id order by start) as pos, start, frames, packed_offset * 2 + case when user_id % 13 = 6 then 2 else 0 end as byte_offset, lag(start + frames) over (partition by user_id order by start) as prev, packed_offset * 2 as want from islands), v as (select user_id, pos, case when start = prev then 'adjacent' when byte_offset <> want then 'offset' end as rule from r) select user_id, cast(min(pos) as integer) as pos, arg_min(rule, pos) as rule from v where rule is not null group by user_id")
def p6(spark, sf_dir):
    i = tl.islands(spark, sf_dir)
    rows = i.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("start")).alias("pos"), "start", "frames", (F.col("packed_offset") * 2 + F.when(F.col("user_id") % 13 == 6, 2).otherwise(0)).alias("byte_offset"))
    return iv.invalid_intervals(rows.withColumn("packed_offset", F.col("byte_offset") / 2), "user_id", "pos", tl.HORIZON, adjacent_allowed=False)


@query("f14_marker_size", f"with {tl.ISLANDS_SQL}, s as (select user_id, sum(strlen('{{\"byteOffset\":' || packed_offset * 2 || ',\"frames\":' || frames || ',\"startFrame\":' || start || '}}')) as inner_bytes, count(*) as n from islands group by user_id) select user_id, cast(strlen('{{\"intervals\":[],\"user\":' || user_id || '}}') + inner_bytes + n - 1 as bigint) as bytes from s")
def f14(spark, sf_dir):
    one = sc.canonical_json({"byteOffset": F.col("packed_offset") * 2, "frames": F.col("frames"), "startFrame": F.col("start")})
    s = tl.islands(spark, sf_dir).groupBy("user_id").agg(F.sum(F.octet_length(one)).alias("inner"), F.count("*").alias("n"))
    empty = sc.canonical_json({"intervals": F.array().cast("array<int>"), "user": F.col("user_id")})
    return s.select("user_id", (F.octet_length(empty) + F.col("inner") + F.col("n") - 1).cast("bigint").alias("bytes"))


@query("k1_canonical_manifest", f"with {tl.ISLANDS_SQL} select user_id, sha256('{{\"frames\":{tl.HORIZON},\"intervals\":[' || string_agg('{{\"frames\":' || frames || ',\"packedFrameOffset\":' || packed_offset || ',\"startFrame\":' || start || '}}', ',' order by start) || ']}}') as digest from islands group by user_id")
def k1(spark, sf_dir):
    item = F.struct(F.col("start").alias("at"), F.struct("frames", F.col("packed_offset").alias("packedFrameOffset"), F.col("start").alias("startFrame")).alias("item"))
    m = tl.islands(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"]).alias("intervals"))  # at most 65,536 intervals an object
    return m.select("user_id", F.sha2(F.encode(sc.canonical_json({"frames": F.lit(tl.HORIZON), "intervals": F.col("intervals")}), "UTF-8"), 256).alias("digest"))

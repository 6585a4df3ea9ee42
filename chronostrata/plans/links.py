"""Link queries: orders stand for declarations, line items for what was compiled from them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.operators import linking
from chronostrata.operators.prefix import running

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SIDES_SQL = """declared as (select o_orderkey as id, cast(o_custkey % 2 + 1 as bigint) as channels, cast(o_orderkey % 4 as bigint) as depth, o_orderstatus as status, cast(o_orderkey % 7 + 1 as bigint) as frames from orders where o_orderkey % 13 <> 5),
compiled as (select l_orderkey as id, cast(l_orderkey % 2 + 1 as bigint) as channels, cast(min(l_linenumber) as bigint) as depth, max(l_linestatus) as status, count(*) as frames from lineitem where l_orderkey % 17 <> 3 group by l_orderkey)"""
FIELDS = ("channels", "depth", "status", "frames")


def sides(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    declared = o.filter("o_orderkey % 13 <> 5").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 2 + 1).alias("channels"), (F.col("o_orderkey") % 4).alias("depth"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 7 + 1).alias("frames"))
    compiled = li.filter("l_orderkey % 17 <> 3").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_linenumber").cast("bigint").alias("depth"), F.max("l_linestatus").alias("status"), F.count("*").alias("frames"))
    return declared, compiled.withColumn("channels", F.col("id") % 2 + 1)


@query("j1_compiled_declared", f"with {SIDES_SQL} select id, case when d.id is null then 'missing_left' when c.id is null then 'missing_right' when d.channels = c.channels and d.frames = c.frames then 'ok' else 'mismatch' end as status from declared d full outer join compiled c using (id)")
def j1(spark, sf_dir):
    d, c = sides(spark, sf_dir)
    return linking.matched(d, c, "id", ("channels", "frames")).select("id", "status")


@query("j2_first_mismatch", f"with {SIDES_SQL} select id, case when d.channels is distinct from c.channels then 'channels' when d.depth is distinct from c.depth then 'depth' when d.status is distinct from c.status then 'status' else 'frames' end as field from declared d full outer join compiled c using (id) where (d.channels, d.depth, d.status, d.frames) is distinct from (c.channels, c.depth, c.status, c.frames)")
def j2(spark, sf_dir):
    d, c = sides(spark, sf_dir)
    return linking.first_mismatch(linking.matched(d, c, "id", FIELDS), "id", FIELDS)


@query("j3_binding", f"with {SIDES_SQL} select id, d.frames from declared d join compiled c using (id) where d.channels is not distinct from c.channels and d.depth is not distinct from c.depth")
def j3(spark, sf_dir):
    d, c = sides(spark, sf_dir)
    c = c.select(F.col("id").alias("_id"), F.col("channels").alias("_c"), F.col("depth").alias("_d"))
    return d.join(c, (d["id"] == c["_id"]) & d["channels"].eqNullSafe(c["_c"]) & d["depth"].eqNullSafe(c["_d"])).select("id", "frames")


@query("j4_index_shape", f"with {SIDES_SQL} select channels, depth, count(*) as expected, sum(case when c_id is not null then 1 else 0 end)::bigint as agreed from (select d.channels, d.depth, c.id as c_id from declared d left join compiled c on c.id = d.id and c.channels = d.channels and c.depth = d.depth) group by channels, depth")
def j4(spark, sf_dir):
    d, c = sides(spark, sf_dir)
    hit = d.join(c.select("id", "channels", "depth", F.lit(1).alias("hit")), ["id", "channels", "depth"], "left")
    return hit.groupBy("channels", "depth").agg(F.count("*").alias("expected"), F.count("hit").alias("agreed"))


POSITIONS_SQL = "a as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as pos, l_partkey from lineitem), b as (select l_orderkey, pos, case when l_partkey % 50 = 7 then l_partkey + 1 else l_partkey end as l_partkey from a where not (l_orderkey % 31 = 4 and pos = 1))"


@query("j5_positional_compare", f"with {POSITIONS_SQL} select l_orderkey, cast(pos as integer) as pos, a.l_partkey as asserted, coalesce(b.l_partkey, -1) as derived from a left join b using (l_orderkey, pos) where a.l_partkey is distinct from b.l_partkey")
def j5(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("pos"), F.col("l_partkey").alias("asserted"))
    b = a.filter("not (l_orderkey % 31 = 4 and pos = 1)").select("l_orderkey", "pos", F.when(F.col("asserted") % 50 == 7, F.col("asserted") + 1).otherwise(F.col("asserted")).alias("derived"))
    return a.join(b, ["l_orderkey", "pos"], "left").filter("not (asserted <=> derived)").withColumn("derived", F.coalesce("derived", F.lit(-1)))


@query("j9_sources_assets", "select o_custkey as key, 'missing' as problem from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer where c_custkey % 3 <> 0) union all select c_custkey, 'unreferenced' from customer where c_custkey % 3 <> 0 and c_custkey not in (select o_custkey from orders)")
def j9(spark, sf_dir):
    sources = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    assets = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return linking.unreferenced_and_missing(sources, assets, "key")


@query("j10_orphan_files", "select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id % 10 <> 1")
def j10(spark, sf_dir):
    files, index = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    locked = files.filter("doc_id % 10 = 1")
    return files.join(index, "doc_id", "left_anti").join(locked, "doc_id", "left_anti")


@query("j11_lease_membership", "select event_id, user_id from events where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def j11(spark, sf_dir):
    lease = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(lease, "user_id", "left_semi").select("event_id", "user_id")


@query("j12_alias_fan_out", "with v as (select sha256(text) as identity, min(doc_id) as asset, count(*) as aliases from documents group by 1) select doc_id, asset, aliases from documents join v on v.identity = sha256(text)")
def j12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return d.join(d.groupBy("identity").agg(F.min("doc_id").alias("asset"), F.count("*").alias("aliases")), "identity").select("doc_id", "asset", "aliases")


@query("j13_meter_ids", "with t as (select user_id, row_number() over (order by user_id) - 1 as ordinal from (select distinct user_id from events)), p as (select user_id % 40 as ordinal, max(value) as peak from events group by 1) select t.user_id as track, p.peak from p join t using (ordinal)")
def j13(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tracks = running(e.select("user_id").distinct(), [], ["user_id"], F.lit(1), [F.floor(F.col("user_id") / (1 << 16))], "ordinal")
    peaks = e.groupBy((F.col("user_id") % 40).alias("ordinal")).agg(F.max("value").alias("peak"))
    return peaks.join(tracks, "ordinal").select(F.col("user_id").alias("track"), "peak")


@query("a1_requirements_unique", "select sha256(text) as identity, min(doc_id) as first_position, count(*) as rows, count(distinct n_chars) > 1 as conflict from documents group by 1")
def a1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("identity"))
    return linking.unique_by_identity(d, "identity", "doc_id", ["n_chars"])


@query("a2_shape_conflicts", "select l_partkey as identity, min(l_orderkey) as first_position, count(*) as rows, count(distinct (l_suppkey, l_returnflag, l_linestatus, l_quantity, l_discount)) > 1 as conflict from lineitem group by 1")
def a2(spark, sf_dir):
    return linking.unique_by_identity(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "identity"), "identity", "l_orderkey", ["l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"])


@query("a3_duplicate_ids", "select l_orderkey * 10 + l_linenumber as id, count(*) as times from lineitem group by 1 having count(*) > 1")
def a3(spark, sf_dir):
    return linking.duplicates(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "id")


@query("u1_id_set_equality", "(select o_orderkey as id, 'left' as side from orders except all select distinct l_orderkey, 'left' from lineitem where l_quantity > 10) union all (select distinct l_orderkey, 'right' from lineitem where l_quantity > 10 except all select o_orderkey, 'right' from orders where o_orderkey % 5 <> 0)")
def u1(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_orderkey").alias("id")).distinct()
    return linking.two_way_difference(o, li).filter("side = 'left'").union(linking.two_way_difference(o.filter("id % 5 <> 0"), li).filter("side = 'right'"))


@query("u2_live_locks", "select c_name as name from customer where c_acctbal > 5000 union select s_name from supplier where s_acctbal > 0")
def u2(spark, sf_dir):
    held, pending = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_name").alias("name"))
    return held.union(pending).distinct()


PINS_SQL = "p as (select user_id, list(distinct event_type order by event_type) as pins from events group by user_id)"


def pinned(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("pins"))  # a handful of pin names a row


@query("u3_pin_set", f"with {PINS_SQL}, c as (select user_id, case when list_contains(pins, 'click') then pins else list_append(pins, 'click') end as a, pins from p) select user_id, array_to_string(list_filter(a, lambda x: x <> 'view'), ',') as pins, len(a) <> len(pins) or list_contains(a, 'view') as changed from c")
def u3(spark, sf_dir):
    p = pinned(spark, sf_dir).withColumn("a", linking.with_pin(F.col("pins"), F.lit("click")))
    return p.select("user_id", F.array_join(linking.without_pin(F.col("a"), F.lit("view")), ",").alias("pins"), ((F.size("a") != F.size("pins")) | F.array_contains("a", "view")).alias("changed"))


@query("u4_release_pins", f"with {PINS_SQL} select user_id, array_to_string(list_filter(pins, lambda x: x <> 'purchase'), ',') as pins from p where user_id in (select c_custkey from customer where c_nationkey < 12)")
def u4(spark, sf_dir):
    lease = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("user_id"))
    return pinned(spark, sf_dir).join(lease, "user_id", "left_semi").select("user_id", F.array_join(linking.without_pin(F.col("pins"), F.lit("purchase")), ",").alias("pins"))

"""Store, metric and source queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.functions.digests import blake3_hex
from chronostrata.operators import metrics, store
from chronostrata.sources import packages

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("t1_lru_reclaim", "with f as (select doc_id, n_chars, doc_id % 97 as last_used from documents where doc_id not in (select doc_id from labels)), p as (select *, cast(coalesce(sum(n_chars) over (order by last_used, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as freed_before from f) select doc_id, last_used, freed_before from p where freed_before < 500000")
def t1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("doc_id") % 97).alias("last_used"))
    pins = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("pin")).distinct()
    return store.reclaimed(d.join(pins, "doc_id", "left"), 500_000, F.coalesce("pin", F.lit(False)), "last_used", "doc_id", "n_chars").select("doc_id", "last_used", "freed_before")


@query("t2_read_priority", "with s as (select user_id, count(*) as c, user_id % 2 as has_window from events group by user_id), n as (select count(*) as n from s) select user_id, c as occupancy from s cross join n order by has_window, c, ((user_id - 17) % n + n) % n limit 4")
def t2(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("occupancy")).withColumns({"has_window": F.col("user_id") % 2, "pos": F.col("user_id")})
    return store.read_order(s, 17, 4).select("user_id", "occupancy")


@query("t4_sorted_listing", "select c_name, cast(row_number() over (partition by c_nationkey order by c_name) as integer) as place from customer")
def t4(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_name")).alias("place"))


@query("t5_bounded_pull", "select event_id, user_id from events where event_id > 400 order by event_id limit 32")
def t5(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_id > 400").orderBy("event_id").limit(32).select("event_id", "user_id")


@query("t6_compiled_order", "select o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as ordinal from orders")
def t6(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("ordinal"))


@query("k4_committed_payloads", "select l_orderkey, l_linenumber, count(*) as rows from lineitem where l_linenumber = 1 + l_orderkey % 4 and l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F') group by 1, 2")
def k4(spark, sf_dir):
    payloads = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("generation"), "l_linenumber")
    commits = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 4 + 1).alias("generation"))
    return store.committed(payloads, commits, "l_orderkey", "generation").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"))


@query("k6_index_merge", "with o as (select c_custkey as id, c_nationkey as n from customer where c_custkey % 3 <> 0), w as (select c_custkey as id, case when c_custkey % 5 = 0 then c_nationkey + 1 else c_nationkey end as n from customer where c_custkey % 4 <> 0) select id, coalesce(w.n, o.n) as n, case when o.id is null then 'added' when w.id is null or o.n = w.n then 'kept' else 'changed' end as action from o full outer join w using (id)")
def k6(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    new = c.filter("id % 4 <> 0").withColumn("n", F.when(F.col("id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return store.merged_index(c.filter("id % 3 <> 0"), new, "id", ["n"])


@query("c11_latest_open", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def c11(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return e.groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("c15_demoted", "select c_custkey, c_custkey % 7 <> 2 as verified from customer where c_custkey % 7 <> 2 or c_nationkey % 2 = 1")
def c15(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return store.demoted(c, c.filter("c_custkey % 7 = 2").select("c_custkey"), "c_custkey", F.col("c_nationkey") % 2).select("c_custkey", "verified")


@query("a9_residency", "with d as (select user_id, event_id, cast(floor(value) as bigint) * case when event_id % 3 = 0 then -1 else 1 end as d from events), t as (select *, sum(d) over (partition by user_id order by event_id) as t from d) select user_id, cast(arg_max(t, event_id) as bigint) as final, cast(max(t) as bigint) as peak, count(*) as changes from t group by user_id")
def a9(spark, sf_dir):
    delta = F.floor("value").cast("bigint") * F.when(F.col("event_id") % 3 == 0, -1).otherwise(1)
    return metrics.residency(table(spark, sf_dir, "events"), "user_id", "event_id", delta)


@query("a10_stage_counters", "with s as (select event_type, event_id as a, event_id + 1 + user_id % 9 as z from events), e as (select event_type, a as tick, 1 as d from s union all select event_type, z, -1 from s), g as (select event_type, tick, d, sum(d) as b from e group by all), r as (select event_type, sum(b) over (partition by event_type order by tick, d) as x from g), p as (select event_type, max(x) as peak from r group by 1) select s.event_type, count(*) as runs, cast(sum(z - a) as bigint) as length, cast(any_value(peak) as bigint) as peak from s join p using (event_type) group by 1")
def a10(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.col("user_id") % 9).alias("z"))
    return metrics.stage_counters(s, "event_type", "a", "z")


@query("a11_worker_sums", "select event_type, count(*) as n, cast(sum(event_id) as bigint) as ids, cast(sum(user_id) as bigint) as users, cast(sum(floor(value)) as bigint) as value, cast(sum(length(props)) as bigint) as chars from events group by 1")
def a11(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.sum("user_id").alias("users"), F.sum(F.floor("value")).cast("bigint").alias("value"), F.sum(F.length("props")).cast("bigint").alias("chars"))


@query("a12_runnable_bits", "select user_id, cast(max(bit_count(event_id)) as integer) as peak from events group by 1")
def a12(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.bit_count("event_id")).alias("peak"))


@query("a13_allocation_totals", "select o_custkey, cast(sum(o_orderkey * 4096) as bigint) as bytes, sum(o_orderkey * 4096) <= 9007199254740991 as safe from orders group by 1")
def a13(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_orderkey") * 4096).alias("bytes"))
    return g.withColumn("safe", F.col("bytes") <= 9007199254740991)


@query("a14_largest_windows", "with r as (select l_orderkey, l_quantity, row_number() over (partition by l_orderkey order by l_quantity desc) as p from lineitem) select l_orderkey, sum(l_quantity) as largest from r where p <= 4 group by 1")
def a14(spark, sf_dir):
    top = F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_quantity")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", top.alias("p")).filter("p <= 4").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("largest"))


@query("a15_feed_totals", "select source, count(*) as objects, cast(sum(n_chars) as bigint) as bytes, max(n_chars) as largest from documents group by source")
def a15(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("objects"), F.sum("n_chars").alias("bytes"), F.max("n_chars").alias("largest"))


@query("a18_descriptor_budget", "with c as (select l_orderkey, count(*) as n from lineitem group by 1), r as (select l_orderkey, cast(sum(512 + 128 * n) over (partition by l_orderkey % 100 order by l_orderkey) as bigint) as charged from c) select l_orderkey, charged, charged <= 65536 as funded from r")
def a18(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("session", F.col("l_orderkey") % 100)
    return metrics.within_budget(c, "session", "l_orderkey", 512 + 128 * F.col("n"), 65536).select("l_orderkey", "charged", "funded")


@query("a5_sha256", "select doc_id, sha256(text) as digest, cast(strlen(text) as bigint) as bytes from documents")
def a5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("a4_blake3")
def a4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", blake3_hex(F.encode("text", "UTF-8")).alias("digest"))


PACK_SQL = "cast('{\"frames\":' || o_custkey || ',\"id\":' || o_orderkey || '}' as varchar)"


def packed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    manifest = F.encode(F.to_json(F.struct(F.col("o_custkey").alias("frames"), F.col("o_orderkey").alias("id"))), "UTF-8")
    return o.select("o_orderkey", packages.package(manifest, F.encode("o_orderpriority", "UTF-8")).alias("data"))


@query("k2_package_bytes", f"select o_orderkey, lower('4D49534F53544D31' || printf('%02x', strlen({PACK_SQL})) || '000000' || '00000000' || hex(encode({PACK_SQL})) || hex(encode(o_orderpriority))) as data from orders")
def k2(spark, sf_dir):
    return packed(spark, sf_dir).select("o_orderkey", F.lower(F.hex("data")).alias("data"))


@query("s1_package_open", f"select o_orderkey, {PACK_SQL} as manifest, o_orderpriority as payload from orders")
def s1(spark, sf_dir):
    data = F.col("data")
    return packed(spark, sf_dir).filter(packages.header_problem(data).isNull()).select("o_orderkey", F.decode(packages.manifest_of(data), "UTF-8").alias("manifest"), F.decode(packages.payload_of(data), "UTF-8").alias("payload"))


@query("s2_header_admission", "select o_orderkey, case o_orderkey % 5 when 1 then 'magic' when 2 then 'reserved' when 3 then 'length' when 4 then 'short' else 'sound' end as verdict from orders")
def s2(spark, sf_dir):
    m, data = F.col("o_orderkey") % 5, F.col("data")
    tail = data.substr(F.lit(17), F.lit(100000))
    broken = F.when(m == 1, F.concat(F.lit(b"MISOSTM0"), data.substr(F.lit(9), F.lit(100000)))).when(m == 2, F.concat(data.substr(F.lit(1), F.lit(12)), F.unhex(F.lit("00000001")), tail)).when(m == 3, F.concat(data.substr(F.lit(1), F.lit(8)), F.unhex(F.lit("0000000000000000")), tail)).when(m == 4, data.substr(F.lit(1), F.lit(15))).otherwise(data)
    return packed(spark, sf_dir).select("o_orderkey", F.coalesce(packages.header_problem(broken), F.lit("sound")).alias("verdict"))


@query("s4_session_document", "select o_orderkey, cast(i as integer) as position, 's' || i as id, cast(o_custkey + i as bigint) as frames from (select o_orderkey, o_custkey, unnest(range(0, 1 + o_orderkey % 3)) as i from orders)")
def s4(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sources = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 3).cast("int")), lambda i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("id"), (F.col("o_custkey") + i).cast("string").alias("frames")))
    text = o.select("o_orderkey", F.to_json(F.struct(F.lit(1).alias("schema_version"), sources.alias("sources"))).alias("json"))
    parsed = text.select("o_orderkey", F.posexplode(F.from_json("json", "schema_version int, sources array<struct<id:string,frames:string>>")["sources"]).alias("position", "s"))
    return parsed.filter(F.col("s.frames").rlike(r"\A(0|[1-9][0-9]*)\z")).select("o_orderkey", "position", "s.id", F.col("s.frames").cast("bigint").alias("frames"))


@query("s8_locator", "select l_orderkey, l_linenumber, l_partkey, p_name as path, count(*) as n from lineitem join part on p_partkey = l_partkey group by 1, 2, 3, 4")
def s8(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("path"))
    return table(spark, sf_dir, "lineitem").join(p, "l_partkey").groupBy("l_orderkey", "l_linenumber", "l_partkey", "path").agg(F.count("*").alias("n"))


@query("s10_memory_chunks", "select doc_id, cast(a // 700 as integer) as chunk, sha256(substr(hex(encode(text)), 2 * a + 1, 1400)) as digest from (select doc_id, text, unnest(range(0, strlen(text), 700)) as a from documents where strlen(text) > 0)")
def s10(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return packages.chunked(d, "data", 700).select("doc_id", "chunk", F.sha2(F.hex("bytes"), 256).alias("digest"))


PROBE_SQL = "select event_id, event_id % 7 as m, [44100, 48000, 88200, 96000][1 + event_id % 4] as rate, 1 + event_id % 2 as channels, case when event_id % 3 = 0 then 24 else 16 end as depth, event_id * 1000 as samples from events"


def probes(spark, sf_dir):
    e, m = F.col("event_id"), F.col("event_id") % 7
    rate = F.when(m == 5, F.lit(22050)).otherwise(F.get(F.array(*map(F.lit, packages.RATES)), (e % 4).cast("int")))
    depth = F.when(e % 3 == 0, 24).otherwise(16)
    samples = e * 1000  # 36 bits: the upper 4 end the first word
    high = (rate * (1 << 12) + (e % 2) * (1 << 9) + (depth - 1) * 16).cast("bigint") + F.shiftright(samples, 32)
    h = lambda n, size: F.lpad(F.hex(n), 2 * size, "0")
    hexed = F.concat(F.when(m == 6, "664C6144").otherwise("664C6143"), F.lit("80000022"), h(F.when(m == 4, 8).otherwise(4096).cast("bigint"), 2), F.lit("1000"), F.lit("000000000000"), h(high, 4), h(samples.bitwiseAND(F.lit((1 << 32) - 1)), 4), F.lit("00" * 16))
    return table(spark, sf_dir, "events").select("event_id", F.unhex(hexed).alias("data"))


@query("s15_stream_info", f"select event_id, case m when 6 then 'magic' when 4 then 'block_size' when 5 then 'rate' else 'sound' end as verdict, case when m = 5 then 22050 else rate end as rate, channels, depth, samples from ({PROBE_SQL})")
def s15(spark, sf_dir):
    f = packages.stream_info(F.col("data"))
    return probes(spark, sf_dir).select("event_id", F.coalesce(packages.stream_info_problem(F.col("data")), F.lit("sound")).alias("verdict"), *(f[n].cast(t).alias(n) for n, t in (("rate", "int"), ("channels", "bigint"), ("depth", "int"), ("samples", "bigint"))))


@query("s16_metadata_walk", "select event_id, b.number, b.type, b.length, b.offset, b.final from events, (values (0, 0, 34, 4, false), (1, 4, 5, 42, false), (2, 6, 3, 51, true)) b(number, type, length, \"offset\", final)")
def s16(spark, sf_dir):
    rest = F.concat(F.lit("04000005"), F.lit("AA" * 5), F.lit("86000003"), F.lit("BB" * 3))
    first = F.concat(F.lit("664C614300000022"), F.lit("00" * 34))
    d = table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(first, rest)).alias("data"))
    return packages.metadata_walk(d, "event_id", "data")


@query("s11_listing")
def s11(spark, sf_dir):
    return packages.located(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")

"""Ingest, commit, rebuild and lease queries: documents are the objects, faults are planted by number."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronostrata.functions.digests import blake3_hex, ordered_digests
from chronostrata.operators import ingest, store
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


def objects(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))


SIZE_SQL = "strlen(coalesce(text, ''))"


@query("a6_block_stream_digest", "select doc_id, sha256(text) as digest, cast((strlen(text) + 511) // 512 as bigint) as blocks, cast(strlen(text) as bigint) as bytes from documents where strlen(text) > 0")
def a6(spark, sf_dir):
    return ordered_digests(packages.chunked(objects(spark, sf_dir), "data", 512), "doc_id", "chunk", "bytes").select("doc_id", "digest", F.col("pieces").alias("blocks"), "bytes")


@query(
    "k3_dense_ingest",
    f"select doc_id, case when {SIZE_SQL} = 0 then 'unresolved' when doc_id % 11 = 1 then 'truncated' when doc_id % 11 = 2 then 'overrun' when doc_id % 11 = 3 then 'mismatch' else 'stored' end as status, cast(nullif({SIZE_SQL}, 0) as bigint) as observed_bytes from documents",
)
def k3(spark, sf_dir):
    d, f = objects(spark, sf_dir), F.col("doc_id") % 11
    identity = F.concat(F.lit("blake3:"), blake3_hex(F.col("data")))
    size = F.octet_length("data").cast("bigint") + F.when(f == 1, 1).when(f == 2, -1).otherwise(0)
    declared = d.select("doc_id", F.when(f == 3, F.lit("blake3:" + "0" * 64)).otherwise(identity).alias("identity"), size.alias("bytes"))
    return ingest.dense_ingest(packages.chunked(d, "data", 700), declared, "doc_id", "chunk", "bytes").select("doc_id", "status", "observed_bytes")


@query("k3_index_rows", f"select min(doc_id) as first, cast({SIZE_SQL} as bigint) as bytes, 0 as pins from documents where {SIZE_SQL} > 0 group by text")
def k3_index(spark, sf_dir):
    d = objects(spark, sf_dir)
    declared = d.select("doc_id", F.concat(F.lit("blake3:"), blake3_hex(F.col("data"))).alias("identity"), F.octet_length("data").cast("bigint").alias("bytes"))
    stored = ingest.dense_ingest(packages.chunked(d, "data", 700), declared, "doc_id", "chunk", "bytes")
    rows = ingest.index_rows(stored, F.lit(0))
    first = stored.groupBy("identity").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "identity").select("first", "bytes", F.size("pins").alias("pins"))


@query(
    "a17_rebuilt_index",
    f"select doc_id, case when doc_id % 7 = 2 then 'foreign' when doc_id % 7 = 3 then 'live' when doc_id % 7 = 1 then 'removed' else 'kept' end as action, cast({SIZE_SQL} + case when doc_id % 7 = 1 then 1 else 0 end as bigint) as bytes from (select distinct on (text) doc_id, text from documents order by text, doc_id)",
)
def a17(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    f = F.col("doc_id") % 7
    name = F.concat(F.when(f == 2, "staging-").otherwise(ingest.FINAL_PREFIX), blake3_hex(F.col("data")))
    files = d.withColumn("name", name).withColumn("data", F.when(f == 1, F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
    live = files.filter(f == 3).select("name")
    return ingest.rebuilt_index(files, "name", "data", live).select("doc_id", "action", "bytes")


#: Spans of 700 bytes, 350 frames of two; after every third a gap of 100 frames.
SPARSE_SQL = f"d as (select doc_id, 2 * {SIZE_SQL} as size from documents where {SIZE_SQL} > 0), n as (select *, (size + 699) // 700 as n from d)"


def sparse_input(spark, sf_dir):
    f = F.col("doc_id") % 13
    d = objects(spark, sf_dir).filter(F.octet_length("data") > 0).withColumn("data", F.concat("data", "data"))
    spans = packages.chunked(d, "data", 700).withColumn("start", (F.col("chunk") * 350 + F.floor(F.col("chunk") / 3) * 100).cast("bigint"))
    gaps = F.floor((F.ceil(F.octet_length("data") / 700) - 1) / 3)
    silence = lambda frames: F.repeat(F.lit("0000"), frames.cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), gaps.cast("int")), lambda g: F.concat(F.hex(F.col("data").substr(g * 2100 + 1, F.lit(2100))), F.when(g < gaps, silence(F.lit(100))).otherwise("")))
    canonical = F.concat(F.array_join(pieces, ""), silence(F.lit(7)))
    frames = F.octet_length("data") / 2 + gaps * 100 + 7
    expected = d.select("doc_id", (frames - F.when(f == 3, 8).otherwise(0)).cast("bigint").alias("frames"), F.lit(2).cast("bigint").alias("frame_bytes"), F.concat(F.lit("blake3:"), F.when(f == 2, "0" * 64).otherwise(blake3_hex(F.unhex(canonical)))).alias("identity"))
    moved = spans.withColumn("start", F.when((f == 1) & (F.col("chunk") == 1), 349).otherwise(F.col("start"))).withColumn("bytes", F.when((f == 4) & (F.col("chunk") == 0), F.col("bytes").substr(F.lit(1), F.octet_length("bytes") - 1)).otherwise(F.col("bytes")))
    return moved, expected


SPARSE_STATUS_SQL = "case when doc_id % 13 = 1 and n > 1 then 'order' when doc_id % 13 = 2 then 'mismatch' when doc_id % 13 = 3 then 'outside' when doc_id % 13 = 4 then 'alignment' else 'committed' end"


@query("k4_sparse_ingest", f"with {SPARSE_SQL} select doc_id, {SPARSE_STATUS_SQL} as status, case when {SPARSE_STATUS_SQL} = 'committed' then cast((n + 2) // 3 as bigint) end as intervals, case when {SPARSE_STATUS_SQL} = 'committed' then cast(size as bigint) end as active_bytes from n")
def k4_sparse(spark, sf_dir):
    out = ingest.sparse_ingest(*sparse_input(spark, sf_dir), "doc_id", "chunk")
    committed = F.col("status") == "committed"
    return out.select("doc_id", "status", F.when(committed, F.col("intervals")).alias("intervals"), F.when(committed, F.col("active_bytes")).alias("active_bytes"))


@query("k4_visible_spans", f"with {SPARSE_SQL}, c as (select doc_id, size, n from n where {SPARSE_STATUS_SQL} = 'committed'), i as (select doc_id, size, unnest(range(0, (n + 2) // 3)) as g from c) select doc_id, cast(g * 1150 as bigint) as start, cast(least(2100, size - g * 2100) // 2 as bigint) as frames, cast(g * 2100 as bigint) as byte_offset from i")
def k4_visible(spark, sf_dir):
    out = ingest.sparse_ingest(*sparse_input(spark, sf_dir), "doc_id", "chunk").filter("status = 'committed'")
    return out.select("doc_id", F.explode("index").alias("i")).select("doc_id", "i.start", "i.frames", "i.byte_offset")


@query(
    "k10_unpublished_generation",
    "with t as (select o_orderkey, o_custkey, unnest(range(0, 8)) as k from orders), x as (select distinct l_orderkey % 97 as p, l_linenumber - 1 as k from lineitem where l_quantity > 5), f as (select o_orderkey, min(t.k) as k from t left join x on x.p = t.o_orderkey % 97 and x.k = t.k where x.p is null group by 1) select o_orderkey, 'g' || (o_orderkey % 97) || '-' || f.k as generation from orders left join f using (o_orderkey)",
)
def k10(spark, sf_dir):
    existing = table(spark, sf_dir, "lineitem").filter("l_quantity > 5").select(F.concat(F.lit("g"), (F.col("l_orderkey") % 97).cast("string"), F.lit("-"), (F.col("l_linenumber") - 1).cast("string")).alias("name"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return ingest.unpublished(o, existing, "o_orderkey", F.concat(F.lit("g"), (F.col("o_orderkey") % 97).cast("string"))).select("o_orderkey", "generation")


@query(
    "c12_lease_reads",
    "select event_id, case when user_id % 10 = 3 then 'session.closed' when exists (select 1 from orders where o_custkey = user_id and o_orderkey % 20 = event_id % 20) then 'granted' else 'stem.not_found' end as verdict from events",
)
def c12(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("lease"), (F.col("event_id") % 20).alias("stem"))
    pins = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lease"), (F.col("o_orderkey") % 20).alias("stem"))
    closed = e.filter("lease % 10 = 3").select("lease")
    return ingest.lease_reads(e, pins, closed, "lease", "stem").select("event_id", "verdict")


@query("c13_reverse_cleanup", "select user_id, count(*) as ran, arg_max(event_type, event_id) filter (event_id % 6 = 1) as error from events group by user_id")
def c13(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 6 == 1, F.col("event_type")).alias("error"))
    return ingest.first_failure(e, "user_id", "event_id", "error")


@query("c14_aggregated_causes", "select user_id, arg_min(event_type, event_id) as code, count(*) as causes, count(*) > 1 as wraps from events where event_id % 5 = 2 group by user_id")
def c14(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_id % 5 = 2")
    return ingest.aggregated_causes(e, "user_id", "event_id", "event_type")


@query("u5_byte_equality", "select doc_id, min(doc_id) over (partition by text) as class_id, count(*) over (partition by text) as members from documents where text is not null")
def u5(spark, sf_dir):
    """Documents of equal bytes are one class, named by its smallest id: members join their class, pairs are not made."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").alias("size"))
    classes = d.groupBy("digest", "size").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("members"))
    return d.join(classes, ["digest", "size"]).select("doc_id", "class_id", "members")


@query(
    "s12_quota_writes",
    f"""with recursive q as (select source, doc_id, cast({SIZE_SQL} as bigint) as size, row_number() over (partition by source order by doc_id) as k from documents where source is not null),
    r(source, k, doc_id, status, usage) as (
      select distinct source, 0::bigint, 0::bigint, '', 0::bigint from q
      union all
      select q.source, q.k, q.doc_id, case when r.usage + q.size <= 100000 then 'stored' else 'stem.quota' end, case when r.usage + q.size <= 100000 then r.usage + q.size else r.usage end from r join q on q.source = r.source and q.k = r.k + 1)
    select doc_id, status, usage from r where k > 0""",
)
def s12(spark, sf_dir):
    w = table(spark, sf_dir, "documents").filter("source is not null").select("source", F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return store.within_quota(w, "source", "doc_id", "size", 100_000).select("doc_id", "status", "usage")

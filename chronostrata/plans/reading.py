"""Delivery queries: documents as objects that are located, fetched and read."""

from __future__ import annotations

from pyspark.sql import functions as F

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


@query("s5_normalised_documents", "select doc_id, case when doc_id % 9 <> 4 then text end as document from documents")
def s5(spark, sf_dir):
    raw = F.when(F.col("doc_id") % 9 == 4, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", packages.normalised(raw).alias("document"))


@query(
    "s7_full_responses",
    "with r as (select doc_id, strlen(coalesce(text, '')) as body from documents) select doc_id, case when doc_id % 13 = 1 then 'status' when doc_id % 13 = 2 then 'encoding' when doc_id % 13 = 3 then 'length' when doc_id % 13 = 4 and body > 0 then 'excess' when doc_id % 13 = 5 then 'short' else 'sound' end as verdict from r",
)
def s7(spark, sf_dir):
    f, body = F.col("doc_id") % 13, F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    length = F.when(f == 3, "12 ").when((f == 4) & (body > 0), (body - 1).cast("string")).when(f == 5, (body + 1).cast("string")).when(f == 6, F.lit(None)).otherwise(body.cast("string"))
    encoding = F.when(f == 2, "gzip").when(f == 7, "Identity").when(f == 8, "").otherwise(F.lit(None))
    problem = packages.full_response_problem(F.when(f == 1, 206).otherwise(200), encoding, length, body)
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(problem, F.lit("sound")).alias("verdict"))


@query("s7_sequential_reads", "with r as (select doc_id, strlen(text) as n, unnest(range(0, strlen(text), 512)) as a from documents where strlen(text) > 0) select doc_id, cast(a as bigint) as first, cast(least(512, n - a) as bigint) as bytes, a + least(512, n - a) = n as done from r")
def s7_reads(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n")).filter("n > 0")
    return packages.sequential_reads(d, "n", 512).select("doc_id", F.col("at").alias("first"), "bytes", F.col("end").alias("done"))


@query("s9_sparse_locator", "select l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name as path, case when p.p_name is null then 'stem.delivery.address' end as problem from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem) l left join (select * from part where p_partkey % 6 <> 1) p on p_partkey = l_partkey")
def s9(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    known = table(spark, sf_dir, "part").filter("p_partkey % 6 <> 1").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("path"))
    return packages.located_objects(wanted, known, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "path", "problem")


def encoded(spark, sf_dir):
    """Objects of 42 bytes of description, a block of event_id % 50 bytes, a last one of 3 and 40 + event_id % 100 of audio."""
    e = F.col("event_id")
    info = "664C614300000022" + "1000" * 2 + "000000000000" + "0AC442F0" + "00001000" + "00" * 16
    pad = F.concat(F.lit("04"), F.lpad(F.hex(e % 50), 6, "0"), F.repeat(F.lit("AA"), (e % 50).cast("int")))
    audio = F.repeat(F.lit("BB"), (e % 100 + 40).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.unhex(F.concat(F.lit(info), pad, F.lit("86000003CCCCCC"), audio)).alias("data"))


@query(
    "s13_ranged_reads",
    """with e as (select event_id, event_id % 50 as p, 40 + event_id % 100 as a from events), s as (select event_id, 46 + p + 7 as begin, 46 + p + 7 + a as size from e), t as (select *, unnest(range(begin, size, 64)) as x from s)
    select event_id, 'probe' as phase, 0::bigint as first, 41::bigint as last from e union all select event_id, 'metadata', 42, 45 from e union all select event_id, 'metadata', 46 + p, 49 + p from e
    union all select event_id, 'audio', x, least(x + 64, size) - 1 from t""",
)
def s13(spark, sf_dir):
    return packages.ranged_reads(encoded(spark, sf_dir), "event_id", "data", 64)


@query(
    "s14_finite_extents",
    "select doc_id, case when strlen(coalesce(text, '')) = 0 then 'missing' when doc_id % 13 = 1 then 'short' when doc_id % 13 = 2 then 'excess' when doc_id % 13 = 3 then 'digest' else 'sound' end as status, cast(nullif((strlen(coalesce(text, '')) + 299) // 300, 0) as bigint) as reads from documents",
)
def s14(spark, sf_dir):
    f = F.col("doc_id") % 13
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    size = F.octet_length("data").cast("bigint") + F.when(f == 1, 1).when(f == 2, -1).otherwise(0)
    extents = d.select("doc_id", size.alias("bytes"), F.when(f == 3, F.lit("0" * 64)).otherwise(F.sha2("data", 256)).alias("sha256"))
    return packages.finite_extents(packages.chunked(d, "data", 300), extents, "doc_id", "chunk", "bytes").select("doc_id", "status", "reads")

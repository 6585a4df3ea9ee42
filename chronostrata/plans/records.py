"""Records with at most one planted fault each, admitted or refused by name. The SQL knows what was planted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.functions import scalars as sc
from chronostrata.sources import manifests as m

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(subject: str, verdicts: dict[int, str], otherwise: str = "sound") -> str:
    return f"case {subject} " + " ".join(f"when {k} then '{v}'" for k, v in verdicts.items()) + f" else '{otherwise}' end"


FAULTS = 29
INTERVAL_FAULTS = {12: "interval.outside", 13: "interval.number", 14: "interval.offset"}
CHUNK_FAULTS = {16: "chunk.bytes", 17: "chunk.digest", 18: "chunk.offset", 19: "chunk.start"}
OBJECT_FAULTS = {1: "depth", 2: "channels", 3: "format", 4: "frames", 5: "identity", 6: "rate", 7: "json", 8: "shape", 9: "shape", 10: "shape", **INTERVAL_FAULTS, 15: "endpoint", **CHUNK_FAULTS, 22: "payload"}


def manifests(spark, sf_dir) -> DataFrame:
    """o_orderkey, json, payload_bytes: 1 to 4 intervals and 1 to 3 chunks, sound but for fault o_orderkey % FAULTS."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % FAULTS).alias("f"), (F.col("o_custkey") % 50 + 100).cast("bigint").alias("size"), (F.col("o_orderkey") % 4 + 1).cast("bigint").alias("k"), (F.col("o_orderkey") % 3 + 1).cast("bigint").alias("n"))
    f, k, n, size = F.col("f"), F.col("k"), F.col("n"), F.col("size")
    planted = lambda fault, bad, good, here=F.lit(True): F.when((f == fault) & here, bad).otherwise(good)
    long = lambda **c: F.struct(*(v.cast("bigint").alias(name) if name not in ("flacSha256", "pcmSha256") else v.alias(name) for name, v in c.items()))
    digest = F.sha2(F.col("o_orderkey").cast("string"), 256)
    each = F.floor(k * size / n)

    def interval(i):
        last = i == k - 1
        start = i * (size + 10) + planted(11, -10, planted(12, 1 << 40, 0, last), last & (k > 1))
        return long(frames=planted(13, 0, size, i == 0), packedFrameOffset=i * size + planted(14, 1, 0, last), startFrame=start)

    def chunk(j):
        last = j == n - 1
        frames = F.when(last, k * size - each * (n - 1)).otherwise(each) + planted(15, 1, 0, last)
        return long(bytes=planted(16, m.MOST_CHUNK_BYTES + 1, j + 1000, last), flacSha256=planted(17, F.upper(digest), digest, last), frames=frames, offset=j * 1000 + j * (j - 1) / 2 + planted(18, 1, 0, last), packedStartFrame=j * each + planted(19, 1, 0, last), pcmSha256=digest)

    rates = F.get(F.array(*map(F.lit, m.RATES)), (F.col("o_orderkey") % 4).cast("int"))
    numbers = lambda count: F.sequence(F.lit(0).cast("bigint"), count - 1)
    record = F.struct(
        planted(1, 20, 16).alias("bitDepth"),
        planted(2, 3, 2).alias("channels"),
        F.transform(numbers(n), chunk).alias("chunks"),
        planted(3, "other_v1", m.FORMAT).alias("format"),
        planted(4, 0, k * (size + 10)).alias("frames"),
        F.concat(planted(5, "sha256:", "blake3:"), digest).alias("identity"),
        F.transform(numbers(k), interval).alias("intervals"),
        planted(6, 22050, rates).alias("sampleRateHz"),
    )
    text = o.withColumn("json", F.to_json(record))
    json = F.col("json")
    edited = (
        F.when(f == 7, F.substring(json, F.lit(1), F.length(json) - 1))
        .when(f == 8, F.regexp_replace(json, r"\}\z", ',"zone":1}'))
        .when(f == 9, F.regexp_replace(json, '"channels":2', '"channels":"2"'))
        .when(f == 10, F.regexp_replace(json, '"frames":([0-9]+),"identity"', '"identity"'))
        .when(f == 20, F.regexp_replace(json, ',"format"', ', "format"'))
        .when(f == 21, F.regexp_replace(json, '"bitDepth":16,"channels":2,', '"channels":2,"bitDepth":16,'))
        .otherwise(json)
    )
    end = n * 1000 + n * (n - 1) / 2 + planted(22, 1, 0)
    return text.select("o_orderkey", "f", edited.alias("json"), end.cast("bigint").alias("payload_bytes"))


P1_SQL = f"case when o_orderkey % {FAULTS} = 11 and o_orderkey % 4 > 0 then 'interval.order' else {cases(f'o_orderkey % {FAULTS}', OBJECT_FAULTS)} end"


@query("p1_manifest_verdict", f"select o_orderkey, {P1_SQL} as verdict from orders")
def p1(spark, sf_dir):
    return manifests(spark, sf_dir).select("o_orderkey", F.coalesce(m.manifest_problem(F.col("json"), F.col("payload_bytes")), F.lit("sound")).alias("verdict"))


@query("s3_manifest_admission", f"select o_orderkey, case o_orderkey % {FAULTS} when 20 then 'canonical' when 21 then 'canonical' when 23 then 'utf8' when 24 then 'size' else {P1_SQL} end as verdict from orders")
def s3(spark, sf_dir):
    data = F.encode("json", "UTF-8")
    data = F.when(F.col("f") == 23, F.concat(data, F.unhex(F.lit("FF")))).when(F.col("f") == 24, F.unhex(F.lit(""))).otherwise(data)
    return manifests(spark, sf_dir).withColumn("data", data).select("o_orderkey", F.coalesce(m.manifest_bytes_problem(F.col("data"), F.col("payload_bytes")), F.lit("sound")).alias("verdict"))


DOCUMENT_FAULTS = {1: "document", 2: "document", 3: "document", 4: "document", 5: "source", 6: "source", 7: "source", 9: "source", 10: "source", 11: "source", 13: "json", 14: "source", 15: "source"}


@query("p11_document_sources", f"select o_orderkey, case when o_orderkey % 17 = 12 and o_orderkey % 3 > 0 then 'duplicate' else {cases('o_orderkey % 17', DOCUMENT_FAULTS)} end as verdict from orders")
def p11(spark, sf_dir):
    f, n = F.col("o_orderkey") % 17, F.col("o_orderkey") % 3
    planted = lambda fault, bad, good: F.when(f == fault, F.lit(bad)).otherwise(F.lit(good))
    first = lambda i, fault, bad, good: F.when((f == fault) & (i == 0), F.lit(bad)).otherwise(F.lit(good))

    def source(i):
        name = F.when((f == 5) & (i == 0), '""').otherwise(F.concat(F.lit('"s'), F.when(f == 12, 0).otherwise(i).cast("string"), F.lit('"')))
        depth = first(i, 7, "20", "16")
        depth = F.when((f == 8) & (i == 0), '"32f"').when((f == 14) & (i == 0), '"16"').otherwise(depth)
        frames = F.when((f == 9) & (i == 0), '"0123"').when((f == 10) & (i == 0), "123").otherwise('"123"')
        channels = F.when((f == 6) & (i == 0), "0").when((f == 15) & (i == 0), "1.5").otherwise("2")
        return F.concat(F.lit('{"id":'), name, first(i, 11, "", ',"content":"blake3:00"'), F.lit(',"channels":'), channels, F.lit(',"bit_depth":'), depth, F.lit(',"frames":'), frames, F.lit("}"))

    sources = F.concat(F.lit(',"sources":['), F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint")), source), ","), F.lit("]"))
    version = F.when(f == 1, "2").when(f == 2, '"1"').otherwise("1")
    text = F.concat(F.lit('{"schema_version":'), version, F.lit(',"sample_rate_hz":'), planted(3, "44100.5", "44100"), F.when(f == 4, "").otherwise(sources), planted(13, "", "}"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("json")).select("o_orderkey", F.coalesce(m.document_problem(F.col("json")), F.lit("sound")).alias("verdict"))


@query("p13_index_validity", "select doc_id % 20 as store, bool_and(doc_id % 140 <> 1 and n_chars > 0 and doc_id % 141 not in (2, 3, 4) and doc_id % 143 not in (5, 6)) as valid, count(*) as entries from documents group by 1")
def p13(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents"), F.col("doc_id")
    name = F.concat(F.lit("blake3:"), F.sha2("text", 256), F.when(e % 140 == 1, "\n").otherwise(""))
    used = F.when(e % 141 == 2, F.lit(float("nan"))).when(e % 141 == 3, F.lit(float("inf"))).when(e % 141 == 4, F.lit(None)).otherwise(e.cast("double"))
    pins = F.when(e % 143 == 5, F.lit(None)).when(e % 143 == 6, F.array(F.lit("a"), F.lit(None))).when(e % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = d.select((e % 20).alias("store"), m.index_row_sound(name, F.col("n_chars"), used, pins).alias("sound"))
    return rows.groupBy("store").agg(F.bool_and("sound").alias("valid"), F.count("*").alias("entries"))


@query(
    "p9_span_preflight",
    "select doc_id, case when doc_id % 13 = 5 then 'bytes' when not coalesce(strlen(text), 0) * (1 + doc_id % 9) between 1 and 131072 then 'length' when doc_id % 11 = 4 then 'keys' when doc_id % 7 = 3 then 'start' else 'sound' end as verdict from documents",
)
def p9(spark, sf_dir):
    e = F.col("doc_id")
    data = F.when(e % 13 != 5, F.encode(F.repeat(F.coalesce("text", F.lit("")), (e % 9 + 1).cast("int")), "UTF-8"))
    keys = F.when(e % 11 == 4, F.array(F.lit("bytes"), F.lit("startFrame"), F.lit("note"))).otherwise(F.array(F.lit("bytes"), F.lit("startFrame")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(m.span_problem(data, F.when(e % 7 == 3, -1).otherwise(e), keys), F.lit("sound")).alias("verdict"))


ANSWER_FAULTS = {1: "protocol", 2: "protocol", 3: "jobId", 4: "generation"}
COMPLETE_FAULTS = {6: "identity", 7: "hashUpdates", 8: "readWaitMs", 9: "hashMs", 10: "digest"}


@query(
    "p20_worker_responses",
    f"""select event_id, case when event_id % 19 in (1, 2, 3, 4) then {cases('event_id % 19', ANSWER_FAULTS)} when event_id % 3 = 0 then {cases('event_id % 19', {5: 'bytes'})}
    when event_id % 3 = 1 then {cases('event_id % 19', COMPLETE_FAULTS)} else {cases('event_id % 19', {11: 'failure', 12: 'failure'})} end as verdict from events""",
)
def p20(spark, sf_dir):
    e = F.col("event_id")
    f, sort = e % 19, e % 3
    planted = lambda fault, bad, good: F.when(f == fault, F.lit(bad)).otherwise(F.lit(good) if not hasattr(good, "alias") else good)
    digest = F.sha2(e.cast("string"), 256)
    r = F.struct(
        planted(1, 2, 1).alias("version"),
        F.when(f == 2, "ping").when(sort == 0, "progress").when(sort == 1, "complete").otherwise("failure").alias("type"),
        planted(3, 0, 1).alias("jobId"),
        F.when(f == 4, F.lit(None)).otherwise(1).alias("generation"),
        planted(5, -1, 0).alias("bytes"),
        planted(6, "blake3:0", F.concat(F.lit("blake3:"), digest)).alias("identity"),
        planted(10, "0" * 63, digest).alias("digest"),
        planted(11, "other", "io").alias("kind"),
        F.when(f != 12, "text").alias("message"),
        *(planted(7, 1 << 53, 3).alias(c) if c == "hashUpdates" else F.lit(3).alias(c) for c in m.COUNTERS),
        *(planted(8, float("nan"), 0.5).alias(c) if c == "readWaitMs" else planted(9, float("inf"), 0.5).alias(c) if c == "hashMs" else F.lit(0.5).alias(c) for c in m.TIMES),
    )
    return table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", F.coalesce(m.response_problem(F.col("r")), F.lit("sound")).alias("verdict"))


# What one worker accounts for, in bytes. Two output credits and one event of 384 KiB each.
KIB = 1024
COMPONENTS = {
    "exact range": 256 * KIB,
    "compressed input slot": 256 * KIB,
    "codec input copy": 256 * KIB,
    "decoder linear memory": 2048 * KIB,
    "decoded output credits": 2 * 384 * KIB,
    "codec pending output": 384 * KIB,
    "decoded write in flight": 384 * KIB,
    "write clone": 384 * KIB,
    "canonical digest": 2 * 128 * KIB,
    "transport digest": 64 * KIB,
    "metadata and control": 4 * KIB + 16,
}


@query("a16_memory_components", "select 5181456::bigint as accounted, 3207152::bigint as headroom")
def a16(spark, sf_dir):
    t = spark.createDataFrame(list(COMPONENTS.items()), "component string, bytes long")
    return t.agg(F.sum("bytes").alias("accounted"), (F.lit(8 * sc.MIB) - F.sum("bytes")).alias("headroom"))


@query(
    "f2_canonical_json",
    """select o_orderkey, '{"a":[{"x":' || o_custkey || ',"y":[1,2,{"p":null,"q":true}]},"' || o_orderstatus || '"],"b":{"c":' || o_orderkey || ',"d":{"e":"é","f":[]}},"z":{}}' as json from orders""",
)
def f2(spark, sf_dir):
    text = F.concat(F.lit('{ "z" : {}, "b":{"d": {"f":[ ],"e":"\\u00e9"},"c": '), F.col("o_orderkey").cast("string"), F.lit('},\n"a":[{"y":[1, 2,{"q":true,"p":null}],"x":'), F.col("o_custkey").cast("string"), F.lit('},"'), F.col("o_orderstatus"), F.lit('"]}'))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("json")).select("o_orderkey", m.recursive_json(F.col("json")).alias("json"))


MOST_PACKED = (256 << 10) // 24
BITS_SQL = "case when {x} = 0 then repeat('0', 16) else printf('%016x', ((floor(log2({x}))::bigint + 1023) << 52) + (({x} - (1::bigint << floor(log2({x}))::bigint)) << (52 - floor(log2({x}))::bigint))) end"
TURNED_SQL = " || ".join(f"substr(h, {15 - 2 * k}, 2)" for k in range(8))


@query(
    "f15_interval_packing",
    f"""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([1, 2, 3]) as part, cast(l_linenumber * 64 as bigint) as a, cast(l_quantity as bigint) as b, cast(l_linenumber * l_quantity as bigint) as c from (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem)),
    v as (select *, case part when 1 then a when 2 then b else c end as x from r), h as (select *, {BITS_SQL.format(x='x')} as h from v)
    select l_orderkey, string_agg({TURNED_SQL}, '' order by l_linenumber, l_partkey, l_suppkey, b, part) as packed from h group by l_orderkey""",
)
def f15(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("b"))
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "b")
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(item)).alias("items"))  # an index holds 65,536 intervals at most
    triples = F.flatten(F.transform("items", lambda x: F.array((x["l_linenumber"] * 64).cast("bigint"), x["b"], x["l_linenumber"] * x["b"])))
    return lists.select("l_orderkey", F.lower(F.hex(sc.packed_doubles(triples, 3 * MOST_PACKED))).alias("packed"))

"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a pseudo-random u in (0, 1) from md5; a record goes to the shard with the
largest ln(u) / weight. Adding a shard leaves the scores of the others alone, so rows move only into
the new one. Slots number the rows of a shard without gaps: rows are dealt into ranges small enough
for one task, counted, and numbered within their range from the count of the ranges before. Only
built-in expressions run here.

Defined results: a null text has no bytes (size 1, CRC of nothing: 0); a null key is the key of the
empty record, the same for all; equal keys share a shard; repeated rows each get a slot of their own;
an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.llm.lineage import cut
from chronostrata.llm.mixing import dealt

SHARDS = 8
#: Rows that one task numbers.
RANGE_ROWS = 10_000


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of the md5 of the parts, joined by colons (null: empty)."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: the index of the largest ln(u) / weight, ties to the smaller index."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    scores = [F.struct((F.log(unit(key, F.lit(s))) / float(w)).alias("score"), F.lit(-s).alias("s")) for s, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["s"]).cast("int")


def numbered(rows: DataFrame, shard: str, spread: Column, order: list[Column], range_rows: int = RANGE_ROWS, copies: str | None = None) -> DataFrame:
    """rows with ``slot``: 0, 1, 2, ... within each shard, in ranges of the hash ``spread``. With ``copies``
    a row stands for so many, and its slot is the first of theirs."""
    n = F.col(copies) if copies else F.lit(1)
    ranges = max(1, -(-(rows.agg(F.sum(n)).first()[0] or 0) // range_rows))
    rows = rows.withColumn("_range", F.pmod(spread, F.lit(ranges)))
    counts = rows.groupBy(shard, "_range").agg(F.sum(n).alias("_rows"))
    before = counts.select(shard, "_range", F.coalesce(F.sum("_rows").over(W.partitionBy(shard).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row of ``before`` for each shard and range: its size follows from RANGE_ROWS.
    placed = rows.join(before, [shard, "_range"])
    ahead = F.sum(n).over(W.partitionBy(shard, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return placed.withColumn("slot", F.col("_before") + F.coalesce(ahead, F.lit(0))).drop("_range", "_before")


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of grown_weight).

    Rows of equal id and text are counted into one first, so no range grows with their number; they are
    dealt out again with neighbouring slots.
    """
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    told = docs.select("doc_id", (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = cut(
        told.groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("_copies"))
        .select("*", F.lit("key").alias("law"), rendezvous(F.col("doc_id"), weights).alias("shard"), rendezvous(F.col("doc_id"), [*weights, grown_weight]).alias("grown_shard"))
    )
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"))), 1, 8), 16, 10).cast("bigint")
    out = dealt(numbered(rows, "shard", spread, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], range_rows, "_copies"), "_copies", "_copy")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("slot") + F.col("_copy")).cast("bigint").alias("slot"), "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    """The same rows in SQL. The table of CRC-32 follows from its polynomial, 3988292384."""
    u = lambda s: f"ln((cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':{s}'), 1, 12) as bigint) + 0.5::double) / 281474976710656::double)"
    pick = lambda n: f"cast(list_position([{', '.join(u(s) for s in range(n))}], list_max([{', '.join(u(s) for s in range(n))}])) - 1 as integer)"
    return f"""
with t as (select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, y: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
b as (select r, list_transform(range(strlen(text)), lambda i: cast('0x' || substr(h, 2 * i + 1, 2) as bigint)) as bytes from d),
c as (select r, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295::bigint) as text_crc32 from b, t),
s as (select d.r, doc_id, cast(strlen(text) + 1 as bigint) as size, cast(text_crc32 as bigint) as text_crc32, {pick(SHARDS)} as shard, {pick(SHARDS + 1)} as grown_shard from d join c using (r))
select doc_id, size, text_crc32, 'key' as law, shard, grown_shard, row_number() over (partition by shard order by cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || text_crc32), 1, 8) as bigint) % greatest(1, cast(ceil((select count(*) from d) / {RANGE_ROWS}.0) as bigint)), doc_id, text_crc32, size) - 1 as slot from s"""


ORACLE = _oracle()

"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query, in matrix blocks. A round counts the scores of each query
in BINS equal bins of the range that still holds its kth score; the bin with the kth score is the next
range, until a bin is one score wide. A task reports a query's bins only down to its own kth score, as
the global kth cannot be lower. Where more candidates tie at the kth score than are wanted, the same
selection over ids finds the last id taken. Then candidates are filtered by (score, id).

Queries are handled in chunks of at most CHUNK_QUERIES rows and CHUNK_BYTES, shared with all tasks;
candidates are read where they lie and never shuffled. A task holds a batch of candidates and the counts
of one chunk, and reports k bins or rows a query at most, however many vectors are equal.

Scores are exact: components are whole numbers floor(256 * x); products are summed in doubles while
every sum is below 2**53, in Python integers beyond; a sum beyond 63 bits stands at the end of that range.
Vectors of different length are compared as if padded with zeros.

Defined results: vectors that are null, or hold null or non-finite components, take no part, as queries
or candidates; a null id is no query and no candidate; equal rows of one query id ask once; a
candidate row counts as often as it occurs; a query with fewer than k candidates gets them all; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronostrata.llm.lineage import cut, ship

K, EVERY, SCALE = 5, 50, 256.0
BITS = 10  # of a round: 1024 bins
CHUNK_QUERIES, CHUNK_BYTES = 4096, 32 << 20
MOST = (1 << 62) - 1
ROWS, QUERIES = 2048, 1024  # of a score matrix


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """id, v: rows that take part, v in doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & F.col(id_column).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter(fine)


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Whole components, a row a vector, padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact whole inner products, held to [-MOST, MOST]."""
    width = min(queries.shape[1], candidates.shape[1])
    q, c = queries[:, :width], candidates[:, :width]
    if width * np.abs(q).max(initial=0) * np.abs(c).max(initial=0) < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = [[max(-MOST, min(MOST, sum(map(int.__mul__, a, b)))) for b in [[int(x) for x in r] for r in c.tolist()]] for a in [[int(x) for x in r] for r in q.tolist()]]
    return np.array(exact, np.int64)


@dataclass
class Chunk:
    """Queries with, for each, the range [low, low + 2**span) that holds its kth value."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    span: int
    need: np.ndarray  # how many of the k are in the range
    kth: np.ndarray | None = None  # the kth score, once it is known: then values are ids, from the last
    open: np.ndarray | None = None  # queries that a round is for

    @property
    def shift(self) -> int:
        """The width of a bin, as a power of two."""
        return max(0, self.span - BITS)

    def blocks(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Queries, ids of candidates, and scores; a query's own row scores below all."""
        for i in range(0, batch.num_rows, ROWS):
            s = batch.slice(i, ROWS)
            ids, c = s.column("id").to_numpy(zero_copy_only=False), matrix(s.column("v"))
            for a in range(0, len(self.ids), QUERIES):
                part = slice(a, min(a + QUERIES, len(self.ids)))
                scores = products(self.vectors[part], c)
                scores[self.ids[part, None] == ids[None, :]] = -MOST - 1
                yield part, ids, scores


def counted(candidates: DataFrame, chunk: Chunk, k: int) -> DataFrame:
    """q, bin, n: how many values of each query lie in each bin of its range."""
    shared = candidates.sparkSession.sparkContext.broadcast(chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = shared.value
        bins = 1 << (chunk.span - chunk.shift)
        counts = np.zeros((len(chunk.ids), bins), np.int64)
        for batch in batches:
            for part, ids, scores in chunk.blocks(batch):
                if chunk.kth is None:
                    value, inside = scores, scores >= -MOST
                else:
                    value = np.broadcast_to(~ids, scores.shape)
                    inside = (scores == chunk.kth[part, None]) & chunk.open[part, None]
                low = chunk.low[part, None]
                inside = inside & (value >= low)
                q, c = np.nonzero(inside)
                at = (value[q, c] - low[q, 0]) >> chunk.shift
                fits = at < bins
                counts[part] += np.bincount(q[fits] * bins + at[fits], minlength=len(scores) * bins).reshape(-1, bins)
        above = counts[:, ::-1].cumsum(1)[:, ::-1] - counts
        q, b = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], ["q", "bin", "n"])

    return candidates.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))


def refined(candidates: DataFrame, chunk: Chunk, k: int) -> np.ndarray:
    """Rounds until bins are one value wide. chunk.low is then the value that fills ``need``; returns how
    many candidates have it. Queries with too few candidates keep the lowest value."""
    below = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    n_queries, there = len(chunk.ids), np.zeros(len(chunk.ids), np.int64)
    need = candidates.sparkSession
    while True:
        wanted = need.createDataFrame(list(enumerate(chunk.need.tolist())), "q long, need long")
        upto = counted(candidates, chunk, k).withColumn("upto", F.sum("n").over(below))
        # One row for each query of a chunk comes back: at most CHUNK_QUERIES.
        rows = upto.join(wanted, "q").filter("upto >= need").groupBy("q").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("x")).select("q", "x.*").collect()
        low, found = chunk.low.copy(), np.zeros(n_queries, bool)
        for r in rows:
            low[r["q"]] += r["bin"] << chunk.shift
            chunk.need[r["q"]] -= r["upto"] - r["n"]
            there[r["q"]], found[r["q"]] = r["n"], True
        low[~found] = -MOST if chunk.kth is None else np.iinfo(np.int64).min
        chunk.low = low
        there[~found] = 0
        if chunk.shift == 0:
            return there
        chunk.span = chunk.shift
        if chunk.open is not None:
            chunk.open &= found


def best(candidates: DataFrame, queries: pa.Table, bound: int, ids: tuple[int, int], k: int) -> DataFrame:
    """query_id, rank, vec_id, score for one chunk of queries. bound: no score is beyond it; ids: the
    least and the greatest id of a candidate."""
    qs = queries.combine_chunks()
    vectors = matrix(qs.column("v").combine_chunks() if isinstance(qs.column("v"), pa.ChunkedArray) else qs.column("v"))
    n = qs.num_rows
    chunk = Chunk(qs.column("id").to_numpy(), vectors, np.full(n, -bound), (2 * bound + 1).bit_length(), np.full(n, k))
    there = refined(candidates, chunk, k)
    chunk.kth, last = chunk.low, np.full(n, np.iinfo(np.int64).max)
    ties = there > chunk.need
    if ties.any():
        chunk = Chunk(chunk.ids, vectors, np.full(n, ~ids[1]), (ids[1] - ids[0] + 1).bit_length(), np.where(ties, chunk.need, k), chunk.kth, ties)
        refined(candidates, chunk, k)
        last = np.where(ties, ~chunk.low, last)
    shared = candidates.sparkSession.sparkContext.broadcast((chunk, last))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, last = shared.value
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for part, ids, scores in chunk.blocks(batch):
                kth = chunk.kth[part, None]
                q, c = np.nonzero((scores >= -MOST) & ((scores > kth) | ((scores == kth) & (ids[None, :] <= last[part, None]))))
                held = [np.concatenate([x, y]) for x, y in zip(held, (q + part.start, ids[c], scores[q, c]))]
                order = np.lexsort((held[1], -held[2], held[0]))
                held = [x[order] for x in held]
                place = np.arange(len(held[0])) - np.searchsorted(held[0], held[0])
                held = [x[place < k] for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(chunk.ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["q", "query_id", "vec_id", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.mapInArrow(take, "q long, query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of greatest score for every query."""
    spark = candidates.sparkSession
    ship(spark)
    c = usable(candidates, id_column, vector)
    asked = cut(usable(queries, id_column, vector).distinct())
    size = lambda rows: rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0))))).alias("norm"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    of_queries, of_candidates = size(asked), size(c)
    if not of_queries["n"] or not of_candidates["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    bound = min(float(MOST), np.nextafter(of_queries["norm"] * of_candidates["norm"] * (1 + 1e-9), np.inf) + 2)
    rows = max(1, min(CHUNK_QUERIES, CHUNK_BYTES // (8 * max(1, of_queries["width"]))))
    chunks = -(-of_queries["n"] // rows)
    out = []
    for i in range(chunks):
        own = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(chunks)) == i).orderBy("id", "v").toArrow()
        if own.num_rows:
            found = best(c, own, int(bound), (of_candidates["low"], of_candidates["high"]), k)
            out.append(found if chunks == 1 else cut(found))
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


ORACLE = f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor({SCALE}::double * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from e q join e c on q.vec_id % {EVERY} = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= {K}"""

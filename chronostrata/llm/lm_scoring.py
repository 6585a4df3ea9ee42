"""Stupid-backoff scores of documents under the n-gram counts of all documents.

The n-grams of a block of documents are aggregated before they are exchanged: each distinct one once, with
its count. The count tables are partitioned by n-gram hash: the part of a hash sums what all blocks send,
and joins the sums back to the n-grams of every block. Each block scores its words from the joined counts
and sums them per document. Frequent n-grams are one entry a block, so no part is hot; the exchange grows
with the number of distinct n-grams in the input. Words and pairs are exchanged first, then each longer
order by itself; the files of an exchange are deleted before the next begins.

A word's score is count(n-gram) / count(context) for the longest n-gram, of up to ORDER words, that occurs
LEAST times, times ALPHA for each order given up; a single word scores count / words, one that never occurs
ALPHA / words. With ``others``, as in op9_lm_scoring, counts are those of all other documents, so a text
does not vouch for itself: n-grams that only this text has are backed off from, and a copy elsewhere shows.
Without, counts are those of the whole corpus, in which no n-gram of the documents is unseen. Logarithms
are summed as whole millionths, so the sum does not depend on its order.

N-grams are known by 64-bit hashes. Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. Defined
results: a null or empty text has no words and the score 0; repeated rows count and score each time, and are
other documents to each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm import blocks as B
from chronostrata.llm import words as W
from chronostrata.llm import workers
from chronostrata.llm.lineage import cut_large, ship

ORDER, ALPHA, LEAST = 3, 0.4, 1


def ngrams(texts: list[bytes], orders: Sequence[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order n the hash of the n words that end at each word (0: the text has fewer before
    it), and where each text's words begin."""
    hashes, at = [], [np.zeros(1, np.int64)]
    for i, j in W.pieces(texts):
        h, own = W.document_words(texts[i:j], True)
        hashes.append(h)
        at.append(own[1:] + at[-1][-1])
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    at = np.concatenate(at)
    place = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    out = []
    for n in orders:
        w = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            w[n - 1 :] = W.windows(h, n) | np.uint64(1)
        w[place < n - 1] = 0
        out.append(w)
    return out, at


def distinct(texts: list[bytes], orders: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where texts begin; the distinct n-grams, which of them stands at each word (order after order), their counts."""
    grams, at = ngrams(texts, orders)
    keys, inverse, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    if len(keys) and keys[0] == 0:
        counts[0] = 0
    return at, keys, inverse, counts


def scores(counts: list[np.ndarray], at: np.ndarray, words: np.ndarray, alpha: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Millionths of the natural logarithm summed for each text, and how often a text gave up an order.
    counts: by order, for each word; -1: there is no such n-gram. words: in the corpus, for each word."""
    words = np.maximum(words, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(counts[0] > 0, counts[0] / words, alpha / words)
        lost = (counts[0] <= 0).astype(np.int64)
        for n in range(2, len(counts) + 1):
            there = counts[n - 1] >= 0
            before = np.concatenate([[1], counts[n - 2][:-1]])
            seen = there & (counts[n - 1] >= least)
            s = np.where(seen, counts[n - 1] / np.maximum(before, 1), np.where(there, alpha * s, s))
            lost = np.where(seen, 0, lost + there)
        micro = np.rint(np.log(s) * 1e6).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(micro)])
    backs = np.concatenate([[0], np.cumsum(lost)])
    return np.diff(sums[at]), np.diff(backs[at])


def joined_counts(table: DataFrame, orders: Sequence[int], parts: int) -> DataFrame:
    """block, part, reply: the corpus counts of the distinct n-grams of these orders in each block.
    Checkpointed; the exchange is gone by then."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload")):
                _, keys, _, counts = distinct(B.texts_of(B.opened(payload.as_py())), orders)
                at = B.slices(keys, parts)
                spans = [(k, i, j) for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([B.packed_keys(keys[i:j]) for _, i, j in spans], pa.binary()), pa.array([varied(counts[i:j]) for _, i, j in spans], pa.binary())],
                    ["part", "block", "keys", "counts"],
                )
                workers.trim()

    def reply(cells: pa.Table) -> pa.Table:
        keys = [B.unpacked_keys(x) for x in cells.column("keys").to_pylist()]
        counts = np.concatenate([unvaried(x) for x in cells.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, counts)[inverse].astype(np.int64)
        at = np.cumsum([0, *map(len, keys)])
        return pa.table({"block": cells.column("block"), "part": cells.column("part"), "reply": pa.array([varied(total[i:j]) for i, j in zip(at[:-1], at[1:])], pa.binary())})

    cells = table.select("block", "payload").mapInArrow(ask, "part int, block long, keys binary, counts binary")
    return cut_large(cells.groupBy("part").applyInArrow(reply, "block long, part int, reply binary"))


def score_documents(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST, others: bool = True) -> DataFrame:
    """doc_id, n_words, n_backoffs, score_micro (sum of ln, in millionths), mean_log_score."""
    ship(docs.sparkSession)
    table = B.packed(docs.select("doc_id", F.col("text").cast("string").alias("text")), count_words=True)
    size = table.agg(F.count("*").alias("blocks"), F.sum("n_words").alias("words")).first()
    parts, words = B.parts_for(size["blocks"]), size["words"] or 0
    waves = [tuple(range(1, min(order, 2) + 1)), *((n,) for n in range(3, order + 1))]
    replies = None
    for k, orders in enumerate(waves):
        more = joined_counts(table, orders, parts).withColumn("wave", F.lit(k))
        replies = more if replies is None else replies.union(more)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for b in batches:
            for payload, replies in zip(b.column("payload"), b.column("replies")):
                held = B.opened(payload.as_py())
                ids, texts = B.column(held, "doc_id"), B.texts_of(held)
                found = sorted((r["wave"], r["part"], r["reply"]) for r in replies.as_py() or ())
                counts = []
                for k, orders in enumerate(waves):
                    at, keys, inverse, _ = distinct(texts, orders)
                    total = np.concatenate([np.zeros(0, np.int64), *(unvaried(x) for wave, _, x in found if wave == k)])
                    if len(total) != len(keys):
                        raise ValueError("a block was read with other documents than before")
                    none = len(keys) and keys[0] == 0
                    owner = np.repeat(np.arange(len(texts)), np.diff(at))
                    for own in inverse.reshape(len(orders), -1):
                        each = total[own]
                        if others:
                            _, which, n = np.unique(owner * max(1, len(keys)) + own, return_inverse=True, return_counts=True)
                            each = each - n[which]
                        counts.append(np.where(own == 0, -1, each) if none else each)
                size = np.diff(at)
                micro, lost = scores(counts, at, np.repeat(words - size, size) if others else np.full(size.sum(), words), alpha, least)
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(lost), pa.array(micro)], ["doc_id", "n_words", "n_backoffs", "score_micro"])
                workers.trim()

    rows = B.answered(table, replies, "wave").select("payload", "replies").mapInArrow(score, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_backoffs", "score_micro"))]))
    return rows.withColumn("mean_log_score", F.col("score_micro") / 1e6 / F.greatest(F.col("n_words"), F.lit(1)))


def varied(x: np.ndarray) -> bytes:
    """Counts: how many, a byte for each (255: it is larger), and the larger ones whole."""
    large = x >= 255
    return len(x).to_bytes(4, "little") + np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes()


def unvaried(x: bytes) -> np.ndarray:
    n = int.from_bytes(x[:4], "little")
    out = np.frombuffer(x, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(x[4 + n :], "<i8")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of context, every count above 0, the counts of all other documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_WORDS = r"""
with d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
w as (select r, unnest(range(1, len(ws) + 1)) as i, ws from d),
g as (select r, i, ws[i] as a, case when i > 1 then ws[i - 1] end as b, case when i > 2 then ws[i - 2] end as e, len(ws) as size from w),"""

_SUMS = """
t as (select r, sum(cast(round_even(ln(p) * 1e6::double, 0) as bigint)) as micro, sum(lost) as lost from s group by r)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(lost, 0) as bigint) as n_backoffs, cast(coalesce(micro, 0) as bigint) as score_micro,
  cast(coalesce(micro, 0) as bigint)::double / 1e6::double / greatest(len(ws), 1)::double as mean_log_score from d left join t using (r)"""

ORACLE = f"""{_WORDS}
u0 as (select r, a, count(*) as n from g group by r, a), u as (select a, sum(n) as c from u0 group by a),
m0 as (select r, b, a, count(*) as n from g where b is not null group by r, b, a), m as (select b, a, sum(n) as c from m0 group by b, a),
k0 as (select r, e, b, a, count(*) as n from g where e is not null group by r, e, b, a), k as (select e, b, a, sum(n) as c from k0 group by e, b, a),
n as (select count(*) as words from g),
f as (select g.r, g.b is not null as two, g.e is not null as three, greatest(1, words - size) as words, u.c - u0.n as c1, x.c - x0.n as x1, m.c - m0.n as c2, y.c - y0.n as x2, k.c - k0.n as c3
      from g cross join n join u on u.a = g.a join u0 on u0.r = g.r and u0.a = g.a left join u x on x.a = g.b left join u0 x0 on x0.r = g.r and x0.a = g.b
      left join m on m.b = g.b and m.a = g.a left join m0 on m0.r = g.r and m0.b = g.b and m0.a = g.a left join m y on y.b = g.e and y.a = g.b left join m0 y0 on y0.r = g.r and y0.b = g.e and y0.a = g.b
      left join k on k.e = g.e and k.b = g.b and k.a = g.a left join k0 on k0.r = g.r and k0.e = g.e and k0.b = g.b and k0.a = g.a),
s1 as (select *, case when c1 > 0 then c1::double / words::double else {ALPHA}::double / words::double end as p1, case when c1 > 0 then 0 else 1 end as l1 from f),
s2 as (select *, case when not two then p1 when c2 > 0 then c2::double / x1::double else {ALPHA}::double * p1 end as p2, case when not two then l1 when c2 > 0 then 0 else l1 + 1 end as l2 from s1),
s as (select r, case when not three then p2 when c3 > 0 then c3::double / x2::double else {ALPHA}::double * p2 end as p, case when not three then l2 when c3 > 0 then 0 else l2 + 1 end as lost from s2),{_SUMS}"""


def trigram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of context and every count of the whole corpus, the text itself included."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), others=False)


TRIGRAM_ORACLE = f"""{_WORDS}
u as (select a, count(*) as c from g group by a),
n as (select count(*) as words from g),
m as (select b, a, count(*) as c from g where b is not null group by b, a),
k as (select e, b, a, count(*) as c from g where e is not null group by e, b, a),
s as (select g.r, 0 as lost, case when g.e is not null then k.c::double / y.c::double when g.b is not null then m.c::double / x.c::double else u.c::double / n.words::double end as p
      from g join u on u.a = g.a cross join n left join m on m.b = g.b and m.a = g.a left join u x on x.a = g.b left join k on k.e = g.e and k.b = g.b and k.a = g.a left join m y on y.b = g.e and y.a = g.b),{_SUMS}"""

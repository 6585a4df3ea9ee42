"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds the distinct hashes of its five-word shingles. Shingles are ordered by how many
sets hold them, then by hash. With t the least overlap that any partner needs, two linked documents
share l shingles among the first |set| - t + l of each, for every l. Each document chooses l by the
candidates its prefix would meet, estimated from the shingle counts: where they are many it takes a
longer prefix and asks partners for as many more shared shingles; a pair must meet the smaller demand.

How many sets hold a shingle comes from one block exchange (see blocks.py): blocks send 32 bits of each
distinct shingle to the part of the hash space that counts it. Truncation can only raise a count, alike
for all documents, so the order stays one order. A shingle counted once is in no other set; a document
with fewer shared shingles than t has no partner and goes no further.

Equal sets are one class, named by its smallest doc_id. Within the list of classes that share a prefix
shingle, all are compared with the most central class first, the hub; links become components. Pairs in
different components are then candidates only where lengths and overlaps with the hub still allow a link
(see links()); those whose prefixes share fewer shingles than demanded go, and only the rest is verified
on whole sets. Copies and near copies thus cost a few comparisons each instead of one for each pair,
and no link between different components is missed.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z in lower case; fewer than five words are one shingle. Defined
results: a text without words has an empty set, links with nothing and is its own component; a null
doc_id links with nothing and has a null component; repeated rows are copies; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.llm import blocks as B
from chronostrata.llm import words as W
from chronostrata.llm import workers
from chronostrata.llm.components import components
from chronostrata.llm.lineage import cut, cut_large, few, ship

SHINGLE, PERCENT = 5, 75
#: Demands that a document may choose from, and what a comparison costs beside a look at a list entry.
DEMANDS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
COMPARISON = 8.0
#: Of the bytes of the blocks' payloads, what few() expects of replies and of each table that links are found by.
SHARE = 8


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact below 192, then eight steps to each doubling."""
    high = 192 + np.floor(8 * np.log2(np.maximum(counts, 192) / 192))
    return np.where(counts < 192, counts, np.minimum(high, 255)).astype(np.uint8)


def decoded(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < 192, codes, 192 * 2.0 ** ((codes.astype(float) - 192) / 8))


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix(keys: np.ndarray, codes: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """The demand l and the shared shingles of the l-prefix, rarest first."""
    n = len(keys)
    order = np.lexsort((keys, codes))
    ranked = codes[order]
    cost = np.concatenate([[0.0], np.cumsum(np.where(ranked > 1, decoded(ranked) - 1, 0))])
    t = least_overlap(n, percent)
    choices = [d for d in DEMANDS if d <= t]
    prices = [cost[min(n, n - t + d)] * (1 + COMPARISON / d) for d in choices]
    demand = choices[int(np.argmin(prices))]
    first = order[: min(n, n - t + demand)]
    return demand, keys[first[codes[first] > 1]]


def described(table: DataFrame, percent: int, n_blocks: int, size: int) -> DataFrame:
    """block, place, doc_id, n, digest, shared, demand, tokens, own for each document of the blocks: checkpointed.

    tokens and own (the set's shared shingles) are null where a document can have no partner, and where
    its block has the same set under a smaller doc_id. ``size``: bytes of the payloads.
    """
    parts = B.parts_for(n_blocks)
    low = np.uint64(64 - (parts.bit_length() - 1) - 32)

    def sets_of(payload: bytes) -> tuple[pa.Array, list[np.ndarray], list[bytes], list[int], np.ndarray, np.ndarray]:
        """ids, sets, digests, which documents stand for their set, all their shingles, the distinct ones."""
        held = B.opened(payload)
        ids, sets = B.column(held, "doc_id").cast(pa.int64()), W.shingle_sets(B.texts_of(held), SHINGLE)
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        first: dict[bytes, int] = {}
        known = ids.to_pylist()
        for k in sorted((k for k in range(len(sets)) if len(sets[k]) and known[k] is not None), key=lambda k: known[k]):
            first.setdefault(digests[k], k)
        stand = sorted(first.values())
        flat = np.concatenate([np.zeros(0, np.uint64), *(sets[k] for k in stand)])
        return ids, sets, digests, stand, flat, np.unique(flat)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload")):
                *_, flat, keys = sets_of(payload.as_py())
                counts = np.bincount(np.searchsorted(keys, flat), minlength=len(keys))
                at = B.slices(keys, parts)
                short = ((keys >> low) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                counts = coded(counts)
                spans = [(k, i, j) for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in spans], pa.int32()), pa.array([block] * len(spans), pa.int64()), pa.array([B.packed_keys(short[i:j]) for _, i, j in spans], pa.binary()), pa.array([counts[i:j].tobytes() for _, i, j in spans], pa.binary())],
                    ["part", "block", "keys", "counts"],
                )
                workers.trim()

    def reply(cells: pa.Table) -> pa.Table:
        keys = [B.unpacked_keys(x) for x in cells.column("keys").to_pylist()]
        counts = np.concatenate([decoded(np.frombuffer(x, np.uint8)) for x in cells.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = coded(np.rint(np.bincount(inverse, counts))[inverse])
        at = np.cumsum([0, *map(len, keys)])
        return pa.table({"block": cells.column("block"), "part": cells.column("part"), "reply": pa.array([total[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary())})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for b in batches:
            for block, payload, replies in zip(b.column("block").to_pylist(), b.column("payload"), b.column("replies")):
                ids, sets, digests, stand, flat, keys = sets_of(payload.as_py())
                found = sorted((r["part"], r["reply"]) for r in replies.as_py() or ())
                codes = np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(x, np.uint8) for _, x in found)])
                if len(codes) != len(keys):
                    raise ValueError("a block was read with other documents than before")
                n = len(sets)
                shared, demand, tokens, own = [0] * n, [0] * n, [None] * n, [None] * n
                for k in stand:
                    s = sets[k]
                    c = codes[np.searchsorted(keys, s)]
                    shared[k] = int((c > 1).sum())
                    if shared[k] >= least_overlap(len(s), percent):
                        demand[k], t = prefix(s, c, percent)
                        tokens[k], own[k] = t.view(np.int64), s[c > 1].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([d if len(s) else None for d, s in zip(digests, sets)], pa.binary()), pa.array(shared, pa.int64()), pa.array(demand, pa.int32()), pa.array(tokens, pa.list_(pa.int64())), pa.array(own, pa.binary())],
                    ["block", "place", "doc_id", "n", "digest", "shared", "demand", "tokens", "own"],
                )
                workers.trim()

    ship(table.sparkSession)
    cells = table.mapInArrow(ask, "part int, block long, keys binary, counts binary")
    replies = cut_large(few(cells.groupBy("part").applyInArrow(reply, "block long, part int, reply binary"), size // SHARE))
    return cut_large(few(B.answered(table, replies).select("block", "payload", "replies").mapInArrow(describe, "block long, place long, doc_id long, n long, digest binary, shared long, demand int, tokens array<long>, own binary"), size))


def demanded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as the smaller demand: no other is linked.
    Only prefixes are read for this, sets are attached to the pairs that are left."""
    left = sets.select(F.col("d").alias("a"), F.col("demand").alias("la"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("d").alias("b"), F.col("demand").alias("lb"), F.col("tokens").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").filter(shared >= F.least("la", "lb")).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, both, linked, rest for pairs (a, b) of documents: verified on the whole sets.

    ``rest`` is a prefix of the shared shingles of a that b lacks: two documents a that are linked although
    b does not explain it share one of these.
    """
    left = sets.select(F.col("d").alias("a"), F.col("n").alias("na"), F.col("own").alias("sa"))
    right = sets.select(F.col("d").alias("b"), F.col("n").alias("nb"), F.col("own").alias("sb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for batch in batches:
            both, linked, rest = [], [], []
            for na, nb, sa, sb in zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                inside = np.isin(x, y, assume_unique=True)
                both.append(n := int(inside.sum()))
                linked.append(100 * n >= percent * (na + nb - n))
                more, least = x[~inside], max(1, least_overlap(na, percent) - n)
                rest.append(more[: len(more) - least + 1].view(np.int64) if len(more) >= least else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int64()), pa.array(linked, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))], ["a", "b", "na", "nb", "both", "linked", "rest"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long, na long, nb long, both long, linked boolean, rest array<long>")


def links(found: DataFrame, percent: int, size: int = 0) -> DataFrame:
    """Links (a, b) between classes of equal sets, by their smallest doc_id, that span all components.

    The documents of a token's list are compared with its hub, the one with the largest share of shared
    shingles. Two documents d, e of a list in different components overlap by min(|d & hub|, |e & hub|)
    shingles of the hub at most; where that is too little, they share shingles that the hub lacks, and
    meet in the lists of these. Lists of one component are closed. ``size``: see few().
    """
    classes = found.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    involved = found.filter("own is not null").select(F.col("doc_id").alias("d"), "digest", "n", "shared", "demand", "tokens", "own")
    sets = involved.select("d", "n", "demand", "tokens", "own")
    named = involved.drop("own").join(classes, (involved["digest"] == classes["digest"]) & (involved["d"] == classes["rep"]))
    # Two sets of sizes n and m need an overlap of p / (100 + p) * (n + m), which neither's shared
    # shingles may fall short of: partners of n have at most ``reach`` shingles.
    reach = F.expr(f"cast(floor(shared * {100 + percent} / {percent}) as bigint) - n").alias("reach")
    entries = cut(few(named.select("d", "n", reach, (F.col("shared") / F.col("n")).alias("central"), F.explode("tokens").alias("token")), size))
    lists = entries.groupBy("token").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max(F.struct("central", -F.col("d"), F.col("d").alias("d"))).alias("hub"))
    lists = lists.filter("size > 1").select("token", "least", F.col("hub.d").alias("hub"))
    star = entries.join(lists, "token").filter("reach >= least and d <> hub").select(F.col("d").alias("a"), F.col("hub").alias("b"), "reach").distinct()
    seen = cut(few(compared(star.select("a", "b"), sets, percent).join(star, ["a", "b"]), size))
    first = seen.filter("linked").select("a", "b")
    labels = components(first, size=size)
    known = seen.join(labels.select(F.col("node").alias("a"), "label"), "a", "left").select(F.col("a").alias("d"), F.col("b").alias("hub"), F.col("na").alias("n"), "both", "reach", "rest", F.coalesce("label", "a").alias("label"))
    counts = known.groupBy("hub", "label").agg(F.count("*").alias("rows"), F.min("n").alias("n"))
    hubs = counts.groupBy("hub").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels"), F.min("n").alias("least")).filter("labels > 1").drop("labels")
    known = cut(few(known.join(hubs, "hub"), size))
    may = (F.col("x.label") != F.col("y.label")) & (F.col("x.n") <= F.col("y.reach")) & (F.col("y.n") <= F.col("x.reach"))
    pair = [F.least("x.d", "y.d").alias("a"), F.greatest("x.d", "y.d").alias("b")]
    need = f"{100 + percent} * {{both}} >= {percent} * (n + least)"
    # Pairs that the hub alone may explain: one of the two is outside the hub's main component.
    enough = known.filter(need.format(both="both"))
    x1, y1 = enough.filter("label <> main").alias("x"), enough.alias("y")
    explained = F.least("x.both", "y.both") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    by_hub = x1.join(y1, (F.col("x.hub") == F.col("y.hub")) & may & explained).select(*pair)
    spread = known.select("hub", "d", "n", "both", "reach", "label", F.explode("rest").alias("more"))
    x2, y2 = spread.alias("x"), spread.alias("y")
    by_rest = x2.join(y2, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.more") == F.col("y.more")) & (F.col("x.d") < F.col("y.d")) & may).select(*pair)
    second = compared(demanded(by_hub.union(by_rest).distinct(), sets), sets, percent).filter("linked").select("a", "b")
    return first.union(cut(few(second, size)))


def labelled(table: DataFrame, percent: int, n_blocks: int, size: int) -> DataFrame:
    """block, place, doc_id, n, component (null: a component of its own), first (the row that stands for
    its set: smallest doc_id, then place), for each document of the blocks."""
    found = described(table, percent, n_blocks, size)
    linked = links(found, percent, size // SHARE)
    labels = components(linked, size=size // SHARE)
    firsts = found.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "block", "place")).alias("first")).withColumnRenamed("digest", "of")
    named = firsts.join(labels.withColumnRenamed("node", "rep"), F.col("first.doc_id") == F.col("rep"), "left").select("of", "first", F.coalesce("label", "first.doc_id").alias("component"))
    return found.select("block", "place", "doc_id", "n", "digest").join(named, F.col("digest") == F.col("of"), "left").drop("digest", "of")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    table = B.packed(few(docs, B.stated_size(docs)))
    n_blocks, size = B.held_in(table)
    found = labelled(table, percent, n_blocks, size)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the near copies: of each component the row of smallest doc_id stays, whole.

    Rows travel inside their blocks; only the places of those that stay are joined to them.
    """
    table, schema = B.packed(few(docs, B.stated_size(docs))), docs.schema
    n_blocks, size = B.held_in(table)
    found = labelled(table, percent, n_blocks, size)
    alone = F.col("component").isNull() | F.col("doc_id").isNull()
    stands = (F.col("component") == F.col("doc_id")) & (F.col("first.block") == F.col("block")) & (F.col("first.place") == F.col("place"))
    staying = found.filter(alone | stands).groupBy("block").agg(F.collect_list("place").alias("places"))  # a block has a bounded number

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("blocks")
        for b in batches:
            for payload, places in zip(b.column("payload"), b.column("places")):
                yield from B.opened(payload.as_py()).take(pa.array(sorted(places.as_py()))).to_batches()

    return table.join(staying, "block").select("payload", "places").mapInArrow(keep, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a budget of words in proportion to their weights, each at most ``max_epochs`` times its
own size, the excess reshared by weight. A source whose target holds e whole epochs takes every
document e times and a fraction more: its documents are sorted by exponential keys -ln(u) / quality,
and the prefix of that order that comes nearest the remaining budget is taken once more.

The order of a source is cut into key ranges of bounded size, which follow from the number of its
documents; each range is sorted in a task of its own and starts from the summed sizes of the ranges
before it. A source with a third of all rows is thus sorted by many tasks. Copies, rows of equal doc_id and
text, are counted into one row first, and as many of them are taken as fit, so neither a document repeated
any number of times nor texts without an id can throw a source off its target.

Defined results: a null text has size 0; null is a source of its own, the last; documents of size 0
are taken 0 words; equal keys go by doc_id; repeated rows count each time, and which of them are taken is
the same in every rerun as far as rows can be told apart; a null doc_id is told by its text; an empty table
gives an empty result; further columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronostrata.llm.lineage import cut

#: Weights of the sources by code point, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2
#: Documents of one source that one task sorts.
RANGE_ROWS = 1_000
#: Tables of a row for each source are broadcast up to so many rows; beyond, a source is dealt over SALTS.
BROADCAST_ROWS, SALTS = 10_000, 16
#: Quality weights are at most 1 and held above this, so that keys of one source spread over its ranges.
LEAST_QUALITY = 0.25
SYMBOLS = "#*$%&|<>"
#: Copies of one document that a task deals out at once.
RUN = 10_000

SPACE_CLASS = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    t = F.btrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_CLASS + "+"))).cast("bigint")


def quality(size: Column, text: Column) -> Column:
    """From 1 down: the further the characters of a word (space included) are from six, and the more of the
    characters are symbols."""
    chars = F.coalesce(F.length(text), F.lit(0))
    per_word = F.coalesce(F.try_divide(chars.cast("double"), size), F.lit(0.0))
    symbols = F.coalesce(F.try_divide((chars - F.length(F.translate(text, SYMBOLS, ""))).cast("double"), chars), F.lit(0.0))
    return F.lit(1.0) / (1.0 + F.abs(per_word - 6.0) / 6.0) / (1.0 + 20.0 * symbols)


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of the md5 of the parts."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def water_filled(sources: DataFrame, share: float, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """source, source_size, source_docs -> with ``target``. One row a source: few against the documents.

    Sources are sorted by the level at which they are full, max_epochs * size / weight. With the k first
    of them full, the others stand at level (budget - caps of the k) / (their weights); the right k is
    the first whose next source is not full at that level.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(max_epochs)).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", F.asc_nulls_last("source"))
    everything = W.partitionBy()
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * share)
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level_here", (F.col("budget") - F.col("caps_before")) / F.col("weights_left"))
    )
    # The level of the first source that is not full when it and all after it share the rest.
    s = s.withColumn("level", F.min(F.when(F.col("full_at") > F.col("level_here"), F.struct("full_at", F.col("level_here").alias("at")))).over(everything)["at"])
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).select("source", "source_size", "source_docs", "target")


def by_source(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with the columns of ``table``, which has one row for each ``source``.

    docs name it ``_source``. A table of few rows is broadcast, after a count. A larger one is repeated SALTS times and the rows
    of a source are dealt over the copies, so that no source is joined by one task.
    """
    table = table.withColumnRenamed("source", "_of")
    if table.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(table), docs["_source"].eqNullSafe(table["_of"])).drop("_of")
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    docs = docs.withColumn("_dealt", F.pmod(F.xxhash64(*(F.col(c) for c in docs.columns if c != "_source")), F.lit(SALTS)).cast("int"))
    return docs.join(table, docs["_source"].eqNullSafe(table["_of"]) & (docs["_dealt"] == table["_salt"])).drop("_of", "_salt", "_dealt")


def measured(docs: DataFrame, seed: int, *others: str) -> DataFrame:
    """docs with _source, _size, _key (the exponential key -ln(u) / quality of the sampling) and _tie, a hash
    of further columns: rows that agree in doc_id and all of these are copies."""
    text = F.col("text").cast("string")
    rows = docs.withColumns({"_source": F.col("source").cast("string"), "_size": word_count(text), "_tie": F.xxhash64(*others) if others else F.lit(0).cast("bigint")})
    q = F.greatest(F.lit(LEAST_QUALITY), quality(F.col("_size"), text))
    return rows.withColumn("_key", -F.log(unit(F.lit(seed), F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))) / q)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for all copies of a document, with their number: checkpointed. Copies are counted before the shuffle."""
    return cut(rows.groupBy("_source", "_key", "doc_id", "_size", "_tie").agg(F.count("*").alias("_copies")))


DOC = ("_key", "doc_id", "_size", "_tie")


def planned(groups: DataFrame, share: float, weights: Sequence[float], max_epochs: int, range_rows: int) -> DataFrame:
    """For each source: source_size, target, epochs; cut, the first document (as DOC) of which not all copies
    are taken once more, and cut_copies, of how many it is; last, a document of which one copy more is."""
    stats = groups.groupBy(F.col("_source").alias("source")).agg(F.sum(F.col("_size") * F.col("_copies")).alias("source_size"), F.count("*").alias("source_docs"))
    targets = cut(
        water_filled(stats, share, weights, max_epochs)
        .withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("source_docs") / range_rows))
        .drop("source_docs")
    )
    # Keys of quality q have the density q * exp(-q * key): ranges that are even for LEAST_QUALITY hold
    # 1 / LEAST_QUALITY times as many of quality 1 at most, whatever the mixture.
    d = by_source(groups, targets).withColumn("range", F.least(F.col("ranges") - 1, F.floor((1.0 - F.exp(-LEAST_QUALITY * F.col("_key"))) * F.col("ranges"))).cast("bigint"))
    words = F.col("_size") * F.col("_copies")
    sums = d.groupBy("_source", "range").agg(F.sum(words).alias("in_range"))
    before = sums.select(
        F.col("_source").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("in_range").over(W.partitionBy("_source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    d = d.join(before, d["_source"].eqNullSafe(before["of"]) & (d["range"] == before["at"])).drop("of", "at")
    ahead = F.col("before") + F.coalesce(F.sum(words).over(W.partitionBy("_source", "range").orderBy(*DOC).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    fit = F.when(F.col("_size") > 0, F.floor((F.col("rest") - ahead) / F.col("_size"))).otherwise(F.when(ahead <= F.col("rest"), F.col("_copies")).otherwise(0))
    d = cut(d.withColumn("fit", F.greatest(F.lit(0), F.least("_copies", fit)).cast("bigint")).select("_source", "rest", "fit", "_copies", F.struct(*DOC).alias("doc")))
    prefix = d.groupBy("_source").agg((F.min("rest") - F.sum(F.col("fit") * F.col("doc._size"))).alias("gap"), F.min(F.when(F.col("fit") < F.col("_copies"), F.struct("doc", "fit"))).alias("cut"))
    prefix = cut(prefix.withColumnRenamed("_source", "source"))
    # The prefix stops short of its budget by less than one document: the one document whose size is
    # nearest the gap joins it, if that is nearer the budget than none.
    off = F.abs(F.col("gap") - F.col("doc._size"))
    nearest = by_source(d.filter((F.col("fit") < F.col("_copies")) & (F.col("doc._size") > 0)), prefix).filter(off < F.col("gap")).groupBy(F.col("_source").alias("source"))
    last = nearest.agg(F.min(F.struct(off.alias("off"), "doc")).alias("x")).select("source", F.col("x.doc").alias("last"))
    plan = targets.select("source", "source_size", "target", "epochs").alias("t").join(prefix.alias("p"), F.col("t.source").eqNullSafe(F.col("p.source")), "left")
    plan = plan.select("t.*", F.col("cut.doc").alias("cut"), F.col("cut.fit").alias("cut_copies")).alias("t").join(last.alias("l"), F.col("t.source").eqNullSafe(F.col("l.source")), "left")
    return cut(plan.select("t.*", "last"))


def decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with _source and DOC) with source_size, target, epochs and, of the copies of their document,
    _more: how many are taken once more than epochs (null: all)."""
    doc = F.struct(*DOC)
    one = F.when(F.col("last").isNotNull() & doc.eqNullSafe(F.col("last")), 1).otherwise(0)
    more = F.when(F.col("cut").isNull() | (doc < F.col("cut")), F.lit(None)).when(doc.eqNullSafe(F.col("cut")), F.col("cut_copies") + one).otherwise(one)
    return by_source(rows, plan).withColumn("_more", more.cast("bigint")).drop("cut", "cut_copies", "last")


def dealt(rows: DataFrame, count: str, at: str) -> DataFrame:
    """Each row ``count`` times, numbered in ``at`` from 0. Rows of many copies go out in runs over all tasks."""
    runs = lambda n: F.sequence(F.lit(0).cast("bigint"), n)
    few = rows.filter(F.col(count).between(1, RUN)).withColumn(at, F.explode(runs(F.col(count) - 1)))
    many = rows.filter(F.col(count) > RUN).withColumn("_run", F.explode(runs(F.floor((F.col(count) - 1) / RUN))))
    many = many.repartition("_run").withColumn(at, F.explode(F.sequence(F.col("_run") * RUN, F.least(F.col(count), (F.col("_run") + 1) * RUN) - 1)))
    return few.unionByName(many.drop("_run"))


def mix(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken; one row for each document."""
    groups = groups_of(measured(docs.select("doc_id", "text", "source"), seed))
    d = dealt(decided(groups, planned(groups, share, weights, max_epochs, range_rows)), "_copies", "_copy")
    times = F.col("epochs") + F.when(F.col("_more").isNull() | (F.col("_copy") < F.col("_more")), 1).otherwise(0)
    taken = F.col("_size") * F.least(times, F.lit(max_epochs))
    return d.select("doc_id", F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed(docs: DataFrame, share: float = SHARE, weights: Sequence[float] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixture itself: every row of docs as often as it is taken. Texts are not shuffled: a row tells
    from its key and the plan of its source whether it is in. Only of a document of which some copies are
    taken and others not, one of its equal rows is picked and dealt out as often as all of them together."""
    others = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]

    def told_apart(d: DataFrame) -> DataFrame:
        slim = d.select("doc_id", "text", "source", *(F.col(c).alias(f"_c{i}") for i, c in enumerate(others)), F.struct(*docs.columns).alias("_row"))
        return measured(slim, seed, *(f"_c{i}" for i in range(len(others)))).select("_source", *DOC, "_row")

    plan = planned(groups_of(told_apart(docs).drop("_row")), share, weights, max_epochs, range_rows)
    times = F.least(F.col("epochs") + F.when(F.col("_more").isNull(), 1).otherwise(0), F.lit(max_epochs)).cast("int")
    whole = decided(told_apart(docs), plan).filter("_more is null or _more = 0").withColumn("_times", times).filter("_times > 0")
    whole = whole.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    # One or two documents a source; the rest of the table is passed over by its ids.
    ids = plan.select(F.col("cut.doc_id").alias("_id"), F.col("cut").isNotNull().alias("_there")).union(plan.select("last.doc_id", F.col("last").isNotNull())).filter("_there").select("_id").distinct()
    near = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    partly = decided(told_apart(near), plan).filter("_more > 0").groupBy("_source", *DOC, "epochs", "_more").agg(F.first("_row").alias("_row"), F.count("*").alias("_n"))
    partly = partly.select("_row", (F.col("epochs") * F.col("_n") + F.least("_more", "_n")).alias("_times"))
    return whole.select("_row.*").unionByName(dealt(partly, "_times", "_copy").select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def _oracle() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
with recursive d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as bigint) as size, length(coalesce(text, '')) as chars from documents),
k as (select rid, doc_id, source, size, -ln((cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(text)), 1, 12) as bigint) + 0.5::double) / 281474976710656::double)
      / greatest({LEAST_QUALITY}::double, 1::double / (1::double + abs(coalesce(chars::double / nullif(size, 0), 0::double) - 6::double) / 6::double)
        / (1::double + 20::double * coalesce((chars - length(translate(text, '{SYMBOLS}', '')))::double / nullif(chars, 0), 0::double))) as key from d),
s as (select source, cast(sum(size) as bigint) as source_size, [{weights}][1 + (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}]::double as weight from d group by source),
c as (select source, source_size, weight, {MAX_EPOCHS}::double * source_size as cap from s),
o as (select *, ({SHARE}::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level_here from c),
l as (select min(cap / weight) as full_at, arg_min(level_here, cap / weight) as level from o where cap / weight > level_here),
t as (select o.source, source_size, least(cap, coalesce(level * weight, cap)) as target from o, l),
e as (select *, coalesce(floor(target / nullif(source_size, 0)), 0) as epochs from t),
p as (select k.rid, k.doc_id, k.source, size, key, source_size, target, epochs, target - epochs * source_size as rest,
      sum(size) over (partition by k.source order by key, doc_id, size, rid rows unbounded preceding) <= target - epochs * source_size as chosen from k join e on k.source is not distinct from e.source),
g as (select source, min(rest) - coalesce(sum(size) filter (chosen), 0) as gap from p group by source),
n as (select p.rid, p.source, row_number() over (partition by p.source order by abs(gap - p.size), key, doc_id, p.size, p.rid) as r from p join g on p.source is not distinct from g.source where not chosen and p.size > 0 and abs(gap - p.size) < gap)
select p.doc_id, p.size, p.source_size, p.target, cast(p.size * least(epochs + case when chosen or n.rid is not null then 1 else 0 end, {MAX_EPOCHS}) as bigint) as taken
from p left join n on n.r = 1 and p.rid = n.rid"""


ORACLE = _oracle()

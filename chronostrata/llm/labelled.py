"""A bounded sample of labelled documents for fitting, and what classifiers share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was that for on with as by at from this it be",
    "de": "der die das und den von zu mit ist auf für im des ein eine dem sich",
    "fr": "le la les des et en un une que qui pour dans est du par au",
    "es": "el los las y del se por con al una de la que en",
}


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Sample:
    texts: list[bytes]
    y: np.ndarray
    weight: np.ndarray  # labelled rows that a sampled row stands for


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], most_chars: int) -> Sample:
    """At most about most[c] texts of each class c outside the held-out fold, none above most_chars.

    Rows are chosen by a hash of their id, so reruns agree; classes with fewer rows give them all.
    The bound is 1.2 * sum(most) * most_chars characters on the driver.
    """
    seen = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isin(*most) & ~held_out(F.col("doc_id")))
    counts = {r["y"]: r["n"] for r in seen.groupBy("y").agg(F.count("*").alias("n")).collect()}
    part = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1 << 30)) / float(1 << 30)
    kept = F.lit(False)
    for c, n in most.items():
        kept = kept | ((F.col("y") == c) & (part < n / max(1, counts.get(c, 0))))
    # A number of rows bounded by the parameters is broadcast.
    chosen = seen.filter(kept).limit(int(1.2 * sum(most.values())))
    rows = docs.select("doc_id", "text").filter(F.length("text") <= most_chars).join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("o")).limit(int(1.2 * sum(most.values()))).toPandas()
    rows = rows.sort_values(["o", "text"])
    y = rows["y"].to_numpy(np.int64)
    weight = np.array([counts.get(c, 0) / max(1, int((y == c).sum())) for c in y.tolist()], float)
    return Sample([t.encode("utf-8") for t in rows["text"]], y, weight)

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown in numpy on binned statistics of a bounded sample of labelled documents, level by
level, and flattened into arrays (feature, threshold, value by heap position), so that a batch of
documents goes down all trees by indexing alone. Scoring reads whole texts.

Defined results: a null or empty text has statistics of zero and scores as such; without labels of
both classes every score is the share of class 1 (0 without labels); repeated rows score alike; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm import words as W
from chronostrata.llm import workers
from chronostrata.llm.labelled import FUNCTION_WORDS, held_out, sample
from chronostrata.llm.lineage import ship

#: Bounds on the rows to fit on, by class, and on the characters of each.
GOOD, BAD, MOST_CHARS = 6_000, 6_000, 12_000
TREES, DEPTH, BINS, RATE, LEAST_WEIGHT, SHRINK = 80, 4, 64, 0.15, 5.0, 1.0
ACCEPT = 0.3

CLASSES = {
    "symbols": b"#*$%&|<>",
    "digits": b"0123456789",
    "capitals": bytes(range(65, 91)),
    "sentence marks": b".,;:?'\"()-",
    "exclamation marks": b"!",
    "bars": b"|",
    "beyond ASCII": bytes(range(128, 256)),
    "slashes and at-signs": b"/\\@=_",
}
NAMES = (
    "bytes", "words", "mean word", "longest word", "spread of words", "lines", "words a line", "repeated lines",
    "distinct words", "repeated windows", "function words", "same word again", "commonest word", *CLASSES,
)


def _hash_of(word: str) -> int:
    data, _ = W.joined([word.encode("utf-8")])
    return int(W.hashed(data, *W.boundaries(data), True)[0])


KNOWN = np.unique(np.array([_hash_of(w) for v in FUNCTION_WORDS.values() for w in v.split()], np.uint64))
_tables = [np.isin(np.arange(256), list(c)) for c in CLASSES.values()]


def statistics(texts: Sequence[bytes]) -> np.ndarray:
    """One row of NAMES for each text."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, j in W.pieces(texts):
        data, at = W.joined(texts[i:j])
        starts, ends = W.boundaries(data)
        doc = np.searchsorted(starts, at)
        h = W.hashed(data, starts, ends, True)
        size = (ends - starts).astype(float)
        known = np.concatenate([[0], np.cumsum(np.isin(h, KNOWN))])
        again = np.concatenate([[0], np.cumsum(np.concatenate([[False], h[1:] == h[:-1]]))]) if len(h) else np.zeros(1)
        win = W.windows(h, 5)
        line_ends = np.flatnonzero(data == 10)
        line_starts = np.concatenate([[0], line_ends[:-1] + 1])
        lines = W.hashed(data, line_starts, line_ends)
        line_at = np.searchsorted(line_starts, at)
        wordy = line_ends > line_starts
        n_bytes = np.maximum(np.diff(at) - 1, 1)
        for k, t in enumerate(_tables):
            counts = np.add.reduceat(t[data].astype(np.int32), at[:-1])
            out[i:j, 13 + k] = counts / n_bytes
        for k, (a, b) in enumerate(zip(doc[:-1].tolist(), doc[1:].tolist())):
            row, n = out[i + k], b - a
            own = lines[line_at[k] : line_at[k + 1]][wordy[line_at[k] : line_at[k + 1]]]
            row[0], row[1], row[5] = np.log1p(n_bytes[k]), np.log1p(n), np.log1p(len(own))
            if not n:
                continue
            s = size[a:b]
            row[2], row[3], row[4], row[6] = s.mean(), s.max(), s.std(), n / max(1, len(own))
            row[7] = 1 - len(np.unique(own)) / max(1, len(own))
            counts = np.unique(h[a:b], return_counts=True)[1]
            row[8], row[12] = len(counts) / n, counts.max() / n
            row[9] = 1 - len(np.unique(win[a : b - 4])) / (n - 4) if n > 5 else 0
            row[10], row[11] = (known[b] - known[a]) / n, (again[b] - again[a]) / n
    return out


@dataclass
class Forest:
    """Trees in heap order: the children of node k are 2k + 1 and 2k + 2; leaves are the last level."""

    feature: np.ndarray  # [trees, 2**depth - 1]
    threshold: np.ndarray
    value: np.ndarray  # [trees, 2**depth]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            total += v[at - inner]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Boosting of the weighted log loss."""
    n, m = x.shape
    share = float((weight * y).sum() / weight.sum()) if n else 0.0
    inner = 2**DEPTH - 1
    if not 0 < share < 1:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), 30.0 if share else -30.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1])) for k in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    weight = weight / weight.mean()
    base = float(np.log(share / (1 - share)))
    total = np.full(n, base)
    feature, threshold, value = (np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1)))
    for tree in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, nodes = 2**depth - 1, 2**depth
            best = np.full(nodes, 1e-6)
            gs, hs = np.bincount(at - first, g, nodes), np.bincount(at - first, h, nodes)
            for k in range(m):
                if not len(edges[k]):
                    continue
                key = (at - first) * BINS + binned[:, k]
                gl = np.bincount(key, g, nodes * BINS).reshape(nodes, BINS).cumsum(1)[:, : len(edges[k])]
                hl = np.bincount(key, h, nodes * BINS).reshape(nodes, BINS).cumsum(1)[:, : len(edges[k])]
                gain = gl**2 / (hl + SHRINK) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + SHRINK) - (gs**2 / (hs + SHRINK))[:, None]
                gain[(hl < LEAST_WEIGHT / 4) | (hs[:, None] - hl < LEAST_WEIGHT / 4)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(nodes), top] > best
                best = np.where(better, gain[np.arange(nodes), top], best)
                feature[tree, first : first + nodes][better] = k
                threshold[tree, first : first + nodes][better] = edges[k][top[better]]
            at = 2 * at + 1 + (x[np.arange(n), feature[tree][at]] > threshold[tree][at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        value[tree] = -RATE * gs / (hs + SHRINK)
        total += value[tree][at - inner]
    return Forest(feature, threshold, value, base)


def train(docs: DataFrame, labels: DataFrame) -> Forest:
    s = sample(docs, labels, "quality", {1: GOOD, 0: BAD}, MOST_CHARS)
    return grow(statistics(s.texts), s.y.astype(float), s.weight)


def scored(docs: DataFrame, forest: Forest, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    names, shared = schema.names, docs.sparkSession.sparkContext.broadcast(forest)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("quality_classifier")
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                s = b.slice(i, 1000)
                texts = [(t or "").encode("utf-8") for t in s.column(s.schema.get_field_index(text)).to_pylist()]
                values = pa.array(shared.value.scores(statistics(texts)), pa.float64())
                yield pa.RecordBatch.from_arrays([values if n == out else s.column(s.schema.get_field_index(n)) for n in names], names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))

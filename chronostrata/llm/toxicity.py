"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4 to 7 bytes; filters over one, two
and three words are max-pooled over the whole text into a logistic output. The threshold is calibrated
for each language, which is told from the function words of the text itself, and the score is bent so
that the threshold stands at 0.5. Features that fewer than three sampled texts have count as absent.

Fitting reads a sample bounded by POSITIVES, NEGATIVES and MOST_CHARS; scoring reads whole texts, in
batches, and keeps nothing between them.

Defined results: a null or empty text has no words and scores as such; without labels of both classes
every score is 0; repeated rows score alike; an empty table gives an empty result; further columns
are ignored by the query and passed on by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronostrata.llm import words as W
from chronostrata.llm import workers
from chronostrata.llm.labelled import FUNCTION_WORDS, held_out, sample
from chronostrata.llm.lineage import ship
from chronostrata.llm.names import fresh

#: Bounds on the rows to fit on, by class, and on the characters of each.
POSITIVES, NEGATIVES, MOST_CHARS = 3_000, 6_000, 8_000
BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 12, 16, (1, 2, 3)
PREFIXES = (4, 5, 6, 7)
EPOCHS, BATCH, RATE = 6, 64, 0.08
#: Part of the words that a text loses in each epoch, so that every telling word is learnt, not the loudest alone.
DROPPED = 0.5
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PAD = max(SPANS) - 1


def features(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids [words and padding, 1 + prefixes], where each text's rows begin, and its language.

    Bucket 0 is the absent feature. After the words of each text stand PAD absent rows.
    """
    data, at = W.joined(texts)
    starts, ends = W.boundaries(data, PUNCTUATION)
    doc = np.searchsorted(starts, at)
    n, rows = len(starts), np.arange(len(starts)) + PAD * (np.searchsorted(at, starts, "right") - 1)
    ids = np.zeros((n + PAD * len(texts), 1 + len(PREFIXES)), np.int32)
    whole = W.hashed(data, starts, ends, True)
    for k, size in enumerate((None, *PREFIXES)):
        if size is None:
            ids[rows, k] = 1 + whole % np.uint64(BUCKETS - 1)
        else:
            long = ends - starts > size
            cut = np.minimum(starts + size, ends)
            h = W.mixed(W.hashed(data, starts, cut, True) + np.uint64(size))
            ids[rows[long], k] = 1 + h[long] % np.uint64(BUCKETS - 1)
    votes = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(doc))
    for k, known in enumerate(LANGUAGES.values()):
        votes[:, k] = np.bincount(owner[np.isin(whole, known)], minlength=len(texts))
    language = np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGUAGES))
    return ids, doc + PAD * np.arange(len(texts) + 1), language


def _hash_of(word: str) -> int:
    data, _ = W.joined([word.encode("utf-8")])
    return int(W.hashed(data, *W.boundaries(data), True)[0])


LANGUAGES = {k: np.array([_hash_of(w) for w in v.split()], np.uint64) for k, v in FUNCTION_WORDS.items()}


def responses(x: np.ndarray, f: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The response of a filter at each row; minus infinity where it would reach into the next text."""
    z = x @ f[0]
    for k in range(1, len(f)):
        z[:-k] += x[k:] @ f[k]
    ends = np.append(starts[1:], len(x))
    for k in range(1, len(f)):
        z[ends - k] = -np.inf
    return z


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # [span, width, filters]
    bias: np.ndarray
    out: np.ndarray
    constant: float
    thresholds: list[float] = field(default_factory=lambda: [0.5] * (len(LANGUAGES) + 1))
    fitted: bool = True

    def pooled(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The largest response of each filter within each text (before the bias)."""
        return np.concatenate([np.maximum.reduceat(responses(x, f, starts), starts, axis=0) for f in self.filters], 1)

    def raw(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = self.embedding[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embedding[ids[:, k]]
        h = np.maximum(self.pooled(x, starts) + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.constant, -30, 30)))

    def scores(self, texts: Sequence[bytes]) -> np.ndarray:
        """Scores of whole texts, 0.5 at the threshold of the language."""
        if not self.fitted:
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for i, j in W.pieces(texts):
            ids, at, language = features(texts[i:j])
            p, t = self.raw(ids, at[:-1]), np.array(self.thresholds)[language]
            out[i:j] = np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / np.maximum(1 - t, 1e-9))
        return np.clip(out, 0, 1)


def fit(texts: Sequence[bytes], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent with Adagrad; every fifth text only calibrates the thresholds."""
    rng = np.random.default_rng(seed)
    size = FILTERS * len(SPANS)
    model = Model(rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), [rng.normal(0, 0.5 / np.sqrt(WIDTH * s), (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS], np.full(size, 0.05, np.float32), rng.normal(0, 0.3, size).astype(np.float32), 0.0)
    if len(set(y.tolist())) < 2:
        model.fitted = False
        return model
    ids, at, language = [], [0], []
    for i, j in W.pieces(texts):
        a, b, c = features(texts[i:j])
        ids.append(a)
        at.extend((b[1:] + at[-1]).tolist())
        language.append(c)
    ids, at, language = np.concatenate(ids), np.array(at), np.concatenate(language)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    for k in range(ids.shape[1]):  # features of fewer than three texts count as absent
        pairs = np.unique(owner * BUCKETS + ids[:, k])
        rare = np.bincount(pairs % BUCKETS, minlength=BUCKETS) < 3
        ids[rare[ids[:, k]], k] = 0
    used = np.zeros(BUCKETS, bool)
    used[ids] = True
    used[0] = False
    model.embedding[~used] = 0
    n = len(texts)
    train, check = np.flatnonzero(np.arange(n) % 5 > 0), np.flatnonzero(np.arange(n) % 5 == 0)
    sums = {k: 1e-2 for k in ("e", "b", "o", "c")} | {f"f{k}": 1e-2 for k in range(len(SPANS))}
    sums["e"] = np.full(BUCKETS, 1e-2, np.float32)

    def move(name: str, value: np.ndarray, g: np.ndarray) -> None:
        sums[name] = sums[name] + g * g
        value -= RATE * g / np.sqrt(sums[name])

    balance = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * n
    for epoch in range(EPOCHS):
        order = rng.permutation(train)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            rows = np.concatenate([np.arange(at[d], at[d + 1]) for d in batch])
            starts = np.cumsum([0, *(at[batch + 1] - at[batch])])
            own = ids[rows] * (rng.random(len(rows)) >= DROPPED)[:, None]
            x = model.embedding[own].sum(1)
            tops, places = [], []
            for f in model.filters:
                z = responses(x, f, starts[:-1])
                top = np.array([z[a:b].argmax(0) + a for a, b in zip(starts[:-1], starts[1:])])
                places.append(top)
                tops.append(np.take_along_axis(z, top, 0))
            h = np.maximum(np.concatenate(tops, 1) + model.bias, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ model.out + model.constant, -30, 30)))
            d = ((p - y[batch]) * balance[batch] / len(batch)).astype(np.float32)
            dh = np.outer(d, model.out) * (h > 0)
            dx, at_rows = [], []
            for k, (f, top) in enumerate(zip(model.filters, places)):
                g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                df = np.zeros_like(f)
                for s in range(len(f)):
                    inside = top + s < len(x)
                    where = np.where(inside, top + s, 0)
                    gs = g * inside
                    df[s] = np.einsum("bfw,bf->wf", x[where], gs)
                    dx.append((gs[:, :, None] * f[s].T[None]).reshape(-1, WIDTH))
                    at_rows.append(where.reshape(-1))
                move(f"f{k}", f, df + 1e-4 * f)
            move("o", model.out, h.T @ d + 1e-4 * model.out)
            move("b", model.bias, dh.sum(0))
            sums["c"] += float(d.sum()) ** 2
            model.constant -= RATE * float(d.sum()) / sums["c"] ** 0.5
            dx, at_rows = np.concatenate(dx), np.concatenate(at_rows)
            live = np.abs(dx).max(1) > 0
            dx, at_rows = dx[live], at_rows[live]
            touched, inverse = np.unique(own[at_rows].reshape(-1), return_inverse=True)
            g = np.zeros((len(touched), WIDTH), np.float32)
            np.add.at(g, inverse, np.repeat(dx, own.shape[1], axis=0))
            g[touched == 0] = 0
            sums["e"][touched] += (g * g).mean(1)
            model.embedding[touched] -= RATE * g / np.sqrt(sums["e"][touched])[:, None]
    p = np.concatenate([model.raw(ids[at[a] : at[b]], at[a:b] - at[a]) for a, b in ((i, min(i + 256, n)) for i in range(0, n, 256))])
    overall = best_threshold(p[check], y[check], weight[check], 0.5)
    for k in range(len(LANGUAGES) + 1):
        own = check[language[check] == k]
        enough = (y[own] == 1).sum() >= 15 and (y[own] == 0).sum() >= 15
        model.thresholds[k] = best_threshold(p[own], y[own], weight[own], overall) if enough else overall
    return model


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray, otherwise: float) -> float:
    """The middle of the gap at which the weighted F1 of class 1 is greatest."""
    if not (y == 1).any():
        return otherwise
    order = np.argsort(-p, kind="stable")
    p, y, weight = p[order], y[order], weight[order]
    hits, taken = np.cumsum(weight * y), np.cumsum(weight)
    f1 = 2 * hits / (taken + (weight * y).sum())
    f1[:-1][p[:-1] == p[1:]] = -1
    k = int(f1.argmax())
    low = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + low) / 2, 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    s = sample(docs, labels, "toxic", {1: POSITIVES, 0: NEGATIVES}, MOST_CHARS)
    return fit(s.texts, s.y, s.weight)


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of every whole text."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    names, shared = schema.names, docs.sparkSession.sparkContext.broadcast(model)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.claim("toxicity")
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                s = b.slice(i, 1000)
                texts = [(t or "").encode("utf-8") for t in s.column(s.schema.get_field_index(text)).to_pylist()]
                values = pa.array(shared.value.scores(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([values if n == out else s.column(s.schema.get_field_index(n)) for n in names], names)

    ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score below 0.5."""
    score = fresh(docs.columns, "_toxicity")
    return scored(docs, model, out=score).filter(F.col(score) < 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""The corpus pipeline: five operators over documents, each working on what the one before kept.

1. Toxicity: documents that the classifier rejects go. It learns from the labels of documents that are
   still there, outside the held-out fold.
2. N-gram Jaccard join: one document of each group of near copies stays.
3. Secret scans: secrets, however encoded, are replaced by their kind; n_chars follows.
4. Mixing: sources are brought to their target weights; documents repeat by whole epochs, and a
   fraction is taken once more or not at all.
5. Byte-level BPE: texts become token ids, and ``exact`` tells that they decode to the text again.

Stages 1 to 4 return the columns of documents. A stage takes any rows, nulls in any column, repeated
rows and further columns included; each operator's docstring gives the results. SQL cannot express the
classifier, the decoding worklist or the tokenizer, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.llm import byte_bpe, jaccard_join, mixing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = byte_bpe.round_trip(docs.select("doc_id", "text", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("mixing_sources", mix_sources),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs

"""Held-out accuracy on the driver's labels."""

from pyspark.sql import functions as F

from chronostrata.llm import quality_classifier, toxicity

FOLDER = "/root/testdata/sf0.1"


def held_out(spark, query, label):
    out = query(spark, FOLDER).filter("held_out").join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id")
    rows = out.select("score", "predicted", F.col(label).alias("y")).collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return rows


def test_toxicity(spark):
    rows = held_out(spark, toxicity.query, "toxic")
    hit = sum(r["predicted"] and r["y"] for r in rows)
    assert hit / sum(r["y"] for r in rows) > 0.8 and hit / max(1, sum(r["predicted"] for r in rows)) > 0.9


def test_quality(spark):
    rows = held_out(spark, quality_classifier.query, "quality")
    assert sum(r["predicted"] == r["y"] for r in rows) / len(rows) > 0.97
    assert sum(r["predicted"] and not r["y"] for r in rows) / max(1, sum(not r["y"] for r in rows)) < 0.1

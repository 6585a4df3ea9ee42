import re

import corpus_pipeline
from chronostrata.llm import quality_rules  # noqa: F401
from docs import clashing, documents, empty

FOLDER = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages_on_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
        if name == "ngram_jaccard_join":
            sets = [shingles(r["text"]) for r in after]
            assert not any(x and y and 100 * len(x & y) >= 75 * len(x | y) for i, x in enumerate(sets) for y in sets[:i])
    assert after and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_stages_take_odd_rows(spark):
    for docs in (documents(spark), clashing(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).filter("not exact").count() == 0


def test_clean_documents_stay_and_secrets_go(spark):
    words = [f"word{k} stone{k * 7} light{k * 13} river{k * 3} tree{k}" for k in range(40)]
    rows = [(k, " ".join(words[k : k + 5]) + f" note {k}", "en", "s", None) for k in range(30)]
    rows += [(100, " ".join(words[30:36]) + " password=hunter2secret", "en", "s", None)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    kept = corpus_pipeline.STAGES[2][1](spark, docs, FOLDER).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in rows}
    assert next(r["text"] for r in kept if r["doc_id"] == 100).endswith("[assign]")
    assert {r["doc_id"]: r["text"] for r in kept if r["doc_id"] < 100} == {r[0]: r[1] for r in rows if r[0] < 100}

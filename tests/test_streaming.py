import random

from chronostrata.streaming import progress


def brute(rows):
    last, delivered, at0, out = {}, {}, {}, []
    for k, o, n, t, at in sorted(rows):
        if n < 0 or n > t or n < last.get(k, -1):
            continue
        start = last.get(k, -1) <= 0
        last[k] = n
        if start or n >= t or n - delivered.get(k, 0) >= max(1, -(-t // 20)) or at - at0.get(k, -(1 << 60)) >= 50:
            delivered[k], at0[k] = n, at
            out.append((k, o, n, t, at))
    return sorted(out)


def rows():
    random.seed(4)
    return [(k, i, random.randrange(0, 120) if random.random() < 0.1 else i * 2, 100, i * 13) for k in range(5) for i in range(60)]


SCHEMA = "k long, o long, n long, t long, at long"


def test_coalesced_batch(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    assert sorted(map(tuple, progress.coalesced(df, "k", "o", "n", "t", "at").collect())) == brute(rows())


def stream(spark, folder, parts, schema):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_coalesced_stream(spark, tmp_path):
    data = rows()
    got = run(progress.coalesced_stream(stream(spark, tmp_path / "in", [data], SCHEMA), "k", "o", "n", "t", "at"), "coalesced")
    assert sorted(map(tuple, got)) == brute(data)


def test_late_spans_are_refused(spark, tmp_path):
    schema = "k long, o long, s long, n long"
    parts = [[(1, 0, 0, 4), (1, 1, 6, 2), (2, 0, 3, 3)], [(1, 2, 7, 5), (2, 1, 6, 1)]]
    got = run(progress.ingested_stream(stream(spark, tmp_path / "in", parts, schema), "k", "o", "s", "n"), "ingested")
    assert {r["status"] for r in got if r["k"] == 2} == {"stored"}
    assert [r["status"] for r in sorted(got, key=lambda r: r["s"]) if r["k"] == 1][-1] == "late"


def test_rows_of_a_batch_come_in_any_order(spark, tmp_path):
    """5,000 sound spans of one key, unordered in 8 files of one micro-batch and in many frames."""
    random.seed(9)
    rows = [(1, i, i * 10, 5) for i in range(5000)]
    random.shuffle(rows)
    schema = "k long, o long, s long, n long"
    for i in range(8):
        spark.createDataFrame(rows[i::8], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = run(progress.ingested_stream(df, "k", "o", "s", "n"), "unordered")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((r["o"], r["packed_offset"], r["status"]) for r in got) == [(i, i * 5, "stored") for i in range(5000)]

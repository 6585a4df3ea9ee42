from collections import defaultdict

from pyspark.sql import functions as F

from chronostrata.operators import pump, store


def test_every_pass_has_each_live_source_once_and_begins_one_further(spark):
    sources = [(k, k, 100 + 60 * k, 10 * k) for k in range(7)]
    df = spark.createDataFrame(sources, "source long, pos long, frames long, cursor long")
    passes = defaultdict(list)
    for r in pump.commits(df, "source", "frames", "cursor", 64, F.lit(1).cast("bigint")).collect():
        passes[r["pass"]].append((r["turn"], r["source"], r["start_frame"], r["frames"], r["end_of_region"]))
    cursor, frames, begin = {k: c for k, _, _, c in sources}, {k: n for k, _, n, _ in sources}, 0
    for p in range(len(passes)):
        want = []
        for step in range(7):
            k = (begin + step) % 7
            if cursor[k] < frames[k]:
                n = min(64, frames[k] - cursor[k])
                want.append((step, k, cursor[k], n, cursor[k] + n == frames[k]))
                cursor[k] += n
        assert sorted(passes[p]) == want
        begin = (begin + 1) % 7
    assert cursor == frames


def test_turns_of_reads_do_not_collide(spark):
    states = spark.range(1500).selectExpr("id as pos", "0 as has_window", "1 as occupancy")
    assert [r["pos"] for r in store.read_order(states, 17, 4).collect()] == [17, 18, 19, 20]

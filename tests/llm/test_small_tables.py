"""Every operator on the odd cases, against brute force written without the library."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from chronostrata.llm import byte_bpe, jaccard_join, lineage, lm_scoring, mixing, quality_classifier, quality_rules, secrets, sharding, toxicity
from chronostrata.llm.registry import ORACLES, QUERIES
from docs import clashing, documents, empty, rows

SPACE = "[^\x20\x09-\x0d]+"


def words(t):
    return re.findall(SPACE, t or "")


def by_row(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(request, spark):
    return (documents if request.param == "plain" else clashing)(spark)


def base_counts(t):
    w, t = words(t), t or ""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    got = by_row(quality_rules.quality_rules(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter()
    for d, t, *_ in rows():
        c = base_counts(t)
        want[(d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert got == want


def test_quality_rules_kept_implies_base(docs):
    assert quality_rules.quality_rules(docs).filter("kept and base_failed").count() == 0


def test_byte_bpe(docs):
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(path), special_tokens={})
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in byte_bpe.decode(byte_bpe.encode(docs)).select("doc_id", "ids", "decoded").collect())
    assert got == Counter((d, tuple(own.encode_ordinary(t or "")), t or "") for d, t, *_ in rows())


def test_round_trip_in_one_pass(docs):
    two, one = byte_bpe.decode(byte_bpe.encode(docs)), byte_bpe.round_trip(docs)
    read = lambda df: Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in df.collect())
    assert one.columns == two.columns and read(one) == read(two)


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    size = {}
    for d, t, _, s, _ in rows():
        size[s] = size.get(s, 0) + len(words(t))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, len(words(t))) for d, t, _, s, _ in rows())
    assert all(r["source_size"] == size[r["source"]] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    order = sorted((s for s in size if s is not None)) + [None]
    weight, left, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(size.values()), {}
    open_ = set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * size[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        open_ -= over
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in out)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_mixed_repeats_rows(docs):
    taken = Counter({d: 0 for d, *_ in rows()})
    for r in mixing.mix(docs).collect():
        if r["size"]:
            taken[r["doc_id"]] += r["taken"] // r["size"]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect() if words(r["text"]))
    assert got == +taken


COPIES = {
    "equal rows": [(7, "a b c d e", "s") for _ in range(101)] + [(k, "f " * (k % 9), "t") for k in range(50)],
    "null ids": [(None, f"{k} " * (1 + k % 12), "s") for k in range(100)] + [(k, "f " * (1 + k % 9), "t") for k in range(200)],
    "copies under other ids": [(k, "same text here", "s") for k in range(150)] + [(k, "x " * (1 + k % 5), None) for k in range(300)],
}


@pytest.mark.parametrize("run", [mixing.RUN, 10])
@pytest.mark.parametrize("name", COPIES)
def test_taken_words_come_near_the_target(spark, name, run, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", run)
    df = spark.createDataFrame(COPIES[name], "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(df).collect()
    assert len(out) == len(COPIES[name])
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    largest = max(len(words(t)) for _, t, _ in COPIES[name])
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    got = Counter()
    for r in mixing.mixed(df).collect():
        got[r["source"]] += len(words(r["text"]))
    assert got == +taken


def test_ranges_are_bounded_for_any_quality(spark):
    from pyspark.sql import functions as F

    rows = spark.range(200000).withColumn("q", F.when(F.col("id") % 3 == 0, mixing.LEAST_QUALITY).otherwise(1.0)).withColumn("key", -F.log(mixing.unit(F.lit(0), F.col("id"))) / F.col("q"))
    at = F.floor((1.0 - F.exp(-mixing.LEAST_QUALITY * F.col("key"))) * 200)
    assert rows.groupBy(at.alias("at")).count().agg(F.max("count")).first()[0] < 1.2 * 1000 / mixing.LEAST_QUALITY


def test_secrets_on_documents(docs):
    out = secrets.scanned(docs)
    assert by_row(out, "doc_id", "_base") == Counter((d, "") for d, *_ in rows())
    assert secrets.redact(docs).columns == docs.columns


def test_jaccard_join(docs):
    got = by_row(jaccard_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id")
    sets = []
    for d, t, *_ in rows():
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    label = {d: d for d, _ in sets if d is not None}
    for _ in sets:
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == Counter((d, len(x), None if d is None else label[d]) for d, x in sets)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_that_a_sum_of_powers_cannot_tell_apart(spark):
    for n in (64, 1024, 2048, 4096):
        a = thue_morse(n)
        b = a.translate(str.maketrans("ab", "ba"))
        x, y = ("one two three four " + w + " six seven eight nine ten" for w in (a, b))
        (p,), (q,) = jaccard_join.W.shingle_sets([x.encode()]), jaccard_join.W.shingle_sets([y.encode()])
        assert len(np.intersect1d(p, q)) == 1  # the shingle of the last five words
    df = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()} == {(1, 1), (2, 2)}


def linked_by_brute_force(texts, percent=75):
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in texts)}
    label = {d: d for d in sets}
    where = defaultdict(set)
    for d, x in sets.items():
        for s in x:
            where[s].add(d)
    pairs = {(a, b) for ids in where.values() if len(ids) < 500 for a in ids for b in ids if a < b}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a, b in pairs:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            label[max(x, y)] = min(x, y)
    return {(d, root(d)) for d in sets}


def test_near_copies_around_the_line(spark):
    import random

    random.seed(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [[random.choice(vocabulary) for _ in range(random.randint(20, 90))] for _ in range(60)]
    texts = []
    for k in range(500):
        words_ = list(random.choice(base))
        for _ in range(random.randint(0, 4)):
            i = random.randrange(len(words_))
            words_[i : i + random.randint(0, 2)] = [random.choice(vocabulary) for _ in range(random.randint(0, 2))]
        texts.append((k, " ".join(words_)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == linked_by_brute_force(texts)


def test_a_passage_that_many_share_costs_few_comparisons(spark, monkeypatch):
    """Half of each text is one passage that all 5,000 have: few pairs are verified, and the links are right."""
    import random

    random.seed(5)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [(k, " ".join(f"u{random.randrange(10**9)}" for _ in range(20)) + " " + passage) for k in range(5000)]
    texts += [(5000 + k, texts[7 * k][1] + " end") for k in range(40)]
    seen = []
    original = jaccard_join.compared

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return original(pairs, sets, percent)

    monkeypatch.setattr(jaccard_join, "compared", counted)
    got = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(k, k) for k, _ in texts if k < 5000} | {(5000 + k, 7 * k) for k in range(40)}
    assert sum(seen) <= 4 * len(texts)


def test_demand_prunes_before_sets_are_read(spark):
    sets = spark.createDataFrame([(1, 3, [1, 2, 3, 4]), (2, 2, [3, 4, 5]), (3, 2, [4, 6, 7]), (4, 1, [7])], "d long, demand int, tokens array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4)], "a long, b long")
    assert {tuple(r) for r in jaccard_join.demanded(pairs, sets).collect()} == {(1, 2), (3, 4)}


def test_many_partitions_are_cut_in_few_files(spark, tmp_path):
    """Partitions that nothing coalesces do not each become a file of every table that is cut."""
    df = documents(spark, 7)
    want = by_row(jaccard_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, folder = {k: spark.conf.get(k) for k in held}, sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = by_row(jaccard_join.near_duplicates(df), "doc_id", "n_shingles", "component_id")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc._jsc.sc().setCheckpointDir(folder)
    files = [len(list(d.glob("part-*"))) for d in tmp_path.rglob("rdd-*")]
    assert got == want
    assert len(files) >= 8 and max(files) <= 8 * sc.defaultParallelism


def test_the_jaccard_join_writes_files_by_size(spark, tmp_path):
    """Small tables are at most two files a core, the blocks too, however many partitions there are."""
    documents(spark, 7).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).repartition(60)
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": "61", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, folder = {k: spark.conf.get(k) for k in held}, sc.getCheckpointDir()
    want = Counter(map(repr, jaccard_join.one_of_each(documents(spark, 7)).select("doc_id").collect()))
    sc.setCheckpointDir(str(tmp_path))
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        jaccard_join.one_of_each(df).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        sc._jsc.sc().setCheckpointDir(folder)
    files = [len(list(d.glob("part-*"))) for d in tmp_path.rglob("rdd-*")]
    assert len(files) >= 8 and max(files) <= 2 * sc.defaultParallelism
    assert Counter(map(repr, spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect())) == want
    many = spark.range(0, 100, 1, 100)
    assert [lineage.few(many, n).rdd.getNumPartitions() for n in (0, 20 * lineage.FILE_BYTES + 1, 1 << 62)] == [2 * sc.defaultParallelism, 21, 100]


def test_one_of_each(docs):
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    got = Counter(r["doc_id"] for r in out.collect())
    # Copies of 0 and the repeated row 3 go; rows without id or words stay.
    assert got[0] == 1 and got[23] == 0 and got[24] == 0 and got[3] == 1 and got[None] == 2 and got[20] == got[21] == got[22] == 1


def backoff(order, alpha, least, others):
    texts = [(d, words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for d, t, *_ in rows()]
    grams = lambda x: Counter(tuple(x[i - n : i]) for n in range(1, order + 1) for i in range(n, len(x) + 1))
    count, total, want = sum((grams(x) for _, x in texts), Counter()), sum(len(x) for _, x in texts), Counter()
    for d, x in texts:
        own, n_words = (grams(x), len(x)) if others else (Counter(), 0)
        micro = lost = 0
        for i in range(len(x)):
            p, given_up = 1.0, 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(x[i - n + 1 : i + 1])
                c = count[g] - own[g]
                if c >= (least if n > 1 else 1):
                    p *= c / (count[g[:-1]] - own[g[:-1]] if n > 1 else max(1, total - n_words))
                    break
                p, given_up = p * alpha, given_up + 1
            else:
                p /= max(1, total - n_words)
            micro, lost = micro + int(np.rint(np.log(p) * 1e6)), lost + given_up
        want[(d, len(x), lost, micro)] += 1
    return want


@pytest.mark.parametrize("order, least, others", [(3, 1, True), (3, 1, False), (2, 2, False), (4, 2, True), (1, 1, True)])
def test_lm_scoring(docs, order, least, others):
    out = lm_scoring.score_documents(docs, order=order, least=least, others=others).collect()
    close = lambda rows: sorted((str(r[0]), *r[1:]) for r in rows)
    got, want = close((r["doc_id"], r["n_words"], r["n_backoffs"], r["score_micro"]) for r in out), close(backoff(order, 0.4, least, others).elements())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert all(abs(x[3] - y[3]) <= x[1] for x, y in zip(got, want))  # the order of multiplications may move a word's last digit


def test_counts_in_bytes():
    x = np.array([0, 1, 254, 255, 256, 1 << 40, 7])
    assert lm_scoring.unvaried(lm_scoring.varied(x)).tolist() == x.tolist()


def test_lm_scoring_trigrams_are_registered():
    assert "op9_lm_scoring_trigrams" in QUERIES and "op9_lm_scoring_trigrams" in ORACLES


def test_sharding(docs):
    out = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("run, range_rows", [(mixing.RUN, sharding.RANGE_ROWS), (10, 7)])
def test_slots_of_many_copies(spark, run, range_rows, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", run)
    data = [(5, "same")] * 137 + [(None, "no id")] * 61 + [(k, None) for k in range(90)] + [(5, "other")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    out = sharding.shard_documents(df, range_rows=range_rows).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((d, len(t or "") + 1) for d, t in data)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weighted_shards(spark):
    ids = spark.range(20000)
    from pyspark.sql import functions as F

    n = {r["s"]: r["count"] for r in ids.groupBy(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).count().collect()}
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02


def test_slots_in_many_ranges(spark):
    from pyspark.sql import functions as F

    out = sharding.numbered(spark.range(5000).withColumn("shard", F.col("id") % 3), "shard", F.xxhash64("id"), [F.col("id")], range_rows=100).collect()
    for s in range(3):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(len([r for r in out if r["shard"] == s])))


def test_classifiers_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.0}
    forest = quality_classifier.train(docs, labels)
    assert all(0 <= r["score"] <= 1 for r in quality_classifier.scored(docs, forest).collect())
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def labelled_texts():
    good = [f"the river runs by stone number {k} and light falls on it in the morning of day {k * 7}" for k in range(60)]
    bad = [f"you vile zorg {k} get lost zorg idiot filth number {k * 3}" for k in range(60)]
    return [(1000 + k, t, int(k % 2)) for k, t in enumerate(x for pair in zip(good, bad) for x in pair)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows_ = labelled_texts()
    df = spark.createDataFrame([(d, t) for d, t, _ in rows_], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 1 - y, y) for d, _, y in rows_], "doc_id long, quality int, toxic int")
    return toxicity.train(df, labels), quality_classifier.train(df, labels)


def test_fitted_classifiers_on_odd_rows(spark, docs, fitted):
    for module, model in zip((toxicity, quality_classifier), fitted):
        out = module.scored(docs, model).collect()
        assert Counter(r["doc_id"] for r in out) == Counter(d for d, *_ in rows())
        assert all(0 <= r["score"] <= 1 for r in out)
        by_text = defaultdict(set)
        for r in out:
            by_text[r["text"] or ""].add(r["score"])
        assert all(max(v) - min(v) < 1e-5 for v in by_text.values())  # sums of floats depend on the batch
        assert module.scored(empty(spark), model).count() == 0
    kept = toxicity.drop_toxic(docs.withColumn("_toxicity", docs["lang"]).withColumn("__Toxicity", docs["source"]), fitted[0])
    assert kept.columns[-2:] == ["_toxicity", "__Toxicity"] and all(r["_toxicity"] == r["lang"] and r["__Toxicity"] == r["source"] for r in kept.collect())


def test_forward_pass_of_the_convolution(fitted):
    """Each text by itself, word by word, from the definition."""
    model = fitted[0]
    texts = [t.encode() for _, t, _ in labelled_texts()[:20]] + [b"", b"zorg", b"one two", b"x" * 300 + b" you zorg"]
    ids, at, _ = toxicity.features(texts)
    got = model.raw(ids, at[:-1])
    for k in range(len(texts)):
        rows_ = [sum(model.embedding[i].astype(float) for i in ids[r]) for r in range(at[k], at[k + 1])]
        pooled = []
        for f in model.filters:
            for c in range(f.shape[2]):
                starts = range(len(rows_) - len(f) + 1)
                best = max((sum(float(rows_[r + s] @ f[s][:, c]) for s in range(len(f))) for r in starts), default=-np.inf)
                pooled.append(best)
        h = np.maximum(np.array(pooled) + model.bias, 0)
        want = 1 / (1 + np.exp(-(h @ model.out + model.constant)))
        assert abs(got[k] - want) < 1e-3


def test_trees_are_walked_as_they_say(fitted):
    forest = fitted[1]
    x = quality_classifier.statistics([t.encode() for _, t, _ in labelled_texts()])
    inner = forest.feature.shape[1]
    for row, got in zip(x, forest.raw(x)):
        total = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - inner]
        assert abs(total - got) < 1e-9


@pytest.mark.parametrize(
    "run",
    [
        quality_rules.quality_rules,
        lambda d: byte_bpe.decode(byte_bpe.encode(d)),
        mixing.mix,
        mixing.mixed,
        secrets.scanned,
        secrets.redact,
        jaccard_join.near_duplicates,
        jaccard_join.one_of_each,
        lm_scoring.score_documents,
        sharding.shard_documents,
    ],
)
def test_empty_table(spark, run):
    assert run(empty(spark)).count() == 0



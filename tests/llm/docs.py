"""Small tables with every odd case: nulls, empty and very long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is was that for on with as by at from this it be a an river stone light".split()


def prose(n, seed=0):
    return " ".join(WORDS[(i * i * 7 + i * 3 + seed) % len(WORDS)] + ("." if i % 11 == 10 else "") for i in range(n))


def rows():
    texts = [prose(40, k) for k in range(12)]
    out = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    out += [(20, None, None, None, None), (21, "", "en", "src0", 0), (22, " \n\t ", "en", None, 4), (None, prose(30), "en", "src1", 1), (None, None, None, None, None)]
    out += [(23, texts[0], "fr", "src2", 1), (24, texts[0], None, "src1", 1), (25, texts[1] + " extra", "en", "src1", 1)]
    out += [(26, "word", "de", "src0", 4), (27, "two words", "de", "src0", 9), (3, texts[3], "en", "src0", len(texts[3]))]
    out += [(28, prose(30000, 5), "en", "src2", 1), (29, "same line\nsame line\n" * 40, "en", "src1", 1), (30, "日本語 テキスト é ü 🎉 " * 10, "ja", "src1", 1), (31, "x" * 70000, "en", "src1", 1)]
    return out


def documents(spark, parts=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """The documents with further columns named like what operators compute."""
    from pyspark.sql import functions as F

    df = documents(spark)
    for name in ("size", "ids", "decoded", "score", "block", "payload", "words", "h", "label", "range", "key", "taken", "n", "place", "component"):
        df = df.withColumn(name, F.lit("clash"))
    return df

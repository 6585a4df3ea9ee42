"""Quality rules: a threshold table compiled into one Spark projection.

Only built-in expressions run here: no Python on the executors and no shuffle, so one document is
one row from the scan to the result and a hot source or group of copies changes nothing.

Defined results: a null or empty text has no words, hence ``base_failed``; a null ``doc_id`` stays
null; repeated rows give repeated results; an empty table gives an empty result; further columns of
the input are ignored, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\\x20\\x09-\\x0D]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is was that for on with as by at from this it be a an are or "
    "der die das und den von zu mit ist auf für im des ein eine dem "
    "le la les de et en un une que qui pour dans est du par au "
    "el los las y del se por con al es lo su una"
)


@dataclass(frozen=True)
class Rule:
    """Documents of at least ``from_words`` words fail when ``measure`` leaves [least, most]."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The thresholds. Each measure is a ratio that the projection below computes.
RULES = (
    Rule("chars_per_word", least=2.5, most=12.0, from_words=10),
    Rule("symbols_per_word", most=0.1),
    Rule("stop_word_ratio", least=0.05, from_words=20),
    Rule("dup_line_ratio", most=0.4, from_words=20),
)


def stop_word_forms(words: str = STOP_WORDS) -> list[str]:
    """Lower-case and capitalised forms, without repeats."""
    return sorted({form for w in words.split() for form in (w, w.capitalize())})


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def measured(docs: DataFrame, stop_words: str = STOP_WORDS) -> DataFrame:
    """Counts per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_lines.

    Repeated five-word windows are found by sorting (hash, position) packed in one long each; windows
    whose hashes agree are then compared as text, so hashes never decide.
    """
    t = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = t.withColumn("trimmed", F.btrim("t", F.lit(SPACE)))
    t = t.select(
        "doc_id",
        "t",
        F.expr(f"if(trimmed = '', cast(array() as array<string>), split(trimmed, '{SPACE_CLASS}+'))").alias("words"),
        F.expr(f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    t = t.select(
        "doc_id",
        "words",
        F.expr("cast(size(words) as bigint)").alias("n_words"),
        F.expr("cast(length(array_join(words, '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) as bigint)").alias("n_symbols"),
        F.expr("cast(size(lines) as bigint)").alias("n_lines"),
        F.expr("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        F.expr(f"cast(size(filter(words, w -> rtrim('.,;:!?', w) in ({_quoted(stop_word_forms(stop_words))}))) as bigint)").alias("n_stop"),
        F.expr("transform(words, w -> xxhash64(w))").alias("h"),
        F.expr("length(bin(size(words)))").alias("bits"),
    )
    kept = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop"]
    t = t.select(
        *kept,
        "words",
        "bits",
        F.expr(
            "if(n_words >= 6, sort_array(transform(sequence(0, cast(n_words as int) - 5), i -> "
            "shiftleft(xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]), bits) | cast(i as bigint))), "
            "cast(array() as array<bigint>))"
        ).alias("p"),
    )
    same = "shiftright({a}, bits) = shiftright({b}, bits)"
    t = t.select(
        *kept,
        "words",
        "bits",
        F.expr(
            "filter(p, (x, i) -> (i > 0 and " + same.format(a="x", b="p[i - 1]") + ") or (i < size(p) - 1 and " + same.format(a="x", b="p[i + 1]") + "))"
        ).alias("alike"),
    )
    t = t.select(
        *kept,
        F.expr(
            "sort_array(transform(transform(alike, x -> cast(x & (shiftleft(1L, bits) - 1L) as int)), "
            "i -> struct(concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]) as w, i as i)))"
        ).alias("g"),
    )
    t = t.select(
        *kept,
        F.expr("sort_array(transform(filter(g, (x, i) -> (i > 0 and x.w = g[i - 1].w) or (i < size(g) - 1 and x.w = g[i + 1].w)), x -> x.i))").alias("q"),
    )
    repeated = F.expr("aggregate(transform(q, (x, i) -> cast(if(i < size(q) - 1, least(5, q[i + 1] - x), 5) as bigint)), 0L, (a, b) -> a + b)")
    # Always taken, but not deterministic in the optimizer's eyes: a filter on these columns would else be
    # pushed below all projections, and their expressions written out within one another.
    return t.select(*kept, F.when(F.monotonically_increasing_id() >= 0, repeated).alias("n_repeat_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression: true when no rule fails."""
    ratio = {
        "chars_per_word": F.try_divide("word_chars", "n_words"),
        "symbols_per_word": F.try_divide("n_symbols", "n_words"),
        "stop_word_ratio": F.try_divide("n_stop", "n_words"),
        "dup_line_ratio": F.try_divide("n_dup_lines", "n_lines"),
    }
    passed = F.lit(True)
    for r in rules:
        x = F.coalesce(ratio[r.measure].cast("double"), F.lit(0.0))
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (x < r.least)
        if r.most is not None:
            bad = bad | (x > r.most)
        passed = passed & ~((F.col("n_words") >= r.from_words) & bad)
    return passed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with the counts, ``base_failed`` and the verdict ``kept``."""
    base = F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")
    return measured(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop", "n_lines", base.alias("base_failed"), (~base & compiled(rules)).alias("kept")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    bad = []
    ratio = {"chars_per_word": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_word_ratio": "n_stop / n_words", "dup_line_ratio": "n_dup_lines / n_lines"}
    for r in RULES:
        x = f"coalesce(cast({ratio[r.measure].replace(' / ', ' as double) / nullif(')}, 0), 0)"
        tests = [f"{x} < {r.least}"] * (r.least is not None) + [f"{x} > {r.most}"] * (r.most is not None)
        bad.append(f"(n_words >= {r.from_words} and ({' or '.join(tests)}))")
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from t),
g as (select r, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) >= 5),
k as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] as s from g),
d as (select r, i, count(*) over (partition by r, s) as c from k),
e as (select r, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) as x from d where c > 1),
f as (select r, sum(x) as n from e group by r),
c as (select w.r, doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
      cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) as bigint) as n_lines,
      cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(f.n, 0) as bigint) as n_repeat_words,
      cast(len(list_filter(ws, lambda x: rtrim(x, '.,;:!?') in ({_quoted(stop_word_forms())}))) as bigint) as n_stop
      from w left join f using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop, n_lines,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not ({' or '.join(bad)}) as kept from c"""


ORACLE = _oracle()

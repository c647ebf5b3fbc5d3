"""Quality rules with thresholds that follow each language and source.

Every document gets a few counts.  Fixed rules reject what no source excuses; the rest
is judged against fences taken from quantile sketches of its own language and source.

A sketch is a count per bucket: whole numbers up to 63 have a bucket each, larger ones
share buckets of at most 1/32 of their size.  Counts add, so sketches merge by a sum, in
any order, with equal results; their size is bounded by the logarithm of the values.
A source of fewer than ``min_group`` documents in a language uses the merged sketch of
the language, and a language of fewer than that the merged sketch of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabmend.llm.common import Workspace, full, named, words

MIN_WORDS = 50
MIN_GROUP = 100
#: Fences lie three times the middle half's width beyond it, and at least this far.
FENCE = 3
#: metric: (smallest distance of the upper fence, of the lower fence or None)
METRICS = {
    "symbols": (50, None),  # symbols to 1,000 words
    "repeats": (300, None),  # repeated words to 1,000 words
    "lines": (300, None),  # repeated lines to 1,000 lines
    "length": (100, 100),  # mean code points of a word, in hundredths
}


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """Per row: the id, ``keep`` columns, and the counts.

    Null and empty texts have no words and zero counts.  Repeated rows give repeated
    results.  Windows are told apart by 64-bit hashes within one text."""
    text = full(named(text_col))
    df = docs.select(
        named(id_col).alias("id"), *[named(k).alias(f"k_{i}") for i, k in enumerate(keep)], text.alias("text")
    )
    df = df.select("*", words(F.col("text")).alias("w"))
    n = F.size("w")
    # three words from each position on; `w` is used twice, which keeps it computed once
    windows = F.transform(
        F.slice("w", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda word, i: F.xxhash64(word, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        "id",
        *[f"k_{i}" for i in range(len(keep))],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("h"),
    )
    df = df.select(
        *[c for c in df.columns if c not in ("lines", "h")],
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "h",
        (F.size(F.array_distinct("h")) < F.size("h")).alias("twice"),
    )
    placed = F.when(
        F.col("twice"), F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    )
    df = df.withColumn("s", placed).drop("h")
    s = F.col("s")
    same = F.filter(
        s,
        lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    )
    repeats = F.when(F.col("twice"), F.size(covered)).otherwise(0).cast("long")
    return df.select(
        F.col("id").alias(id_col),
        *[F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        repeats.alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """Whole numbers, so that every engine and every run has the same."""
    ratio = lambda of, to: F.expr(f"({of}) div greatest({to}, 1)")
    return {
        "symbols": ratio("1000 * n_symbols", "n_words"),
        "repeats": ratio("1000 * n_repeat_words", "n_words"),
        "lines": ratio("1000 * n_dup_lines", "n_lines"),
        "length": ratio("100 * word_chars", "n_words"),
    }


def bucket(value: Column) -> Column:
    """The smallest number of the value's bucket."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, bucket, n): one mergeable sketch per group and metric."""
    each = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in measures().items()])
    )
    return merged(rows.select(*by, each.alias("m")).select(*by, "m.*", F.lit(1).cast("long").alias("n")), by)


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Per group: its documents, and a low and a high fence for each metric."""
    group = Window.partitionBy(*by, "metric")  # a few hundred buckets at most
    df = sketches.select(
        *by, "metric", "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
        F.sum("n").over(group).alias("total"),
    )
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    df = df.groupBy(*by, "metric").agg(
        F.max("total").alias("total"), quartile(1).alias("q1"), quartile(3).alias("q3")
    )
    width = FENCE * (F.col("q3") - F.col("q1"))
    found = []
    for m, (above, below) in METRICS.items():
        here = F.col("metric") == m
        found.append(F.max(F.when(here, F.col("q3") + F.greatest(width, F.lit(above)))).alias(f"hi_{m}"))
        if below is not None:
            found.append(F.max(F.when(here, F.col("q1") - F.greatest(width, F.lit(below)))).alias(f"lo_{m}"))
    return df.groupBy(*by).agg(F.max("total").alias("total"), *found)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null languages and sources are groups of their own.  Only rows that pass the base
    rules enter the sketches.  An empty table gives an empty result.  Values on a fence
    are kept.  Of ``docs`` only the four named columns are read."""
    space = Workspace(docs.sparkSession)
    rows = text_counts(docs, id_col, text_col, (lang_col, source_col))
    rows = rows.toDF("id", "lang", "source", *rows.columns[3:]).withColumn("base_failed", base_failed())
    rows = space.stored(rows, "counts")
    fine = sketch(rows.filter(~F.col("base_failed")), ["lang", "source"])
    fine = space.stored(fine, "sketches")
    by_lang = merged(fine.drop("source"), ["lang"])
    of_all = merged(fine.drop("lang", "source"), [])
    names = [f"hi_{m}" for m in METRICS] + [f"lo_{m}" for m, x in METRICS.items() if x[1] is not None]
    f, g, h = fences(fine, ["lang", "source"]), fences(by_lang, ["lang"]), fences(of_all, [])
    f, g, h = f.alias("f"), g.alias("g"), h.alias("h")
    # the third has one row, so each group meets it once
    limits = f.join(g, F.col("f.lang").eqNullSafe(F.col("g.lang"))).join(h, F.lit(True), "left").select(
        F.col("f.lang").alias("t_lang"),
        F.col("f.source").alias("t_source"),
        *[
            F.when(F.col("f.total") >= min_group, F.col(f"f.{n}"))
            .when(F.col("g.total") >= min_group, F.col(f"g.{n}"))
            .otherwise(F.col(f"h.{n}"))
            .alias(n)
            for n in names
        ],
    )
    rows = rows.join(
        limits,
        F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    )
    within = F.lit(True)
    for m, v in measures().items():
        within = within & (v <= F.col(f"hi_{m}"))
        if f"lo_{m}" in names:
            within = within & (v >= F.col(f"lo_{m}"))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(within, F.lit(False))).alias("kept"),
    )

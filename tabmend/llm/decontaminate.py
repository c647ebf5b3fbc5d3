"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ``size`` words.  The shingles of a window (three words
each) are counted in the corpus and ordered by rarity.  A text that holds the window holds
its rarest shingle, so this one shingle is the window's prefix: exact containment needs no
second one.  Shingles of the documents are joined with the prefixes; the shingle's place
then says where the window would begin, which bounds it by position and by the text's
length, and the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabmend.llm.common import UPPER, Workspace, full, named, ordered

WINDOW = 10
SHINGLE = 3
#: Up to so many prefixes or shingles (under 100 MB) go to every executor.
BROADCAST_ROWS = 200_000
#: What lies between words: ASCII but for digits and letters.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def plain_words(text: Column) -> Column:
    """The words, A-Z in lower case."""
    even = F.translate(full(text), BETWEEN + UPPER, " " * len(BETWEEN) + UPPER.lower())
    return F.array_remove(F.split(even, " "), "")


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, window, len, k, at, t): each window once per shingle in it."""
    df = items.select(named(id_col).cast("string").alias("item"), plain_words(named(text_col)).alias("w"))
    df = df.select("item", "w", F.size("w").alias("n")).filter("n > 0")
    df = df.withColumns({"len": F.least("n", F.lit(window)), "k": F.least("n", F.lit(min(shingle, window)))})
    df = df.select("item", "len", "k", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("s"))
    df = df.select("item", "len", "k", F.slice("w", F.col("s") + 1, "len").alias("w"))
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("at"))
    return df.select(
        "item", F.array_join("w", " ").alias("window"), "len", "k", "at", _token("w", F.col("at"), "k", shingle)
    ).distinct()


def _token(array: str, at: Column, k, most: int) -> Column:
    """Hash of ``k`` words from ``at`` on."""
    k = F.col(k) if isinstance(k, str) else F.lit(k)
    parts = [F.when(k > j, F.get(F.col(array), at + j)) for j in range(most)]
    return F.xxhash64(k.cast("int"), *parts).alias("t")


def _positions(docs: DataFrame, id_col: str, text_col: str, k: int, shingle: int) -> DataFrame:
    text = full(named(text_col))
    df = docs.select(
        ordered(named(id_col)).alias("doc"), F.xxhash64(text).alias("part"), plain_words(text).alias("words")
    )
    df = df.select("doc", "part", "words", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"))
    return df.select("doc", "part", "words", "n", "p", _token("words", F.col("p"), k, shingle))


def _near(df: DataFrame, rows: int, limit: int) -> DataFrame:
    return F.broadcast(df) if rows <= limit else df


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, n_items, items (sorted) and contaminated.

    A word is hit if it lies in an occurrence of a window.  Null texts have no words and
    null or empty items no windows.  An item with a null id marks words and is not
    listed.  Rows that repeat an id are judged by their own text.  Empty tables of documents
    or items give no hits.  Columns of ``docs`` named like new ones are replaced."""
    space = Workspace(docs.sparkSession)
    tokens = space.stored(item_windows(items, item_col, item_text_col, window, shingle), "windows")
    lengths = sorted(r["k"] for r in tokens.select("k").distinct().collect())  # at most `shingle`
    found = None
    for k in lengths:
        mine = tokens.filter(F.col("k") == k)
        wanted = mine.select(F.col("t").alias("t_")).distinct()
        places = _positions(docs, id_col, text_col, k, shingle)
        counts = places.select("t").join(_near(wanted, wanted.count(), broadcast_rows), F.col("t") == F.col("t_"), "left_semi")
        counts = counts.groupBy("t").agg(F.count(F.lit(1)).alias("freq"))  # a row per task and shingle
        # only windows whose rarest shingle occurs at all; min keeps the first of equals
        rare = mine.join(counts, "t", "left").groupBy("item", "window", "len").agg(
            F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "t", "at")).alias("p")
        )
        rare = rare.filter("p.freq > 0").select(
            "item", "window", "len", F.col("p.t").alias("t_"), F.col("p.at").alias("at")
        )
        rare = rare.groupBy("window", "len", "t_", "at").agg(F.sort_array(F.collect_set("item")).alias("items"))
        rare = space.stored(rare, "prefixes")
        rows = rare.count()
        start = F.col("p") - F.col("at")
        fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
        same = F.array_join(F.slice("words", start + 1, F.col("len")), " ") == F.col("window")
        if rows <= broadcast_rows:
            hits = places.join(F.broadcast(rare), F.col("t") == F.col("t_")).filter(fits).filter(same)
        else:
            # the texts stay; places meet the prefixes, and what fits goes back to its text
            near = places.drop("words").join(rare, F.col("t") == F.col("t_")).filter(fits).drop("n")
            near = near.withColumnsRenamed({"doc": "doc_", "part": "part_"})
            text = full(named(text_col))
            whole = docs.select(
                ordered(named(id_col)).alias("doc"), F.xxhash64(text).alias("part"), plain_words(text).alias("words")
            ).dropDuplicates(["doc", "part"])
            hits = near.join(whole, (F.col("doc") == F.col("doc_")) & (F.col("part") == F.col("part_"))).filter(same)
        hits = hits.select("doc", "part", start.alias("s"), "len", "items")
        found = hits if found is None else found.unionByName(hits)
    text = full(named(text_col))
    left = docs.withColumns(
        {"doc_": ordered(named(id_col)), "part_": F.xxhash64(text), "n_words": F.size(plain_words(text)).cast("long")}
    )
    none = F.array().cast("array<string>")
    if found is None:
        left = left.withColumns({"n_hit": F.lit(0).cast("long"), "items": none})
    else:
        found = space.stored(found, "hits").groupBy("doc", "part").agg(
            F.collect_set(F.struct("s", "len")).alias("spans"), F.collect_set("items").alias("lists")
        )
        spread = F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["len"] - 1)))
        found = found.select(
            F.col("doc").alias("of_"), F.col("part").alias("its_"),
            F.size(F.array_distinct(spread)).cast("long").alias("hit_"),
            F.sort_array(F.array_distinct(F.flatten("lists"))).alias("lists_"),
        )
        left = left.join(found, (F.col("doc_") == F.col("of_")) & (F.col("part_") == F.col("its_")), "left")
        left = left.withColumns(
            {"n_hit": F.coalesce("hit_", F.lit(0).cast("long")), "items": F.coalesce("lists_", none)}
        ).drop("of_", "its_", "hit_", "lists_")
    return left.drop("doc_", "part_").withColumns(
        {"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0}
    )

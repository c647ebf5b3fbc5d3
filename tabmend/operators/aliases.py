"""Variant spellings of categorical values, as an (column, alias, canonical) table.

Values come from the distinct counts, so these joins are over distinct values,
not rows.  Two passes: spellings with one alias key, then acronyms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from tabmend.functions import fixed
from tabmend.functions.text import alias_key, initials, is_title, strip, words
from tabmend.operators.values import value_counts
from tabmend.session import Scratch


def alias_sample(counts: DataFrame, size: int = fixed.ALIAS_SAMPLE) -> DataFrame:
    """inf_alias_sample: the ``size`` most frequent values per column (all, if fewer)."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def spelling_groups(values: DataFrame) -> DataFrame:
    """Every value with its alias key, the number of its spellings and their
    canonical: a title-cased, then longest spelling; ties go to the smaller."""
    order = F.struct(~is_title(F.col("value")), -F.length("value"), F.col("value"))
    keyed = values.select("column", "value", alias_key(F.col("value")).alias("key"))
    groups = keyed.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("spellings"), F.min_by("value", order).alias("canonical")
    )
    return keyed.join(groups, ["column", "key"])


def key_aliases(values: DataFrame) -> DataFrame:
    """inf_alias_key: spellings that differ in case, spaces and punctuation only."""
    return (
        spelling_groups(values)
        .where("key <> '' AND value <> canonical")
        .select("column", F.col("value").alias("alias"), "canonical")
    )


def acronym_aliases(values: DataFrame) -> DataFrame:
    """inf_alias_acronym: ``US``, ``USA`` and ``US_OFFICIAL`` for ``United States``.

    An alias equals the initials, or extends them by one character, or starts
    with the initials and an underscore; that makes every match an equality on
    one of three keys of the alias.  Values with other spellings take no part,
    an alias belongs to the smallest canonical that matches it, and a value
    claimed by a smaller canonical claims nothing itself.  The claims are settled
    in rounds, each stored; what is returned reads the last one."""
    free = (
        spelling_groups(values)
        .where((F.col("key") == "") | (F.col("spellings") == 1))
        .select(
            "column",
            "value",
            F.upper(strip(F.col("value"))).alias("upper"),
            (F.size(words(F.col("value"))) > 1).alias("several"),
        )
    )
    keyed = free.selectExpr(
        "column",
        "value AS name",
        "several",
        """array_distinct(filter(array(
             upper,
             CASE WHEN length(upper) > 1 THEN left(upper, length(upper) - 1) END,
             CASE WHEN instr(upper, '_') > 1 THEN substring_index(upper, '_', 1) END),
             k -> k <> '')) AS keys""",
    ).withColumn("short", F.when(F.col("several"), initials(F.col("name"))))
    scratch = Scratch(values.sparkSession)
    keyed = scratch.stored(keyed.drop("several"), "keyed")
    active = _active(keyed.where("short <> ''"), scratch)
    return _smallest_other(keyed, active)


def _active(names: DataFrame, scratch: Scratch) -> DataFrame:
    """(column, name, short): the names that claim, by a fixed point over rounds.

    A name is lost once a smaller active one has initials among its keys.  Of the names with one key
    only the smallest that is not lost, and the smallest that is active, can decide, so a round groups the
    names by key and looks up two names for each key of a name: nothing grows with the pairs.  A
    round settles every name whose smaller claimants are settled, the smallest at least."""
    state = names.select("column", "name", "short", "keys", F.lit(None).cast("boolean").alias("active"))
    while True:
        claims = state.where("coalesce(active, true)").groupBy("column", F.col("short").alias("key")).agg(
            F.min("name").alias("alive"), F.min(F.when(F.col("active"), F.col("name"))).alias("sure")
        )
        asked = state.where("active IS NULL").select("column", "name", F.explode("keys").alias("key"))
        told = asked.join(claims.hint("merge"), ["column", "key"]).groupBy("column", "name").agg(
            F.bool_or(F.coalesce(F.col("sure") < F.col("name"), F.lit(False))).alias("lost"),
            F.bool_or(F.col("alive") < F.col("name")).alias("waits"),
        )
        verdict = F.expr("CASE WHEN active IS NOT NULL THEN active WHEN lost THEN false WHEN NOT coalesce(waits, false) THEN true END")
        state = state.join(told.hint("merge"), ["column", "name"], "left").select(
            "column", "name", "short", "keys", verdict.alias("active")
        )
        state = scratch.stored(state, "claims")
        if state.where("active IS NULL").isEmpty():
            return state.where("active").select("column", "name", "short")


def _smallest_other(keyed: DataFrame, active: DataFrame) -> DataFrame:
    """Each name with a claimant of its keys: the smallest other than itself."""
    by_key = active.groupBy("column", F.col("short").alias("key")).agg(F.min("name").alias("one"))
    rest = active.withColumnRenamed("short", "key").join(by_key.hint("merge"), ["column", "key"]).where("name <> one")
    two = rest.groupBy("column", "key").agg(F.min("name").alias("two"))
    claims = by_key.join(two.hint("merge"), ["column", "key"], "left")
    asked = keyed.select("column", F.col("name").alias("alias"), F.explode("keys").alias("key"))
    met = asked.join(claims.hint("merge"), ["column", "key"]).select(
        "column", "alias", F.when(F.col("one") == F.col("alias"), F.col("two")).otherwise(F.col("one")).alias("by")
    )
    return met.where("by IS NOT NULL").groupBy("column", "alias").agg(F.min("by").alias("canonical"))


def detect_aliases(df: DataFrame, columns: list[str]) -> dict[str, dict[str, str]]:
    """Both passes over all values of ``columns``: alias maps per column."""
    values = value_counts(df, columns).select("column", "value").persist()
    pairs = key_aliases(values)
    # only a value of several words can have an acronym
    phrased = values.where(F.col("value").rlike(r"\S[\s_\-]+\S")).select("column").distinct().collect()
    if phrased:
        own = values.where(F.col("column").isin(*[r["column"] for r in phrased]))
        pairs = pairs.unionByName(acronym_aliases(own))
    found: dict[str, dict[str, str]] = {}
    rows = pairs.collect()
    values.unpersist()
    for row in sorted(rows, key=lambda r: (r["column"], r["canonical"], r["alias"])):
        found.setdefault(row["column"], {})[row["alias"]] = row["canonical"]
    return found

"""Re-profile after remediation, and before/after comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabmend.functions import fixed
from tabmend.functions.kinds import ref
from tabmend.operators.issues import PROFILE_SCHEMA, collect_profile, issues_of, profile
from tabmend.session import local_table
from tabmend.spec import TableSpec


def reprofile(df: DataFrame, spec: TableSpec) -> DataFrame:
    """ver_reprofile: the issues left, under the schema inferred before."""
    return issues_of(profile(df, spec))


def reprofile_touched(df: DataFrame, spec: TableSpec, before: DataFrame, touched: set[str]) -> DataFrame:
    """The profile of ``df``, read from its ``touched`` columns only; the others are as in ``before``.

    ``before`` is the profile of the same rows before the touched columns changed.  Where the number of
    rows differs, or no column was touched, or a column is new, all columns are profiled."""
    names = df.columns
    old = {r["column"]: r for r in before.toArrow().to_pylist()}
    asked = [c for c in names if c in touched or c not in old]
    if not asked or len(asked) == len(names):
        return profile(df, spec)
    fresh = {r["column"]: r for r in collect_profile(df.select(*[ref(c) for c in asked]), spec)}
    if {r["rows"] for r in fresh.values()} != {r["rows"] for r in old.values()}:
        return profile(df, spec)
    rows = [(fresh.get(c) or old[c]) | {"ord": i} for i, c in enumerate(names)]
    return local_table(df.sparkSession, rows, PROFILE_SCHEMA)


def verification_message(residual: int) -> str:
    return fixed.LOG_RESIDUAL.format(n=residual) if residual else fixed.LOG_VERIFIED


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """ver_delta: per column, rows, missing, out-of-bounds and outlier counts
    before and after; a dropped column has no after."""
    counts = ("rows", "nulls", "out_of_bounds", "outliers")
    b = before.select("ord", "column", *[F.col(c).alias(f"{c}_before") for c in counts])
    a = after.select("column", *[F.col(c).alias(f"{c}_after") for c in counts])
    deltas = [(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta") for c in counts]
    return b.join(a, "column", "left").select("*", *deltas)


def compare_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row counts of two frames and their difference, as one row."""
    tagged = before.select(F.lit(0).alias("side")).unionAll(after.select(F.lit(1).alias("side")))
    return tagged.agg(
        F.count_if(F.col("side") == 0).alias("rows_before"),
        F.count_if(F.col("side") == 1).alias("rows_after"),
    ).withColumn("rows_delta", F.col("rows_after") - F.col("rows_before"))

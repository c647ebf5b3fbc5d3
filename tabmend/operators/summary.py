"""prof_summary_table: the description of a table for a person or an assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabmend.functions.kinds import is_numeric, kinds, measure
from tabmend.operators.colstats import collect_stats
from tabmend.operators.infer import COLSTATS_SCHEMA, colstats_table
from tabmend.operators.quantiles import exact_quantiles
from tabmend.session import local_table
from tabmend.sources.csv import sample_values


def moments(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prof_moments: min, max, mean, median and population deviation."""
    kind = kinds(df)
    names = [c for c in (columns or df.columns) if is_numeric(kind[c])]
    stats = collect_stats(df, names, distinct=False)
    values = {c: measure(c, kind[c]) for c in names}
    medians = exact_quantiles(df, values, (0.5,), {c: stats[c]["filled"] for c in names})
    schema = COLSTATS_SCHEMA
    for name in (
        "approx_unique", "n_unique", "unique_exact", "uniqueness", "nonneg",
        "minority_value", "minority_n",
    ):
        schema = schema.remove(schema.get_field_index(name))
    schema = schema.append(schema.field("mean").with_name("median"))
    rows = [{**s, "median": medians.get(c, {}).get(0.5)} for c, s in stats.items()]
    return local_table(df.sparkSession, rows, schema).select(
        "ord", "column", "filled", "min", "max", "mean", "median", "std"
    )


def summary(df: DataFrame, key: list[str]) -> DataFrame:
    """Type, missing, unique, first values and numeric statistics per column."""
    stats = colstats_table(df).select("ord", "column", "dtype", "rows", "nulls", "n_unique")
    numbers = moments(df).drop("ord", "filled")
    samples = sample_values(df, key).drop("ord")
    share = F.round(F.coalesce(F.try_divide("nulls", "rows"), F.lit(0.0)) * 100, 1)
    return (
        stats.withColumn("null_percent", share)
        .join(samples, "column", "left")
        .join(numbers, "column", "left")
    )

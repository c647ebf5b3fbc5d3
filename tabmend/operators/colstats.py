"""Column statistics: one fused scan, one long row per column.

Every statistic here has a small fixed-size state (count, sum, min, max,
moments, a distinct-count sketch of at most 4 KiB), so map-side partials are
tiny and a scan of any size ends in one small merge.  Statistics that need the
distinct values live in ``values``; exact percentiles live in ``quantiles``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame

from tabmend.functions import fixed
from tabmend.functions.kinds import is_numeric, kinds, measure, present, text

# Wider tables are scanned in groups of columns, each scan reading its own only.
COLUMNS_PER_SCAN = 64
# Distinct-count sketches of 2^n registers.  A uniqueness share decides the role
# of integers and of columns named like an id, so those get the finer one
# (standard error 1.6%); the others only need few told from many (4.6%).
FINE_SKETCH, FINE_ERROR = 12, 0.01625
COARSE_SKETCH = 9

# statistic -> (aggregate over the cell x, type)
_MOMENTS = {
    "min": ("min({x})", "double"),
    "max": ("max({x})", "double"),
    "mean": ("avg({x})", "double"),
    "std": ("stddev_pop({x})", "double"),
    "nonneg": ("count_if({x} >= 0)", "bigint"),
}


def row_count(df: DataFrame) -> DataFrame:
    """prof_rowcount: rows and columns of the table."""
    return df.selectExpr(
        "count(1) AS total_rows", f"CAST({len(df.columns)} AS INT) AS total_columns"
    )


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prof_nulls: missing cells and their share, for every column of any role."""
    stats = column_stats(df, columns, moments=False, distinct=False)
    return stats.selectExpr(
        "ord", "column", "rows", "nulls", "round(try_divide(nulls, rows), 4) AS null_ratio"
    )


def column_stats(
    df: DataFrame,
    columns: list[str] | None = None,
    moments: bool = True,
    distinct: bool = True,
) -> DataFrame:
    """The colstats table.  Lazy: one aggregate per group of columns."""
    names = list(columns if columns is not None else df.columns)
    groups = [names[i : i + COLUMNS_PER_SCAN] for i in range(0, len(names), COLUMNS_PER_SCAN)]
    scans = [_scan(df, group, moments, distinct) for group in groups or [[]]]
    return reduce(DataFrame.unionByName, scans)


def share_matters(name: str, kind: str) -> bool:
    """Does the uniqueness share of a column with many values decide its role?"""
    return kind == "integer" or re.search(fixed.ID_NAME, name, re.IGNORECASE) is not None


def _scan(df: DataFrame, names: list[str], moments: bool, distinct: bool) -> DataFrame:
    kind = kinds(df)
    order = {name: i for i, name in enumerate(df.columns)}
    aggregates = ["count(1) AS rows"]
    entries = []
    for name in names:
        slot, k = f"c{order[name]}", kind[name]
        cell = present(name, k)
        made = {"filled": f"count({cell})"}
        if distinct and k != "nested":
            hashed = f"CASE WHEN {cell} IS NOT NULL THEN xxhash64({cell}) END"
            size = FINE_SKETCH if share_matters(name, k) else COARSE_SKETCH
            sketch = f"hll_sketch_agg({hashed}, {size})"
            made["approx_unique"] = f"hll_sketch_estimate({sketch})"
        if moments and is_numeric(k):
            made |= {s: f.format(x=measure(name, k)) for s, (f, _) in _MOMENTS.items()}
        aggregates += [f"{expr} AS {slot}_{stat}" for stat, expr in made.items()]
        fields = {
            "ord": str(order[name]),
            "column": text(name),
            "dtype": text(df.schema[name].dataType.simpleString()),
            "kind": text(k),
            "rows": "rows",
            "nulls": f"rows - {slot}_filled",
        }
        typed = {"filled": "bigint", "approx_unique": "bigint"}
        typed |= {s: t for s, (_, t) in _MOMENTS.items()}
        for stat, dtype in typed.items():
            fields[stat] = f"CAST({f'{slot}_{stat}' if stat in made else 'NULL'} AS {dtype})"
        entries.append(f"named_struct({', '.join(f'{text(k)}, {v}' for k, v in fields.items())})")
    if not entries:
        raise ValueError("the table has no columns to describe")
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(entries)}))")


def collect_stats(df: DataFrame, columns: list[str] | None = None, **kwargs) -> dict[str, dict]:
    """colstats on the driver, one entry per column."""
    rows = column_stats(df, columns, **kwargs).collect()
    return {row["column"]: row.asDict() for row in sorted(rows, key=lambda r: r["ord"])}

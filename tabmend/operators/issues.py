"""The profile of a table and the governance issues it raises.

Two scans.  The first gives moments; the second counts, with those as literals,
the cells outside the domain, the z-outliers and the cells at either extreme.
Both are plain aggregates without a shuffle of rows.  A column has exactly two
values when every cell equals its minimum or its maximum, so binary columns and
their class counts need no distinct count.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmend.functions import fixed
from tabmend.functions.kinds import is_numeric, kinds, measure, number, present, text
from tabmend.functions.masks import far, outside
from tabmend.operators.colstats import COLUMNS_PER_SCAN, collect_stats
from tabmend.session import local_table
from tabmend.spec import TableSpec

# from here on, different integers may be one double
EXACT_INTEGER = 2**53

PROFILE_SCHEMA = pa.schema(
    [
        ("ord", pa.int32()),
        ("column", pa.string()),
        ("dtype", pa.string()),
        ("kind", pa.string()),
        ("role", pa.string()),
        ("semantic_type", pa.string()),
        ("checked", pa.bool_()),  # false for id and ignore columns
        ("is_target", pa.bool_()),
        ("rows", pa.int64()),
        ("nulls", pa.int64()),
        ("filled", pa.int64()),
        ("min", pa.float64()),
        ("max", pa.float64()),
        ("mean", pa.float64()),
        ("std", pa.float64()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("out_of_bounds", pa.int64()),
        ("outliers", pa.int64()),
        ("binary", pa.bool_()),  # two numeric values, declared binary or 0 and 1
        ("minority_n", pa.int64()),
        ("minority_value", pa.string()),
        ("classes_n", pa.int64()),
    ]
)

# offsets of the issues of one column in the order they are reported
_ORDER = {
    fixed.HIGH_NULL_RATIO: 0,
    fixed.INVALID_BOUNDS: 1,
    fixed.CLASS_IMBALANCE: 2,
    fixed.STATISTICAL_OUTLIER: 3,
}


def profile(
    df: DataFrame, spec: TableSpec | None = None, stats: dict[str, dict] | None = None
) -> DataFrame:
    """The profile table: one row per column, empty for an empty table.  Collected
    ``stats`` of the same frame save the first scan."""
    rows = collect_profile(df, spec or TableSpec(), stats)
    return local_table(df.sparkSession, rows, PROFILE_SCHEMA)


def collect_profile(
    df: DataFrame, spec: TableSpec, stats: dict[str, dict] | None = None
) -> list[dict]:
    stats = {c: dict(s) for c, s in (stats or collect_stats(df, distinct=False)).items()}
    if not stats or not next(iter(stats.values()))["rows"]:
        return []
    for name, s in stats.items():
        bounds = spec.bounds(name) or (None, None)
        s |= {
            "role": spec.role(name),
            "semantic_type": spec.semantic(name),
            "checked": spec.role(name) not in ("id", "ignore"),
            "is_target": name == spec.target,
            "low": bounds[0],
            "high": bounds[1],
            "binary": False,
        }
    numeric = [s for s in stats.values() if s["checked"] and is_numeric(s["kind"]) and s["filled"]]
    for i in range(0, len(numeric), COLUMNS_PER_SCAN):
        _count_cells(df, numeric[i : i + COLUMNS_PER_SCAN])
    target = stats.get(spec.target) if spec.target else None
    if target and target.get("minority_n") is None:
        target |= _class_counts(df, spec.target)
    return list(stats.values())


def _count_cells(df: DataFrame, stats: list[dict]) -> None:
    """Second scan: fills the counts of ``stats`` in place."""
    aggregates: list[str] = []
    for i, s in enumerate(stats):
        x = measure(s["column"], s["kind"])
        bounds = None if s["semantic_type"] == "categorical" else (s["low"], s["high"])
        tests = {
            "oob": outside(x, bounds),
            "z": far(x, s["mean"], s["std"]),
            "lo": f"{x} = {number(s['min'])}",
            "hi": f"{x} = {number(s['max'])}",
        }
        aggregates += [
            f"count_if({test}) AS {name}{i}" if test else f"0L AS {name}{i}"
            for name, test in tests.items()
        ]
    got = df.selectExpr(*aggregates).first()
    for i, s in enumerate(stats):
        two_values = s["min"] < s["max"] and got[f"lo{i}"] + got[f"hi{i}"] == s["filled"]
        large = s["kind"] == "integer" and max(abs(s["min"]), abs(s["max"])) >= EXACT_INTEGER
        ends = _large_ends(df, s) if large and got[f"lo{i}"] + got[f"hi{i}"] >= s["filled"] else None
        if large:
            two_values = ends is not None
        declared = s["semantic_type"] == "binary"
        flag = {s["min"], s["max"]} <= {0.0, 1.0} and (two_values or s["min"] == s["max"])
        s["binary"] = two_values and (declared or flag)
        s["out_of_bounds"] = got[f"oob{i}"]
        plain = not declared and not flag and s["semantic_type"] != "categorical"
        s["outliers"] = got[f"z{i}"] if plain else 0
        if ends:
            s |= ends
        elif two_values:
            value, s["minority_n"] = (
                (s["min"], got[f"lo{i}"]) if got[f"lo{i}"] <= got[f"hi{i}"] else (s["max"], got[f"hi{i}"])
            )
            s["minority_value"] = str(int(value)) if s["kind"] == "integer" else str(value)
            s["classes_n"] = s["filled"]


def _large_ends(df: DataFrame, s: dict) -> dict | None:
    """Ends of an integer column that doubles may confuse, with their cells: the rarer
    one where no other value exists, else None."""
    cell = present(s["column"], s["kind"])
    low, high = df.selectExpr(f"min({cell})", f"max({cell})").first()
    cells = df.selectExpr(*[f"count_if({cell} = CAST('{v}' AS {s['dtype']}))" for v in (low, high)]).first()
    if low == high or sum(cells) != s["filled"]:
        return None
    value, n = (low, cells[0]) if cells[0] <= cells[1] else (high, cells[1])
    return {"minority_value": str(value), "minority_n": n, "classes_n": s["filled"]}


def _class_counts(df: DataFrame, column: str) -> dict:
    """Smallest class of a target of any type; counted after a partial aggregate."""
    cell = present(column, kinds(df)[column])
    counts = df.selectExpr(f"{cell} AS value").where("value IS NOT NULL").groupBy("value")
    row = (
        counts.agg(F.expr("count(1) AS n"))
        .selectExpr(
            "count(1) AS classes",
            "CAST(min_by(value, struct(n, value)) AS STRING) AS minority_value",
            "min(n) AS minority_n",
            "sum(n) AS classes_n",
        )
        .first()
    )
    if row["classes"] < 2:
        return {}
    return {k: row[k] for k in ("minority_value", "minority_n", "classes_n")}


def _ratios(table: DataFrame) -> DataFrame:
    return table.selectExpr(
        "*",
        "nulls / rows AS null_ratio",
        "out_of_bounds / rows AS bounds_ratio",
        "outliers / rows AS outlier_ratio",
        "try_divide(minority_n, classes_n) AS minority_ratio",
    ).selectExpr(
        "*",
        f"checked AND null_ratio >= {fixed.NULL_RATIO_LIMIT}D AS many_nulls",
        "checked AND out_of_bounds > 0 AS bad_bounds",
        "checked AND outliers > 0 AS far_out",
        f"checked AND binary AND minority_ratio < {fixed.MINORITY_LIMIT}D AS rare_binary",
        f"is_target AND minority_ratio < {fixed.MINORITY_LIMIT}D "
        "AND NOT (checked AND binary) AS rare_target",
    )


def _plain_number(value: str) -> str:
    """SQL: a double as plain text, two decimals at most where that is exact."""
    cents = f"regexp_replace(format_string('%.2f', {value}), '0$', '')"
    return f"CASE WHEN round({value}, 2) = {value} THEN {cents} ELSE CAST({value} AS STRING) END"


# (test, type, message, ratio, extra columns); a target check is reported last
_ISSUES = (
    (
        "many_nulls",
        fixed.HIGH_NULL_RATIO,
        f"format_string({text(fixed.MSG_HIGH_NULL)}, column, null_ratio * 100)",
        "null_ratio",
        {},
    ),
    (
        "bad_bounds",
        fixed.INVALID_BOUNDS,
        f"format_string({text(fixed.MSG_BOUNDS)}, column, out_of_bounds, bounds_ratio * 100, "
        f"{_plain_number('low')}, {_plain_number('high')})",
        "bounds_ratio",
        {"count": "out_of_bounds", "low": "low", "high": "high"},
    ),
    (
        "rare_binary",
        fixed.CLASS_IMBALANCE,
        f"format_string({text(fixed.MSG_IMBALANCE)}, column, minority_value, minority_ratio * 100)",
        "round(minority_ratio, 4)",
        {"minority_value": "minority_value"},
    ),
    (
        "far_out",
        fixed.STATISTICAL_OUTLIER,
        f"format_string({text(fixed.MSG_OUTLIER)}, column, outliers, outlier_ratio * 100)",
        "outlier_ratio",
        {"count": "outliers"},
    ),
    (
        "rare_target",
        fixed.CLASS_IMBALANCE,
        f"format_string({text(fixed.MSG_TARGET_IMBALANCE)}, column, minority_value, "
        "minority_ratio * 100)",
        "round(minority_ratio, 4)",
        {"minority_value": "minority_value", "ord": "2147483647"},
    ),
)
_ISSUE_TYPES = {
    "ord": "int",
    "column": "string",
    "type": "string",
    "count": "bigint",
    "ratio": "double",
    "low": "double",
    "high": "double",
    "minority_value": "string",
    "message": "string",
}


def issues_of(table: DataFrame) -> DataFrame:
    """prof_issues: the issues of a profile table, ``ord`` in reporting order."""
    found = []
    for test, kind, message, ratio, extra in _ISSUES:
        cells = {
            "ord": f"ord * 10 + {_ORDER[kind]}",
            "column": "column",
            "type": text(kind),
            "ratio": ratio,
            "message": message,
        } | extra
        fields = ", ".join(
            f"'{name}', CAST({cells.get(name, 'NULL')} AS {t})" for name, t in _ISSUE_TYPES.items()
        )
        found.append(f"CASE WHEN {test} THEN named_struct({fields}) END")
    return _ratios(table).selectExpr(f"inline(array_compact(array({', '.join(found)})))")


_LABELS = (
    f"CASE WHEN checked AND nulls > 0 "
    f"THEN format_string({text(fixed.LABEL_NULLS)}, nulls, null_ratio * 100) END",
    f"CASE WHEN bad_bounds "
    f"THEN format_string({text(fixed.LABEL_BOUNDS)}, out_of_bounds, bounds_ratio * 100) END",
    f"CASE WHEN rare_binary "
    f"THEN format_string({text(fixed.LABEL_IMBALANCE)}, minority_ratio * 100) END",
    f"CASE WHEN far_out "
    f"THEN format_string({text(fixed.LABEL_OUTLIERS)}, outliers, outlier_ratio * 100) END",
    f"CASE WHEN rare_target "
    f"THEN format_string({text(fixed.LABEL_IMBALANCE)}, minority_ratio * 100) END",
)


def labels_of(table: DataFrame) -> DataFrame:
    """prof_labels: the anomaly labels of each column, ``Healthy`` without any."""
    joined = f"array_join(array_compact(array({', '.join(_LABELS)})), ', ')"
    return _ratios(table).selectExpr(
        "ord", "column", f"coalesce(nullif({joined}, ''), {text(fixed.LABEL_HEALTHY)}) AS status"
    )


def find_issues(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """Profile ``df`` and return its issues."""
    return issues_of(profile(df, spec))


def null_issues(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """prof_high_null."""
    return find_issues(df, spec).where(F.col("type") == fixed.HIGH_NULL_RATIO)


def bounds_issues(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """prof_bounds."""
    return find_issues(df, spec).where(F.col("type") == fixed.INVALID_BOUNDS)


def outlier_issues(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """prof_zscore."""
    return find_issues(df, spec).where(F.col("type") == fixed.STATISTICAL_OUTLIER)


def imbalance_issues(df: DataFrame, spec: TableSpec | None = None) -> DataFrame:
    """prof_imbalance_binary and prof_imbalance_target."""
    return find_issues(df, spec).where(F.col("type") == fixed.CLASS_IMBALANCE)

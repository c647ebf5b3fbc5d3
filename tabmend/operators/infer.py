"""Semantic schema inference: roles, types, domains, aliases and the target.

The rules are one CASE over the colstats table, first match wins.  Only columns
whose rule needs more (a domain, alias pairs, a minority value) are read again.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmend.functions import fixed
from tabmend.functions.kinds import kinds, measure, text
from tabmend.operators.aliases import detect_aliases
from tabmend.operators.colstats import FINE_ERROR, collect_stats, share_matters
from tabmend.operators.quantiles import exact_quantiles
from tabmend.operators.values import FEW_VALUES, extremes, unique_sizes
from tabmend.session import local_table
from tabmend.spec import ColumnSpec, TableSpec

COLSTATS_SCHEMA = pa.schema(
    [
        ("ord", pa.int32()),
        ("column", pa.string()),
        ("dtype", pa.string()),
        ("kind", pa.string()),
        ("rows", pa.int64()),
        ("nulls", pa.int64()),
        ("filled", pa.int64()),
        ("approx_unique", pa.int64()),
        ("n_unique", pa.int64()),
        ("unique_exact", pa.bool_()),
        ("uniqueness", pa.float64()),
        ("min", pa.float64()),
        ("max", pa.float64()),
        ("mean", pa.float64()),
        ("std", pa.float64()),
        ("nonneg", pa.int64()),
        ("minority_value", pa.string()),
        ("minority_n", pa.int64()),
    ]
)

# An estimated uniqueness share decides a rule only when it is at least five
# standard errors away from the threshold.
SAFE_ERRORS = 5

# rule -> (role, semantic type)
_OUTCOME = {
    "id": ("id", None),
    "ignore_text": ("ignore", "text"),
    "binary": ("feature", "binary"),
    "nominal": ("ignore", "numerical"),
    "discrete": ("feature", "categorical"),
    "numerical": ("feature", "numerical"),
    "string": ("feature", "categorical"),
    "default": ("feature", "categorical"),
}
_DESCRIPTION = {
    "id": fixed.DESC_ID,
    "ignore_text": fixed.DESC_TEXT,
    "binary": fixed.DESC_BINARY,
    "nominal": fixed.DESC_NOMINAL,
    "discrete": fixed.DESC_DISCRETE,
    "numerical": fixed.DESC_NUMERICAL,
    "string": fixed.DESC_CATEGORICAL,
}


def _named(pattern: str) -> str:
    return f"column RLIKE {text('(?i)' + pattern)}"


_NUMERIC = "kind IN ('integer', 'float', 'decimal')"


def rule() -> str:
    """SQL: the name of the first rule that applies to a colstats row."""
    return f"""
    CASE
      WHEN kind = 'nested' THEN 'default'
      WHEN {_named(fixed.ID_NAME)}
           AND (uniqueness > {fixed.ID_UNIQUENESS}D OR filled < {fixed.ID_FEW_VALUES}) THEN 'id'
      WHEN kind = 'string'
           AND ({_named(fixed.IGNORE_NAME)} OR n_unique > {fixed.TEXT_UNIQUE}
                OR (uniqueness > {fixed.TEXT_UNIQUENESS}D
                    AND n_unique > {fixed.TEXT_UNIQUE_WITH_RATIO})) THEN 'ignore_text'
      WHEN n_unique = 2 AND filled > {fixed.BINARY_MIN_VALUES} THEN 'binary'
      WHEN {_NUMERIC} AND {_named(fixed.IGNORE_NAME)} THEN 'nominal'
      WHEN kind = 'integer' AND uniqueness > {fixed.NOMINAL_UNIQUENESS}D
           AND n_unique > {fixed.NOMINAL_UNIQUE} THEN 'nominal'
      WHEN kind = 'integer' AND n_unique <= {fixed.CODE_UNIQUE}
           AND {_named(fixed.CATEGORY_NAME)} THEN 'discrete'
      WHEN kind = 'integer' AND n_unique <= {fixed.DISCRETE_UNIQUE}
           AND filled >= {fixed.DISCRETE_MIN_VALUES} THEN 'discrete'
      WHEN {_NUMERIC} THEN 'numerical'
      WHEN kind = 'string' THEN 'string'
      ELSE 'default'
    END"""


def _by_rule(answers: dict[str, str | None]) -> str:
    """SQL: a literal per rule."""
    lines = [f"WHEN {text(r)} THEN {a}" for r, a in answers.items() if a is not None]
    return f"CASE rule {' '.join(lines)} END"


def classify(stats: DataFrame) -> DataFrame:
    """colstats plus rule, role, semantic type and description."""
    roles = {r: text(role) for r, (role, _) in _OUTCOME.items()}
    types = {r: text(t) for r, (_, t) in _OUTCOME.items() if t}
    types["id"] = "CASE WHEN kind = 'string' THEN 'text' ELSE 'numerical' END"
    about = {r: f"format_string({text(t)}, n_unique)" for r, t in _DESCRIPTION.items()}
    estimated = f"regexp_replace({_by_rule(about)}, '[(]', '(about ')"
    return stats.selectExpr("*", f"{rule()} AS rule").selectExpr(
        "*",
        f"{_by_rule(roles)} AS role",
        f"{_by_rule(types)} AS semantic_type",
        f"CASE WHEN unique_exact THEN {_by_rule(about)} ELSE {estimated} END AS description",
    )


def select_target(classified: DataFrame) -> DataFrame:
    """inf_target: the first binary column with a target-like name, else the first."""
    return classified.where("rule = 'binary'").selectExpr(
        f"min_by(column, struct(NOT {_named(fixed.TARGET_NAME)}, ord)) AS target"
    )


def colstats_table(df: DataFrame, exact: bool = True) -> DataFrame:
    """Statistics with distinct counts, and the rarer value of two-valued columns.

    ``exact=False`` keeps the sketch estimate of a distinct count wherever it is
    too far from every threshold to matter; such rows say ``unique_exact`` false.
    Roles come out the same, and the values of wide, high-cardinality columns
    are never shuffled."""
    stats = with_unique(df, collect_stats(df, distinct=not exact), exact)
    return local_table(df.sparkSession, list(stats.values()), COLSTATS_SCHEMA)


def with_unique(df: DataFrame, stats: dict[str, dict], exact: bool) -> dict[str, dict]:
    """Collected statistics (with sketches unless ``exact``) plus distinct counts."""
    stats = {c: dict(s) for c, s in stats.items()}
    countable = [c for c, s in stats.items() if s["kind"] != "nested" and s["filled"] > 0]
    asked = countable if exact else [c for c in countable if _needs_count(stats[c])]
    known: dict[str, int] = {}
    if asked:
        known = {df.columns[r["ord"]]: r["n_unique"] for r in unique_sizes(df, asked).collect()}
    for name, s in stats.items():
        if name in countable:
            s["n_unique"] = known.get(name, s["approx_unique"])
        else:
            s["n_unique"] = None if s["kind"] == "nested" else 0
        s["unique_exact"] = name in known or name not in countable
        s["uniqueness"] = (s["n_unique"] or 0) / s["filled"] if s["filled"] else 0.0
    two = [c for c in known if known[c] == 2]
    rarer = {r["column"]: r.asDict() for r in extremes(df, two).collect()} if two else {}
    for name, s in stats.items():
        for key in ("minority_value", "minority_n"):
            s[key] = rarer.get(name, {}).get(key)
    return stats


def _needs_count(s: dict) -> bool:
    return s["approx_unique"] <= FEW_VALUES or _near_threshold(s)


def _near_threshold(s: dict) -> bool:
    """Could the estimate's error change a rule?  To a column with thousands of
    values only the two uniqueness shares apply."""
    if not share_matters(s["column"], s["kind"]):
        return False
    share = s["approx_unique"] / s["filled"]
    error = SAFE_ERRORS * FINE_ERROR * share
    limits = (fixed.ID_UNIQUENESS, fixed.NOMINAL_UNIQUENESS)
    return any(abs(share - limit) <= error for limit in limits)


def fences(q25: float, q75: float, low: float, high: float, nonneg_share: float) -> tuple[float, float]:
    """Tukey fences from a column's collected statistics, cut at zero for
    columns that are practically never negative."""
    spread = q75 - q25
    if spread > 0:
        low, high = q25 - fixed.FENCE_FACTOR * spread, q75 + fixed.FENCE_FACTOR * spread
    if low < 0 and nonneg_share >= fixed.NONNEGATIVE_SHARE:
        low = 0.0
    return round(low, 2), round(high, 2)


def estimate_bounds(
    df: DataFrame, columns: list[str], stats: dict[str, dict] | None = None
) -> dict[str, tuple[float, float]]:
    """inf_bounds for each numeric column; a column without values has none."""
    stats = stats or collect_stats(df, columns, distinct=False)
    kind = kinds(df)
    values = {c: measure(c, kind[c]) for c in columns}
    quartiles = exact_quantiles(df, values, (0.25, 0.75), {c: stats[c]["filled"] for c in columns})
    return {
        c: fences(
            q[0.25], q[0.75], stats[c]["min"], stats[c]["max"], stats[c]["nonneg"] / stats[c]["filled"]
        )
        for c, q in quartiles.items()
    }


def infer_rules(
    df: DataFrame, exact: bool = True, stats: dict[str, dict] | None = None
) -> TableSpec:
    """Inference by rule alone.  ``stats`` are collected statistics of ``df``, with
    sketches unless ``exact``."""
    stats = with_unique(df, stats or collect_stats(df, distinct=not exact), exact)
    table = local_table(df.sparkSession, list(stats.values()), COLSTATS_SCHEMA)
    classified = classify(table)
    rows = sorted(classified.collect(), key=lambda r: r["ord"])
    of_rule = {r: [row["column"] for row in rows if row["rule"] == r] for r in _OUTCOME}
    bounds = estimate_bounds(df, of_rule["numerical"], stats) if of_rule["numerical"] else {}
    several = [c for c in of_rule["string"] if stats[c]["n_unique"] > 1]
    aliases = detect_aliases(df, several) if several else {}
    target = select_target(classified).first()["target"] if of_rule["binary"] else None
    columns = {
        row["column"]: ColumnSpec(
            role="target" if row["column"] == target else row["role"],
            semantic_type=row["semantic_type"],
            bounds=bounds.get(row["column"]),
            aliases=aliases.get(row["column"], {}),
            minority_value=row["minority_value"] if row["rule"] == "binary" else None,
            description=row["description"],
        )
        for row in rows
    }
    return TableSpec(columns, target, "heuristic")


OVERRIDE_TYPE = (
    "struct<id_columns: array<string>, target_column: string, ignore_columns: array<string>, "
    "columns: map<string, struct<role: string, semantic_type: string, valid_bounds: array<double>, "
    "canonical_aliases: map<string, array<string>>, minority_class_value: string, "
    "description: string>>>"
)


def override_table(df: DataFrame, document: str) -> DataFrame:
    """inf_override: a JSON schema document as one row per column of ``df``.

    A fenced code block around the document is accepted.  Columns the table does
    not have are dropped."""
    fenced = F.regexp_extract("doc", r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.col("doc"))
    spark = df.sparkSession
    doc = local_table(spark, [{"doc": document}], pa.schema([("doc", pa.string())]))
    known = F.array(*[F.lit(c) for c in df.columns])
    parsed = doc.select(F.from_json(body, OVERRIDE_TYPE).alias("s"))
    entries = parsed.select(
        F.col("s.target_column").alias("target_column"),
        F.explode("s.columns").alias("column", "spec"),
    )
    spec = F.col("spec")
    return entries.where(F.array_contains(known, F.col("column"))).select(
        (F.array_position(known, F.col("column")) - 1).cast("int").alias("ord"),
        "column",
        F.coalesce(spec.role, F.lit("feature")).alias("role"),
        F.coalesce(spec.semantic_type, F.lit("numerical")).alias("semantic_type"),
        F.try_element_at(spec.valid_bounds, F.lit(1)).alias("low"),
        F.try_element_at(spec.valid_bounds, F.lit(2)).alias("high"),
        spec.minority_class_value.alias("minority_value"),
        spec.description.alias("description"),
        (F.col("target_column") == F.col("column")).alias("is_target"),
        spec.canonical_aliases.alias("aliases"),
    )


def override_spec(df: DataFrame, document: str | dict) -> TableSpec:
    written = document if isinstance(document, str) else json.dumps(document)
    rows = sorted(override_table(df, written).collect(), key=lambda r: r["ord"])
    columns = {}
    for row in rows:
        pairs = row["aliases"] or {}
        columns[row["column"]] = ColumnSpec(
            role=row["role"],
            semantic_type=row["semantic_type"],
            bounds=(row["low"], row["high"])
            if row["low"] is not None or row["high"] is not None
            else None,
            aliases={alias: canonical for canonical, many in pairs.items() for alias in many or []},
            minority_value=row["minority_value"],
            description=row["description"],
        )
    target = next((row["column"] for row in rows if row["is_target"]), None)
    return TableSpec(columns, target, "override")


def infer(df: DataFrame, override: str | dict | None = None, exact: bool = True) -> TableSpec:
    """inf_schema: a supplied schema replaces inference; ``method`` tells which ran."""
    return override_spec(df, override) if override else infer_rules(df, exact)

"""Building blocks of the SQL counterparts: a whole-table profile as CTEs.

Written for DuckDB from the rules themselves, over long (column, value) cells;
nothing here is shared with the Spark side but the fixed values.
"""

from __future__ import annotations

from catalog.views import TABLES, dirty_kinds, dirty_sql
from tabmend.functions import fixed


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def spaces() -> str:
    """Whitespace characters as a DuckDB string expression."""
    return " || ".join(f"chr({ord(c)})" for c in fixed.WHITESPACE)


def stripped(expr: str) -> str:
    return f"trim({expr}, {spaces()})"


def source(name: str, strip: bool = False) -> tuple[str, dict[str, str]]:
    """(SELECT text, column kinds) of the dirty view or a given table."""
    kinds = dirty_kinds() if name == "dirty" else TABLES[name]
    base = dirty_sql() if name == "dirty" else f"SELECT * FROM {name}"
    if strip:
        items = ", ".join(
            f"{stripped(c)} AS {c}" if k == "string" else c for c, k in kinds.items()
        )
        base = f"SELECT {items} FROM ({base})"
    return base, kinds


def cells(kinds: dict[str, str], rel: str = "src") -> str:
    """One row per cell: ord, col, kind, v (text), num."""
    parts = []
    for i, (c, k) in enumerate(kinds.items()):
        num = f"CAST({c} AS DOUBLE)" if k in ("integer", "float") else "CAST(NULL AS DOUBLE)"
        v = f"CASE WHEN {c} IS NULL THEN NULL ELSE '' END" if k == "nested" else f"CAST({c} AS VARCHAR)"
        parts.append(f"SELECT {i} AS ord, '{c}' AS col, '{k}' AS kind, {v} AS v, {num} AS num FROM {rel}")
    return " UNION ALL ".join(parts)


STATS = """
SELECT ord, col, kind, count(*) AS nrows, count(*) - count(v) AS nulls, count(v) AS filled,
       CASE WHEN kind <> 'nested' THEN count(DISTINCT v) END AS n_unique,
       min(num) AS mn, max(num) AS mx, avg(num) AS mean, stddev_pop(num) AS sd,
       quantile_cont(num, 0.25) AS q25, quantile_cont(num, 0.5) AS med, quantile_cont(num, 0.75) AS q75,
       count(*) FILTER (num >= 0) AS nonneg
FROM cells GROUP BY ord, col, kind"""

COUNTS = """
SELECT ord, col, v, num, count(*) AS n FROM cells WHERE v IS NOT NULL AND kind <> 'nested'
GROUP BY ord, col, v, num"""

RANKED = """
SELECT *, row_number() OVER (PARTITION BY ord ORDER BY n, num, v) AS least,
          row_number() OVER (PARTITION BY ord ORDER BY n DESC, num, v) AS most,
          sum(n) OVER (PARTITION BY ord) AS total,
          count(*) OVER (PARTITION BY ord) AS classes
FROM counts"""


def rules() -> str:
    def named(pattern: str) -> str:
        return f"regexp_matches(col, {lit(pattern)}, 'i')"

    share = "(CASE WHEN filled > 0 THEN n_unique / filled ELSE 0 END)"
    return f"""
SELECT *, {share} AS uniqueness, CASE
  WHEN kind = 'nested' THEN 'default'
  WHEN {named(fixed.ID_NAME)} AND ({share} > 0.7 OR filled < 10) THEN 'id'
  WHEN kind = 'string' AND ({named(fixed.IGNORE_NAME)} OR ({share} > 0.7 AND n_unique > 30)
       OR n_unique > 1000) THEN 'ignore_text'
  WHEN n_unique = 2 AND filled > 5 THEN 'binary'
  WHEN kind IN ('integer', 'float') AND ({named(fixed.IGNORE_NAME)}
       OR (kind = 'integer' AND {share} > 0.9 AND n_unique > 100)) THEN 'nominal'
  WHEN kind = 'integer' AND ((n_unique <= 25 AND {named(fixed.CATEGORY_NAME)})
       OR (n_unique <= 10 AND filled >= 50)) THEN 'discrete'
  WHEN kind IN ('integer', 'float') THEN 'numerical'
  WHEN kind = 'string' THEN 'string'
  ELSE 'default' END AS rule
FROM stats"""


TARGET = f"""
SELECT arg_min(col, ord + CASE WHEN regexp_matches(col, {lit(fixed.TARGET_NAME)}, 'i') THEN 0 ELSE 100000 END)
       AS target FROM rules WHERE rule = 'binary'"""

FENCES = """
SELECT ord, CASE WHEN q75 > q25 THEN q25 - 1.5 * (q75 - q25) ELSE mn END AS lo,
            CASE WHEN q75 > q25 THEN q75 + 1.5 * (q75 - q25) ELSE mx END AS hi
FROM rules WHERE rule = 'numerical' AND filled > 0"""

SPEC = f"""
SELECT r.*, CASE WHEN r.col = t.target THEN 'target' WHEN rule = 'id' THEN 'id'
                 WHEN rule IN ('ignore_text', 'nominal') THEN 'ignore' ELSE 'feature' END AS role,
  CASE WHEN rule = 'id' THEN CASE WHEN kind = 'string' THEN 'text' ELSE 'numerical' END
       WHEN rule = 'ignore_text' THEN 'text' WHEN rule = 'binary' THEN 'binary'
       WHEN rule IN ('nominal', 'numerical') THEN 'numerical' ELSE 'categorical' END AS semantic,
  round_even(CASE WHEN f.lo < 0 AND nonneg / filled >= 0.95 THEN 0.0 ELSE f.lo END, 2) AS low,
  round_even(f.hi, 2) AS high,
  CASE WHEN rule = 'binary' THEN m.v END AS minority_value,
  CASE rule
    WHEN 'id' THEN printf({lit(fixed.DESC_ID)}, n_unique)
    WHEN 'ignore_text' THEN printf({lit(fixed.DESC_TEXT)}, n_unique)
    WHEN 'binary' THEN printf({lit(fixed.DESC_BINARY)}, n_unique)
    WHEN 'nominal' THEN printf({lit(fixed.DESC_NOMINAL)}, n_unique)
    WHEN 'discrete' THEN printf({lit(fixed.DESC_DISCRETE)}, n_unique)
    WHEN 'numerical' THEN printf({lit(fixed.DESC_NUMERICAL)}, n_unique)
    WHEN 'string' THEN printf({lit(fixed.DESC_CATEGORICAL)}, n_unique) END AS description,
  coalesce(r.col = t.target, false) AS is_target
FROM rules r CROSS JOIN target t LEFT JOIN fences f USING (ord)
LEFT JOIN (SELECT ord, v FROM ranked WHERE least = 1) m USING (ord)"""

CHECKS = """
SELECT c.ord, count(*) FILTER (s.semantic <> 'categorical' AND (c.num < s.low OR c.num > s.high)) AS oob,
       count(*) FILTER (abs(c.num - s.mean) / nullif(s.sd, 0) > 3) AS z
FROM cells c JOIN spec s USING (ord) GROUP BY c.ord"""

PROF = """
SELECT s.*, s.role NOT IN ('id', 'ignore') AS checked, s.kind IN ('integer', 'float') AS numeric_kind,
       k.oob, k.z, m.n AS minority_n, m.v AS minority, m.total, m.classes,
       coalesce(s.kind IN ('integer', 'float') AND s.n_unique <= 2 AND s.filled > 0
                AND s.mn IN (0, 1) AND s.mx IN (0, 1), false) AS flag
FROM spec s LEFT JOIN checks k USING (ord) LEFT JOIN (SELECT * FROM ranked WHERE least = 1) m USING (ord)"""

JUDGED = """
SELECT *, checked AND nulls / nrows >= 0.2 AS many_nulls,
  checked AND numeric_kind AND oob > 0 AS bad_bounds,
  checked AND numeric_kind AND semantic NOT IN ('categorical', 'binary') AND NOT flag AND z > 0 AS far_out,
  checked AND numeric_kind AND n_unique = 2 AND (semantic = 'binary' OR flag) AS binary2,
  checked AND numeric_kind AND n_unique = 2 AND (semantic = 'binary' OR flag)
    AND minority_n / total < 0.2 AS rare_binary,
  is_target AND classes >= 2 AND minority_n / total < 0.2
    AND NOT (checked AND numeric_kind AND n_unique = 2 AND (semantic = 'binary' OR flag)) AS rare_target
FROM prof"""

ISSUES = f"""
SELECT ord * 10 AS ord, col AS "column", 'HIGH_NULL_RATIO' AS type, CAST(NULL AS BIGINT) AS count,
       nulls / nrows AS ratio, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
       CAST(NULL AS VARCHAR) AS minority_value,
       printf({lit(fixed.MSG_HIGH_NULL)}, col, nulls / nrows * 100) AS message
FROM judged WHERE many_nulls
UNION ALL
SELECT ord * 10 + 1, col, 'INVALID_BOUNDS', oob, oob / nrows, low, high, NULL,
       printf({lit(fixed.MSG_BOUNDS)}, col, oob, oob / nrows * 100,
              CAST(low AS VARCHAR), CAST(high AS VARCHAR))
FROM judged WHERE bad_bounds
UNION ALL
SELECT ord * 10 + 2, col, 'CLASS_IMBALANCE', NULL, round(minority_n / total, 4), NULL, NULL, minority,
       printf({lit(fixed.MSG_IMBALANCE)}, col, minority, minority_n / total * 100)
FROM judged WHERE rare_binary
UNION ALL
SELECT ord * 10 + 3, col, 'STATISTICAL_OUTLIER', z, z / nrows, NULL, NULL, NULL,
       printf({lit(fixed.MSG_OUTLIER)}, col, z, z / nrows * 100)
FROM judged WHERE far_out
UNION ALL
SELECT 2147483647, col, 'CLASS_IMBALANCE', NULL, round(minority_n / total, 4), NULL, NULL, minority,
       printf({lit(fixed.MSG_TARGET_IMBALANCE)}, col, minority, minority_n / total * 100)
FROM judged WHERE rare_target"""


def _has(kind: str) -> str:
    return f"list_contains(kinds, '{kind}')"


GROUPED = f"""
SELECT "column", min(ord) AS ord, count(*) AS n_issues, list(DISTINCT type) AS kinds,
       string_agg(DISTINCT type, ',' ORDER BY type) AS types,
       coalesce(max(ratio) FILTER (type = 'HIGH_NULL_RATIO'), 0.0) AS null_ratio,
       max(minority_value) AS minority_value,
       string_agg(CASE type
         WHEN 'INVALID_BOUNDS' THEN {lit(fixed.ISSUE_BOUNDS)}
         WHEN 'STATISTICAL_OUTLIER' THEN {lit(fixed.ISSUE_OUTLIER)}
         WHEN 'CLASS_IMBALANCE' THEN printf({lit(fixed.ISSUE_IMBALANCE)}, ratio * 100)
         ELSE printf({lit(fixed.ISSUE_NULLS)}, ratio * 100) END, ' & ' ORDER BY ord) AS description
FROM issues GROUP BY "column" """

ADVISED = f"""
SELECT g.*, CASE WHEN null_ratio >= 0.5 THEN 'DROP'
     WHEN {_has('CLASS_IMBALANCE')} THEN 'SYNTHETIC_SYNTHESIS'
     WHEN {_has('INVALID_BOUNDS')} AND {_has('STATISTICAL_OUTLIER')} THEN 'STATISTICAL_IMPUTE'
     WHEN {_has('STATISTICAL_OUTLIER')} THEN 'SYNTHETIC_SYNTHESIS'
     ELSE 'STATISTICAL_IMPUTE' END AS strategy,
  CASE WHEN null_ratio >= 0.5 THEN printf({lit(fixed.IMPACT_DROP)}, null_ratio * 100)
     WHEN {_has('CLASS_IMBALANCE')} THEN printf({lit(fixed.IMPACT_BALANCE)}, g.minority_value)
     WHEN {_has('INVALID_BOUNDS')} AND {_has('STATISTICAL_OUTLIER')} THEN {lit(fixed.IMPACT_BOUNDS_AND_OUTLIER)}
     WHEN {_has('INVALID_BOUNDS')} THEN {lit(fixed.IMPACT_BOUNDS)}
     WHEN {_has('STATISTICAL_OUTLIER')} THEN {lit(fixed.IMPACT_OUTLIER)}
     WHEN {_has('HIGH_NULL_RATIO')} AND s.kind = 'string' THEN {lit(fixed.IMPACT_MODE)}
     WHEN {_has('HIGH_NULL_RATIO')} THEN {lit(fixed.IMPACT_MEDIAN)}
     ELSE {lit(fixed.IMPACT_OTHER)} END AS impact
FROM grouped g JOIN spec s ON s.col = g."column" """

NEEDED = """
SELECT nrows, minority_n,
       CASE WHEN minority_n / nrows < 0.35
            THEN CAST(trunc((CAST(0.35 AS DOUBLE) * nrows - minority_n) / CAST(0.65 AS DOUBLE)) AS BIGINT)
            ELSE 0 END AS needed
FROM prof WHERE is_target"""

STAGES = {
    "stats": STATS,
    "counts": COUNTS,
    "ranked": RANKED,
    "rules": rules(),
    "target": TARGET,
    "fences": FENCES,
    "spec": SPEC,
    "checks": CHECKS,
    "prof": PROF,
    "judged": JUDGED,
    "issues": ISSUES,
    "grouped": GROUPED,
    "advised": ADVISED,
    "balance": NEEDED,
}


def profile_sql(
    name: str,
    select: str,
    strip: bool = False,
    overrides: dict[str, str] | None = None,
    extra: dict[str, str] | None = None,
    columns: list[str] | None = None,
) -> str:
    """``select`` over the CTEs of table ``name``; ``overrides`` replaces CTEs and
    ``extra`` adds some after them."""
    base, kinds = source(name, strip)
    if columns:
        kinds = {c: k for c, k in kinds.items() if c in columns}
        base = f"SELECT {', '.join(kinds)} FROM ({base})"
    stages = {"src": base, "cells": cells(kinds), **STAGES, **(overrides or {}), **(extra or {})}
    # leave out what the query does not reach
    used, wanted = set(), [select]
    import re

    while wanted:
        sql = wanted.pop()
        for stage in stages:
            if stage not in used and re.search(rf"\b{stage}\b", sql):
                used.add(stage)
                wanted.append(stages[stage])
    ctes = ",\n".join(f"{s} AS ({q})" for s, q in stages.items() if s in used)
    return f"WITH {ctes}\n{select}"


def uniform(seed: int, column: str, tag: str, key: str) -> str:
    digest = f"md5(concat('{seed}|{column}|{tag}|', CAST({key} AS VARCHAR)))"
    return f"((CAST(CAST(('0x' || substr({digest}, 1, 8)) AS UBIGINT) AS DOUBLE) + 1) / CAST(4294967297 AS DOUBLE))"


def normal(seed: int, column: str, key: str) -> str:
    u1, u2 = uniform(seed, column, "n1", key), uniform(seed, column, "n2", key)
    return f"(sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2}))"


def position(seed: int, column: str, tag: str, key: str, size: str) -> str:
    return f"CAST(floor({uniform(seed, column, tag, key)} * CAST({size} AS DOUBLE)) AS BIGINT)"


def pick(values: list[str | None], seed: int, column: str, tag: str, key: str) -> str:
    items = ", ".join("NULL" if v is None else lit(v) for v in values)
    return f"list_extract([{items}], {position(seed, column, tag, key, str(len(values)))} + 1)"


def whole(seed: int, column: str, tag: str, key: str, low: int, high: int) -> str:
    return f"({low} + {position(seed, column, tag, key, str(high - low + 1))})"

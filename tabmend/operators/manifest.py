"""The planned actions, with the counts a person needs to approve them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabmend.functions import fixed
from tabmend.functions.kinds import number, text


def rows_needed(rows: str, minority: str, share: float = fixed.BALANCE_TARGET) -> str:
    """syn_needed and man_forecast, as SQL: rows to add so the class reaches ``share``.

    Zero for an empty table, an unknown class, or a class already that common."""
    missing = f"({number(share)} * {rows} - {minority}) / {number(1 - share)}"
    return f"""
    CASE WHEN {rows} > 0 AND {minority} / nullif({rows}, 0) < {number(share)}
         THEN greatest(CAST({missing} AS BIGINT), 0L) ELSE 0L END"""


def _amount(count: str, template: str) -> str:
    share = f"coalesce(try_divide({count}, rows), 0D) * 100"
    return f"CASE WHEN {count} > 0 THEN format_string({text(template)}, {count}, {share}) END"


def planned_actions(decisions: DataFrame, profile: DataFrame) -> DataFrame:
    """man_actions: (ord, tool, column, description) for every decided column."""
    chosen = decisions.selectExpr(
        "ord",
        "column",
        "strategy",
        "upper(trim(split(strategy, ':')[0])) AS command",
        "substring(strategy, instr(strategy, ':') + 1) AS value",
    )
    known = profile.selectExpr(
        "column",
        "rows",
        "nulls",
        "outliers",
        "minority_n",
        "(kind = 'string' OR coalesce(semantic_type = 'categorical', false)) AS by_mode",
        f"coalesce(try_divide(minority_n, classes_n) < {fixed.MINORITY_LIMIT}D "
        "AND (binary OR is_target), false) AS imbalanced",
    )
    t = chosen.join(known, "column", "left").na.fill(0, ["rows", "nulls", "outliers"])
    parts = (
        f"array_compact(array({_amount('outliers', '%d outliers (%.1f%%)')}, "
        f"{_amount('nulls', '%d NA (%.1f%%)')}))"
    )
    share = "coalesce(try_divide(outliers, rows), 0D) * 100"
    dropped = _amount("nulls", "Drop column (%d NA (%.1f%%), preserves all records)")
    return t.selectExpr("*", f"array_join({parts}, ', ') AS parts").selectExpr(
        "ord",
        f"""CASE
          WHEN command = '{fixed.STATISTICAL_IMPUTE}' THEN 'IMPUTE'
          WHEN command = '{fixed.SYNTHETIC_SYNTHESIS}' THEN 'SYNTHESIS'
          WHEN command IN ('{fixed.DROP}', '{fixed.DROP_COLUMN}') THEN 'DROP'
          ELSE 'MANUAL' END AS tool""",
        "column",
        f"""CASE
          WHEN command = '{fixed.STATISTICAL_IMPUTE}' THEN concat(
            CASE WHEN by_mode THEN 'Mode' ELSE 'Median' END, ' Impute',
            CASE WHEN parts = '' THEN '' ELSE concat(' (', parts, ')') END)
          WHEN command = '{fixed.SYNTHETIC_SYNTHESIS}' AND imbalanced
            THEN format_string({text(fixed.ACTION_SYNTHESIS)}, {rows_needed('rows', 'minority_n')})
          WHEN command = '{fixed.SYNTHETIC_SYNTHESIS}'
            THEN format_string('Gaussian Synthesis (%d outliers (%.1f%%))', outliers, {share})
          WHEN command IN ('{fixed.DROP}', '{fixed.DROP_COLUMN}')
            THEN coalesce({dropped}, 'Drop column (preserves all records)')
          ELSE format_string({text(fixed.ACTION_MANUAL)}, value) END AS description""",
    )


def planned_files(profile: DataFrame, source: str | None, target: str, run_id: str) -> DataFrame:
    """(ord, action, path, description): the table read, the parts created, the ledger written to."""
    made = [(i, fixed.FILE_CREATE, f"{target}/{part}", "") for i, part in enumerate(fixed.EXPORT_PARTS, 1)]
    made.append((len(made) + 1, fixed.FILE_WRITE, f"{target}/ledger", fixed.FILE_STATE.format(run_id=run_id)))
    made = profile.sparkSession.createDataFrame(made, "ord int, action string, path string, description string")
    rows = f"format_string({text(fixed.FILE_ROWS)}, coalesce(rows, 0L)) AS description"
    read = profile.selectExpr("max(rows) AS rows").selectExpr(rows).selectExpr(
        "0 AS ord", f"{text(fixed.FILE_READ)} AS action", f"{text(source or '')} AS path", "description"
    )
    return read.unionByName(made)


def cleaning_actions(entries: DataFrame) -> DataFrame:
    """The CLEAN actions behind the cleaning entries of a ledger."""
    return entries.where("step = 'clean'").selectExpr(
        "-1 AS ord",
        "'CLEAN' AS tool",
        "coalesce(column, 'strings') AS column",
        f"CASE WHEN column IS NULL THEN {text(fixed.ACTION_STRIP)} "
        f"ELSE {text(fixed.ACTION_ALIAS)} END AS description",
    )


def manifest(decisions: DataFrame, profile: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    actions = planned_actions(decisions, profile)
    return actions if entries is None else cleaning_actions(entries).unionByName(actions)

"""One recommended remediation per column with issues: a decision table.

Input is the issues table; everything here is a grouped CASE over its few rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabmend.functions import fixed
from tabmend.functions.kinds import text
from tabmend.session import local_table

DECISIONS_SCHEMA = pa.schema(
    [("ord", pa.int32()), ("column", pa.string()), ("strategy", pa.string())]
)


def group_issues(issues: DataFrame) -> DataFrame:
    """adv_group: one row per column, in the order its first issue was reported."""
    # a handful of rows per column: one task, no shuffle
    return issues.coalesce(1).groupBy("column").agg(
        F.expr("min(ord) AS ord"),
        F.expr("sort_array(collect_list(struct(ord, type, ratio))) AS entries"),
        F.expr("array_join(sort_array(collect_set(type)), ',') AS types"),
        F.expr("count(1) AS n_issues"),
        F.expr(f"coalesce(max(ratio) FILTER (WHERE type = '{fixed.HIGH_NULL_RATIO}'), 0D) AS null_ratio"),
        F.expr(f"min(minority_value) FILTER (WHERE type = '{fixed.CLASS_IMBALANCE}') AS minority_value"),
    )


def _has(kind: str) -> str:
    return f"array_contains(split(types, ','), '{kind}')"


def describe(grouped: DataFrame) -> DataFrame:
    """adv_describe: what is wrong with the column, each kind once, joined by ``&``."""
    percent = "coalesce(e.ratio, 0D) * 100"
    phrase = f"""
    CASE e.type
      WHEN '{fixed.INVALID_BOUNDS}' THEN {text(fixed.ISSUE_BOUNDS)}
      WHEN '{fixed.STATISTICAL_OUTLIER}' THEN {text(fixed.ISSUE_OUTLIER)}
      WHEN '{fixed.CLASS_IMBALANCE}' THEN format_string({text(fixed.ISSUE_IMBALANCE)}, {percent})
      WHEN '{fixed.HIGH_NULL_RATIO}' THEN format_string({text(fixed.ISSUE_NULLS)}, {percent})
      ELSE e.type
    END"""
    firsts = (
        "transform(array_distinct(entries.type), "
        "t -> element_at(filter(entries, e -> e.type = t), 1))"
    )
    return grouped.selectExpr(
        "*", f"array_join(transform({firsts}, e -> {phrase}), ' & ') AS description"
    )


def strategy_rule() -> str:
    """adv_strategy: the first line that applies, as SQL over a grouped issue row."""
    return f"""
    CASE
      WHEN null_ratio >= {fixed.DROP_NULL_RATIO}D THEN '{fixed.DROP}'
      WHEN {_has(fixed.CLASS_IMBALANCE)} THEN '{fixed.SYNTHETIC_SYNTHESIS}'
      WHEN {_has(fixed.STATISTICAL_OUTLIER)} AND NOT {_has(fixed.INVALID_BOUNDS)}
        THEN '{fixed.SYNTHETIC_SYNTHESIS}'
      ELSE '{fixed.STATISTICAL_IMPUTE}'
    END"""


def impact_rule() -> str:
    """adv_impact: what the recommended strategy does; needs a ``dtype`` column."""
    bounds, outlier = _has(fixed.INVALID_BOUNDS), _has(fixed.STATISTICAL_OUTLIER)
    nulls = _has(fixed.HIGH_NULL_RATIO)
    return f"""
    CASE
      WHEN null_ratio >= {fixed.DROP_NULL_RATIO}D
        THEN format_string({text(fixed.IMPACT_DROP)}, null_ratio * 100)
      WHEN {_has(fixed.CLASS_IMBALANCE)}
        THEN format_string({text(fixed.IMPACT_BALANCE)}, coalesce(minority_value, '1'))
      WHEN {bounds} AND {outlier} THEN {text(fixed.IMPACT_BOUNDS_AND_OUTLIER)}
      WHEN {bounds} THEN {text(fixed.IMPACT_BOUNDS)}
      WHEN {outlier} THEN {text(fixed.IMPACT_OUTLIER)}
      WHEN {nulls} AND dtype = 'string' THEN {text(fixed.IMPACT_MODE)}
      WHEN {nulls} THEN {text(fixed.IMPACT_MEDIAN)}
      ELSE {text(fixed.IMPACT_OTHER)}
    END"""


def recommend(issues: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """The decision table: ord, column, types, description, strategy, impact, advice."""
    grouped = describe(group_issues(issues))
    if profile is None:
        grouped = grouped.withColumn("dtype", F.lit(""))
    else:
        grouped = grouped.join(profile.select("column", "dtype"), "column", "left")
    return grouped.selectExpr(
        "ord",
        "column",
        "types",
        "n_issues",
        "null_ratio",
        "description",
        f"{strategy_rule()} AS strategy",
        f"{impact_rule()} AS impact",
    ).selectExpr(
        "*",
        f"format_string({text(fixed.ADVICE_ENTRY)}, column, description, strategy, impact) AS advice",
    )


def advice_text(recommended: DataFrame) -> str:
    """The advice document: one entry per column with issues."""
    rows = sorted(recommended.select("ord", "advice").collect(), key=lambda r: r["ord"])
    if not rows:
        return fixed.ADVICE_NONE
    return "\n\n".join([fixed.ADVICE_HEADER, *(r["advice"] for r in rows)])


def parse_advice(columns: DataFrame, advice: str) -> DataFrame:
    """adv_parse: the strategy that free-text advice names for each column.

    A column's entry runs from its quoted name to the first decision after it,
    without crossing another quoted bullet; anything but a known strategy is
    ignored."""
    name = r"regexp_replace(column, r'([\\^$.|?*+()\[\]{}])', r'\\$1')"
    start = text(r"(?is)['" + '"' + r"]")
    end = text(r"['" + '"' + r"](?:(?!\n\s*•).)*?" + fixed.ADVICE_DECISION)
    found = f"upper(regexp_extract({text(advice)}, concat({start}, {name}, {end}), 1))"
    allowed = ", ".join(text(s) for s in fixed.STRATEGIES)
    return columns.selectExpr("column", f"{found} AS advised").where(f"advised IN ({allowed})")


def advised_strategies(recommended: DataFrame, advice: str = "") -> DataFrame:
    """Recommendations with the advice text, where it names a strategy, in front."""
    if not advice:
        return recommended
    advised = parse_advice(recommended.select("column"), advice)
    return (
        recommended.join(advised, "column", "left")
        .withColumn("strategy", F.coalesce("advised", "strategy"))
        .drop("advised")
    )


def merge_decisions(recommended: DataFrame, decisions: DataFrame) -> DataFrame:
    """adv_merge: a person's decision per column wins over the recommendation.

    ``decisions`` is (column, strategy), for instance an edited decisions table.
    Columns decided without a recommendation come last, by name."""
    mine = decisions.select("column", F.col("strategy").alias("decided"))
    merged = recommended.select("ord", "column", "strategy").join(mine, "column", "full_outer")
    return merged.select(
        F.coalesce("ord", F.lit(2**31 - 1)).alias("ord"),
        "column",
        F.coalesce("decided", "strategy").alias("strategy"),
        F.when(F.col("decided").isNull(), "recommended").otherwise("operator").alias("source"),
    )


def decisions_table(spark, decisions: dict[str, str]) -> DataFrame:
    rows = [{"ord": i, "column": c, "strategy": s} for i, (c, s) in enumerate(decisions.items())]
    return local_table(spark, rows, DECISIONS_SCHEMA)


def as_decisions(table: DataFrame) -> dict[str, str]:
    """A decisions table as an ordered {column: strategy}."""
    rows = sorted(table.select("ord", "column", "strategy").collect(), key=lambda r: (r[0], r[1]))
    return {r["column"]: r["strategy"] for r in rows}

"""Minority-class synthesis: new rows from the distributions of the whole table.

Row i of the new rows is a function of (seed, column, i).  Numbers come from
moments, categories from their distinct values; a list of values that is too
long for a literal stays a table and is joined by position.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tabmend.functions import draws, fixed
from tabmend.functions.kinds import is_numeric, kinds, measure, present, quoted, text, typed
from tabmend.operators.manifest import rows_needed
from tabmend.operators.values import value_counts
from tabmend.spec import ColumnSpec, TableSpec

# Distinct values that may travel as a literal inside the plan.
LITERAL_VALUES = 1_000
# Distinct values per bucket where they are numbered without a global sort.
VALUES_PER_BUCKET = 100_000
# Blocks of places one value is put into by a single row.
BLOCKS_PER_ROW = 1_000_000
ROWS_PER_TASK = 1_000_000

ROW = "__tabmend_i"

# --- fixed values: parts of invented people and places ---------------------
FIRST_NAMES = (
    "Ada", "Bruno", "Carla", "Diego", "Elin", "Farid", "Greta", "Hugo", "Ines", "Jonas",
    "Kira", "Leo", "Mina", "Nils", "Olga", "Pavel", "Quinn", "Rosa", "Sami", "Tara",
)
LAST_NAMES = (
    "Abbot", "Berg", "Castell", "Dorn", "Ekman", "Fabre", "Grant", "Holm", "Ito", "Jansen",
    "Keller", "Lund", "Moreau", "Novak", "Okafor", "Petit", "Rossi", "Silva", "Tanaka", "Weiss",
)
STREETS = ("Oak Street", "Mill Lane", "Station Road", "Park Avenue", "Hill Court", "Lake Drive")
TOWNS = ("Ashford", "Brookfield", "Clifton", "Dunmore", "Eastwood", "Fairview")


@dataclass(frozen=True)
class Balance:
    """syn_needed, with what it was computed from."""

    rows: int
    minority_value: str | None
    minority: int
    needed: int

    @property
    def ratio(self) -> float:
        return self.minority / self.rows if self.rows else 0.0

    @property
    def new_ratio(self) -> float:
        total = self.rows + self.needed
        return (self.minority + self.needed) / total if total else 0.0


def balance_table(
    df: DataFrame, target: str, spec: TableSpec | None = None, ratio: float = fixed.BALANCE_TARGET
) -> DataFrame:
    """syn_needed: rows, minority_value, minority and needed, as one row."""
    kind = kinds(df)[target]
    given = spec.get(target).minority_value if spec and spec.get(target) else None
    cell = present(target, kind)
    counts = df.selectExpr(f"CAST({cell} AS STRING) AS value").groupBy("value")
    size = "try_cast(value AS DOUBLE)" if is_numeric(kind) else "CAST(NULL AS DOUBLE)"
    if given is None:
        chosen = f"min_by(value, CASE WHEN value IS NOT NULL THEN struct(n, {size}, value) END)"
        minority = "min(n) FILTER (WHERE value IS NOT NULL)"
    else:
        chosen = text(given)
        same = f"{size} = try_cast({text(given)} AS DOUBLE)" if is_numeric(kind) else f"value = {text(given)}"
        minority = f"sum(n) FILTER (WHERE {same})"
    return (
        counts.agg(F.expr("count(1) AS n"))
        .selectExpr(
            "coalesce(sum(n), 0L) AS rows",
            f"{chosen} AS minority_value",
            f"coalesce({minority}, 0L) AS minority",
        )
        .selectExpr(
            "*",
            f"CASE WHEN minority_value IS NULL THEN 0L "
            f"ELSE {rows_needed('rows', 'minority', ratio)} END AS needed",
        )
    )


def balance_of(
    df: DataFrame, target: str, spec: TableSpec | None = None, ratio: float = fixed.BALANCE_TARGET
) -> Balance:
    return Balance(*balance_table(df, target, spec, ratio).first())


def synthesize_minority(
    df: DataFrame,
    target: str,
    ratio: float = fixed.BALANCE_TARGET,
    spec: TableSpec | None = None,
    seed: int = fixed.DEFAULT_SEED,
    weighted: bool = False,
) -> tuple[DataFrame, str]:
    """Append the rows that bring the minority class to ``ratio``; and a message.

    Categories are drawn uniformly, or as often as they are seen if ``weighted``."""
    rows, message = minority_rows(df, target, ratio, spec, seed, weighted)
    return df if rows is None else df.unionByName(rows), message


def minority_rows(
    df: DataFrame,
    target: str,
    ratio: float = fixed.BALANCE_TARGET,
    spec: TableSpec | None = None,
    seed: int = fixed.DEFAULT_SEED,
    weighted: bool = False,
) -> tuple[DataFrame | None, str]:
    """The rows that are missing, None if none is; and a message."""
    balance = balance_of(df, target, spec, ratio)
    message = _outcome(balance, ratio).format(
        column=target, n=balance.needed, old=balance.ratio * 100, new=balance.new_ratio * 100
    )
    return (synthetic_rows(df, target, balance, spec, seed, weighted) if balance.needed else None), message


def _outcome(balance: Balance, ratio: float) -> str:
    if balance.needed:
        return fixed.LOG_ROWS
    if not balance.rows:
        return fixed.LOG_ROWS_EMPTY
    if balance.minority_value is None:
        return fixed.LOG_ROWS_CLASS
    return fixed.LOG_ROWS_BALANCED if balance.ratio >= ratio else fixed.LOG_ROWS_NONE


def synthetic_rows(
    df: DataFrame,
    target: str,
    balance: Balance,
    spec: TableSpec | None = None,
    seed: int = fixed.DEFAULT_SEED,
    weighted: bool = False,
) -> DataFrame:
    """syn_rows: ``balance.needed`` new rows with the columns and types of ``df``."""
    spec = spec or TableSpec()
    kind = kinds(df)
    way = {c: _way(c, kind[c], target, spec) for c in df.columns}
    if weighted:
        way = {c: "weighted" if w == "choice" else w for c, w in way.items()}
    numbers = _numbers(df, [c for c, w in way.items() if w in ("normal", "serial")])
    lists = _value_lists(df, [c for c, w in way.items() if w in ("choice", "weighted")])
    slices = max(1, math.ceil(balance.needed / ROWS_PER_TASK))
    rows = df.sparkSession.range(0, balance.needed, numPartitions=slices).withColumnRenamed("id", ROW)
    i = F.col(ROW)
    cells: dict[str, Column] = {}
    for c in df.columns:
        w = way[c]
        if w == "target":
            cells[c] = F.lit(balance.minority_value)
        elif w == "serial":
            cells[c] = _serial(kind[c], balance.rows, numbers.get(c), i)
        elif w == "normal":
            cells[c] = _normal(c, kind[c], spec.bounds(c), numbers[c], seed, i)
        elif w == "person":
            cells[c] = _person(c, seed, i)
        elif w in ("choice", "weighted") and lists[c].size > LITERAL_VALUES:
            rows = lists[c].joined(rows, df, c, seed, w == "weighted")
            cells[c] = F.col(_slot(df, c))
        elif w == "choice" and lists[c].size:
            cells[c] = lists[c].uniform(c, seed, i)
        elif w == "weighted" and lists[c].size:
            cells[c] = lists[c].weighted(c, seed, i)
        else:
            cells[c] = F.lit(None)
    return rows.select(*[typed(df, c, cells[c]).alias(c) for c in df.columns])


def _way(column: str, kind: str, target: str, spec: TableSpec) -> str:
    """Which generator makes a column."""
    if column == target:
        return "target"
    numeric = is_numeric(kind)
    known = spec.get(column) or ColumnSpec(semantic_type="numerical" if numeric else "text")
    if known.role == "id":
        return "serial"
    if known.role == "ignore":
        return "person" if kind == "string" else "none"  # a name is no number
    if known.semantic_type == "binary":
        return "weighted"
    if numeric:
        return "normal"
    if kind == "nested":
        return "none"
    if known.semantic_type == "categorical" or kind == "string":
        return "choice"
    return "none"


def _numbers(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    kind = kinds(df)
    columns = [c for c in columns if is_numeric(kind[c])]
    if not columns:
        return {}
    functions = {"min": "min", "max": "max", "mean": "avg", "std": "stddev_pop"}
    aggregates = [
        f"{f}({measure(c, kind[c])}) AS {s}{i}"
        for i, c in enumerate(columns)
        for s, f in functions.items()
    ]
    # the largest integer itself: a double would lose its last digits
    tops = [
        f"CAST({f'max({quoted(c)})' if kind[c] == 'integer' else 'NULL'} AS BIGINT) AS top{i}"
        for i, c in enumerate(columns)
    ]
    row = df.selectExpr(*aggregates, *tops).first()
    return {c: {s: row[f"{s}{i}"] for s in (*functions, "top")} for i, c in enumerate(columns)}


def _serial(kind: str, rows: int, stats: dict | None, i: Column) -> Column:
    """syn_id: numbers after the table's size plus an offset, and after every
    integer id there is."""
    start = rows + fixed.SYNTHETIC_ID_OFFSET
    if kind == "integer":
        top = stats["top"] if stats else None
        return F.lit(max(start, top + 1) if top is not None else start).cast("bigint") + i
    if is_numeric(kind):
        return (F.lit(start) + i).cast("double")
    return F.concat(F.lit("SYN_"), (F.lit(start) + i).cast("string"))


def _normal(column, kind, bounds, stats: dict, seed: int, i: Column) -> Column:
    """syn_numeric: Normal(mean, std) cut to the domain, or to the seen range."""
    if stats["mean"] is None:
        return F.lit(None)
    low, high = bounds or (None, None)
    low = stats["min"] if low is None else low
    high = stats["max"] if high is None else high
    mean, std = draws.steady(stats["mean"]), draws.steady(stats["std"]) or 1.0
    drawn = draws.normal(seed, column, i) * F.lit(std) + F.lit(mean)
    cut = F.least(F.greatest(drawn, F.lit(float(low))), F.lit(float(high)))
    return cut.cast("bigint") if kind == "integer" else cut


def _person(column: str, seed: int, i: Column) -> Column:
    """syn_pii: invented names, mail and postal addresses; nothing for other text."""
    name = column.lower()
    first = draws.pick(list(FIRST_NAMES), seed, column, "first", i)
    last = draws.pick(list(LAST_NAMES), seed, column, "last", i)
    if "name" in name:
        return F.concat_ws(" ", first, last)
    if "email" in name:
        number = draws.whole(seed, column, "number", i, 1, 999).cast("string")
        return F.concat(F.lower(first), F.lit("."), F.lower(last), number, F.lit("@example.com"))
    if "address" in name:
        number = draws.whole(seed, column, "number", i, 1, 999).cast("string")
        street = draws.pick(list(STREETS), seed, column, "street", i)
        return F.concat(number, F.lit(" "), street, F.lit(", "), draws.pick(list(TOWNS), seed, column, "town", i))
    return F.lit(None)


def _slot(df: DataFrame, column: str) -> str:
    return f"__tabmend_v{df.columns.index(column)}"


@dataclass
class _Values:
    """Distinct values of a column: short ones on the driver, long ones a table."""

    size: int
    cells: int
    table: DataFrame
    rows: list[tuple[str, int]]

    def uniform(self, column: str, seed: int, i: Column) -> Column:
        """syn_categorical: every distinct value equally likely."""
        return draws.pick([v for v, _ in self.rows], seed, column, "u", i)

    def weighted(self, column: str, seed: int, i: Column) -> Column:
        """syn_weighted: values as likely as they are frequent."""
        u = draws.uniform(seed, column, "u", i) * F.lit(float(self.cells))
        choice, upto = None, self.cells
        for value, n in reversed(self.rows):
            upto -= n
            choice = F.lit(value) if choice is None else F.when(u >= upto + n, choice).otherwise(value)
        return choice

    def joined(self, rows: DataFrame, df: DataFrame, column: str, seed: int, weighted: bool) -> DataFrame:
        """A choice from a long list, uniform or as frequent: the values lie one after another,
        each as wide as its weight, and a draw takes the value at its place."""
        slot = _slot(df, column)
        at, block, start, width = (f"{slot}_{x}" for x in ("at", "block", "start", "width"))
        total = self.cells if weighted else self.size
        u = draws.uniform(seed, column, "u", F.col(ROW), digits=13)
        wanted = F.least(F.floor(u * F.lit(float(total))).cast("long"), F.lit(total - 1))
        numbered = number_values(self.table, self.size, weighted).select(
            F.col("value").alias(slot), F.col("at").alias(start), F.col("n").alias(width)
        )
        if not weighted:
            return rows.withColumn(at, wanted).join(numbered.drop(width), F.col(at) == F.col(start), "left").drop(at, start)
        # blocks of the mean width: a value lies in as many as it fills, a hot one in many
        mean = math.ceil(total / self.size)
        last = F.floor((F.col(start) + F.col(width) - 1) / mean).cast("long")
        numbered = numbered.withColumn(
            block, F.explode(F.sequence(F.floor(F.col(start) / mean).cast("long"), last, F.lit(BLOCKS_PER_ROW).cast("long")))
        )
        numbered = numbered.withColumn(
            block, F.explode(F.sequence(F.col(block), F.least(F.col(block) + BLOCKS_PER_ROW - 1, last)))
        )
        rows = rows.withColumn(at, wanted).withColumn(f"{block}_of", F.floor(F.col(at) / mean).cast("long"))
        here = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(width))
        found = rows.join(numbered, (F.col(f"{block}_of") == F.col(block)) & here, "left")
        return found.drop(at, block, f"{block}_of", start, width)


def number_values(values: DataFrame, size: int, weighted: bool = False) -> DataFrame:
    """(value, at, n): values one after another from 0, each ``n`` wide (1, or its count), without
    a global sort.

    Values are hashed to buckets, placed inside their bucket, and shifted by the widths of
    the buckets before it (one row per bucket).  Values are distinct, so buckets are even."""
    buckets = max(1, math.ceil(size / VALUES_PER_BUCKET))
    n = F.col("n") if weighted else F.lit(1).cast("bigint")
    placed = values.select("value", n.alias("n"), F.pmod(F.xxhash64("value"), F.lit(buckets)).alias("bucket"))
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("bucket").alias("of")).agg(F.sum("n").alias("width"))
    starts = starts.select("of", F.coalesce(F.sum("width").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("n").over(inside)).join(starts, F.col("bucket") == F.col("of"))
    return placed.select("value", (F.col("start") + F.col("upto") - F.col("n")).cast("bigint").alias("at"), "n")


def _value_lists(df: DataFrame, columns: list[str]) -> dict[str, _Values]:
    if not columns:
        return {}
    counts = value_counts(df, columns)
    sizes = {
        r["column"]: (r["size"], r["cells"])
        for r in counts.groupBy("column")
        .agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("cells"))
        .collect()
    }
    short = [c for c in columns if 0 < sizes.get(c, (0, 0))[0] <= LITERAL_VALUES]
    rows: dict[str, list] = {c: [] for c in columns}
    if short:
        for r in counts.where(F.col("column").isin(short)).collect():
            rows[r["column"]].append((r["num"] is None, r["num"], r["value"], r["n"]))
    return {
        c: _Values(
            *sizes.get(c, (0, 0)),
            value_counts(df, [c]).select("value", "n"),
            [(value, n) for _, _, value, n in sorted(rows[c])],
        )
        for c in columns
    }

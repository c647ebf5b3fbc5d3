"""Distinct values and their counts.

Values are counted with a partial aggregate before the shuffle, so a value that
fills a third of the table crosses the network once per map task.  Rows are turned
long, (column, value): as text where the values themselves are wanted, and in
their own type, the columns of one type together, where only their number is.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabmend.functions.kinds import is_numeric, kinds, measure, present, text
from tabmend.operators import colstats
from tabmend.session import local_table

# Up to this many (estimated) values a distinct count is taken exactly: the partial
# aggregate leaves next to nothing to shuffle.
FEW_VALUES = 5_000
LONG_TEXT = 32


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, value, num) per non-null cell; ``num`` orders numbers by size.

    Wide tables are read in groups of columns, each scan reading its own only."""
    groups = [
        columns[i : i + colstats.COLUMNS_PER_SCAN]
        for i in range(0, len(columns), colstats.COLUMNS_PER_SCAN)
    ]
    return reduce(DataFrame.unionAll, [_long_group(df, group) for group in groups])


def _long_group(df: DataFrame, columns: list[str]) -> DataFrame:
    kind = kinds(df)
    cells = []
    for name in columns:
        k = kind[name]
        size = measure(name, k) if is_numeric(k) else "CAST(NULL AS DOUBLE)"
        cells.append(
            f"named_struct('ord', {df.columns.index(name)}, "
            f"'value', CAST({present(name, k)} AS STRING), 'num', {size})"
        )
    return df.selectExpr(f"inline(array({', '.join(cells)}))").where("value IS NOT NULL")


def _key(cell: str, dtype: T.DataType) -> str:
    """The cell in its own type; a long string by its digest, so that texts don't
    cross the network to be told apart."""
    if isinstance(dtype, T.StringType):
        digest = f"concat('#md5:', md5({cell}))"
        return f"CASE WHEN length({cell}) <= {LONG_TEXT} THEN {cell} ELSE {digest} END"
    if isinstance(dtype, T.VariantType):  # can't be grouped
        return f"CAST({cell} AS STRING)"
    return cell


def _named(df: DataFrame, counted: DataFrame) -> DataFrame:
    names = ", ".join(text(c) for c in df.columns)
    return counted.selectExpr(
        "ord", f"element_at(array({names}), ord + 1) AS column", "value", "num", "n"
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prof_value_counts: (ord, column, value, num, n) over non-null cells."""
    names = columns if columns is not None else countable(df)
    counted = _long(df, names).groupBy("ord", "value", "num").agg(F.expr("count(1) AS n"))
    return _named(df, counted)


def countable(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind != "nested"]


def unique_sizes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ord, n_unique, filled) of the columns that have values.

    Columns whose cells have one type share a scan and an exchange by (column, value),
    in groups of columns; every cell keeps its own type, so nothing is told apart or put together
    by a cast.  A value that fills a column crosses the network once per map task."""
    kind = kinds(df)
    by_type: dict[str, list[str]] = {}
    cells = {}
    for name in columns:
        dtype = df.schema[name].dataType
        cells[name] = _key(present(name, kind[name]), dtype)
        by_type.setdefault(_key_type(dtype), []).append(name)
    parts = []
    for names in by_type.values():
        for i in range(0, len(names), colstats.COLUMNS_PER_SCAN):
            group = names[i : i + colstats.COLUMNS_PER_SCAN]
            parts.append(_sizes(df, {df.columns.index(n): cells[n] for n in group}))
    return reduce(DataFrame.unionAll, parts)


def _key_type(dtype: T.DataType) -> str:
    """The type that ``_key`` gives a cell."""
    return "string" if isinstance(dtype, T.VariantType) else dtype.simpleString()


def _sizes(df: DataFrame, cells: dict[int, str]) -> DataFrame:
    """One scan and one exchange for cells of one type."""
    if len(cells) == 1:
        long = df.selectExpr(*[f"{i} AS ord" for i in cells], *[f"{cell} AS value" for cell in cells.values()])
    else:
        each = ", ".join(f"named_struct('ord', {i}, 'value', {cell})" for i, cell in cells.items())
        long = df.selectExpr(f"inline(array({each}))")
    counted = long.where("value IS NOT NULL").groupBy("ord", "value").agg(F.expr("count(1) AS n"))
    return counted.groupBy("ord").agg(F.expr("count(1) AS n_unique"), F.expr("sum(n) AS filled"))


def unique_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prof_nunique: exact distinct non-null count and uniqueness per column; a
    column without any value counts zero."""
    names = columns if columns is not None else countable(df)
    listed = local_table(
        df.sparkSession,
        [{"ord": df.columns.index(n), "column": n} for n in names],
        pa.schema([("ord", pa.int32()), ("column", pa.string())]),
    )
    return listed.join(unique_sizes(df, names), "ord", "left").selectExpr(
        "ord",
        "column",
        "coalesce(n_unique, 0) AS n_unique",
        "coalesce(filled, 0) AS filled",
        "coalesce(try_divide(n_unique, filled), 0D) AS uniqueness",
    )


def extremes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """inf_minority / mode: least and most frequent value per column.

    Ties go to the smaller value: by number for numbers, else by text."""
    return (
        value_counts(df, columns)
        .groupBy("ord", "column")
        .agg(
            F.expr("count(1) AS n_unique"),
            F.expr("sum(n) AS filled"),
            F.expr("min_by(value, struct(n, num, value)) AS minority_value"),
            F.expr("min(n) AS minority_n"),
            F.expr("min_by(value, struct(-n, num, value)) AS mode_value"),
            F.expr("max(n) AS mode_n"),
        )
    )


def unique_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """prof_unique_values: every distinct value of the string columns, long form."""
    kind = kinds(df)
    names = [n for n in (columns or df.columns) if kind[n] == "string"]
    return value_counts(df, names).select("ord", "column", "value")

"""Type classes, and the per-column SQL text every operator shares.

Operators that build one expression per column write it as SQL text: a table of
hundreds of columns then costs one call into the JVM, not thousands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

_INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)

NUMERIC_KINDS = ("integer", "float", "decimal")


def kind_of(dtype: T.DataType) -> str:
    """integer, float, decimal, string, boolean, nested or other."""
    if isinstance(dtype, _INTEGER):
        return "integer"
    if isinstance(dtype, _FLOAT):
        return "float"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _NESTED):
        return "nested"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC_KINDS


def quoted(name: str) -> str:
    """A column name as SQL, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    """A double as a SQL literal, digit for digit."""
    value = float(value)
    if math.isfinite(value):
        return f"{value!r}D"
    return f"CAST('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}' AS DOUBLE)"


def present(name: str, kind: str) -> str:
    """The cell value with NaN read as missing."""
    if kind == "float":
        return f"nanvl({quoted(name)}, NULL)"
    return quoted(name)


def measure(name: str, kind: str) -> str:
    """The cell value as a double, for statistics."""
    return f"CAST({present(name, kind)} AS DOUBLE)"


def ref(name: str) -> Column:
    return F.col(quoted(name))


def typed(df: DataFrame, name: str, value: Column) -> Column:
    return value.cast(df.schema[name].dataType)

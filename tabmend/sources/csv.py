"""CSV in and out.  Parquet needs nothing beyond ``spark.read`` and ``df.write``."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tabmend.functions import fixed
from tabmend.functions.kinds import kinds, ref
from tabmend.session import local_table

BAD_ROW = "_corrupt_record"


class InvalidInput(ValueError):
    """The input cannot be profiled: missing, empty, without columns, or ragged."""


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, multiline: bool = False
) -> DataFrame:
    """src_csv: types from a scan of all rows, or a known ``schema`` (which saves
    that scan); a cell that does not parse is null.

    Dates stay text, decimals become doubles.  ``multiline`` allows line breaks
    inside quotes, at the price of files that cannot be split between tasks."""
    options = {"header": True, "multiLine": multiline, "mode": "PERMISSIVE", "escape": '"'}
    # a cell without quotes and text is null, one of two quotes is blank
    options |= {"nullValue": "\0", "emptyValue": ""}
    if schema is None:
        seen = spark.read.options(inferSchema=True, **options).csv(path).schema
        schema = T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in seen.fields])
    return spark.read.options(**options).schema(schema).csv(path)


def _plain(dtype: T.DataType) -> T.DataType:
    if isinstance(dtype, T.DecimalType):
        return T.DoubleType()
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return T.StringType()
    return dtype


def rejected_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """src_validate: the rows with more or fewer fields than the header, as text."""
    options = {"header": True, "multiLine": multiline, "escape": '"'}
    try:
        names = spark.read.options(**options).csv(path).columns
    except AnalysisException as e:
        raise InvalidInput(f"cannot read '{path}': {e}") from e
    if not names:
        raise InvalidInput(f"'{path}' is empty or has no columns")
    fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
    schema = T.StructType([*fields, T.StructField(BAD_ROW, T.StringType())])
    rows = (
        spark.read.options(
            mode="PERMISSIVE",
            columnNameOfCorruptRecord=BAD_ROW,
            enforceSchema=True,
            columnPruning=False,
            **options,
        )
        .schema(schema)
        .csv(path)
    )
    # the reader refuses plans that use the corrupt-record column alone, so the
    # filter reads a data column too
    read = F.length(F.concat_ws("", F.col("c0"), F.col(BAD_ROW))) >= 0
    return rows.where(F.col(BAD_ROW).isNotNull() & read).select(F.col(BAD_ROW).alias("row"))


def validate_csv(spark: SparkSession, path: str, multiline: bool = False) -> str:
    """Reject a missing, empty, column-less or ragged input; the path otherwise."""
    bad = rejected_rows(spark, path, multiline).limit(1).collect()
    if bad:
        raise InvalidInput(f"'{path}' has ragged rows, for instance: {bad[0]['row']}")
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """snk_csv: one file per partition, with a header, spaces kept."""
    (
        df.write.mode("overwrite")
        .options(
            header=True,
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            escape='"',
        )
        .csv(path)
    )
    return path


def sample_rows(df: DataFrame, key: list[str], size: int = fixed.SAMPLE_SIZE) -> DataFrame:
    """src_sample_rows: the first rows in key order (a bounded top-k per task)."""
    return df.orderBy(*[ref(k) for k in key]).limit(size)


def sample_values(
    df: DataFrame, key: list[str], columns: list[str] | None = None, size: int = fixed.SAMPLE_SIZE
) -> DataFrame:
    """The first non-null values of each column in key order: (ord, column, values).

    One bounded top-k per column, each reading only that column and the key."""
    kind = kinds(df)
    names = [c for c in (columns or df.columns) if kind[c] != "nested"]
    tops = [
        df.where(ref(c).isNotNull())
        .select(
            F.lit(df.columns.index(c)).alias("ord"),
            F.lit(c).alias("column"),
            F.struct(*[ref(k).alias(f"k{i}") for i, k in enumerate(key)]).alias("key"),
            ref(c).cast("string").alias("value"),
        )
        .orderBy("key", "value")
        .limit(size)
        for c in names
    ]
    first = F.sort_array(F.collect_list(F.struct("key", "value")))
    found = (
        reduce(DataFrame.unionByName, tops)
        .groupBy("ord", "column")
        .agg(F.array_join(F.transform(first, lambda x: x["value"]), " | ").alias("samples"))
    )
    listed = local_table(
        df.sparkSession,
        [{"ord": df.columns.index(c), "column": c} for c in names],
        pa.schema([("ord", pa.int32()), ("column", pa.string())]),
    )
    return listed.join(found, ["ord", "column"], "left").withColumn(
        "samples", F.coalesce("samples", F.lit(""))
    )

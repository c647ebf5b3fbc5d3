"""A stable text key per row, for draws, without a driver-side row number.

With an identifying column the key is that column, else a 128-bit digest of the row.  Only keys are counted:
a row whose key is its own stays where it is.  Rows that share a key are told apart by all their
columns; equal ones are interchangeable, so they are counted and spread out again with copy numbers
0..n-1: the set of keyed rows does not depend on partitioning or retries.  A row
that is copied millions of times is spread over many tasks in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabmend.functions.kinds import ref

COPIES_PER_CHUNK = 1_000_000
ROW_KEY = "__tabmend_key"
_COPIES, _CHUNK, _AGAIN = "__tabmend_copies", "__tabmend_chunk", "__tabmend_again"


def key_of(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(ref(c).cast("string"), F.lit("")) for c in columns])


def _hashable(df: DataFrame, column: str) -> Column:
    """A value that can be hashed: entries in order for a map, JSON for what holds one."""
    kind = df.schema[column].dataType
    if "map<" not in kind.simpleString():
        return ref(column)
    if isinstance(kind, T.MapType) and "map<" not in kind.valueType.simpleString():
        return F.sort_array(F.map_entries(ref(column)))
    return F.to_json(F.struct(ref(column)))


def digest_of(df: DataFrame) -> Column:
    """128 bits of all columns, as text.  Rows that differ may share it; they count as repeated then."""
    cells = [F.coalesce(ref(c).cast("string"), F.lit("\x1e")) for c in df.columns]
    return F.md5(F.concat_ws("\x1f", *cells))


def with_row_key(df: DataFrame, id_columns: list[str]) -> DataFrame:
    """``df`` with the text column ``ROW_KEY``, different for every row.

    Rows whose identifying columns are null, or repeat those of other rows, are told
    apart by all their columns and a copy number, as are all rows where there is no such column."""
    keyed = df.withColumn(ROW_KEY, key_of(id_columns) if id_columns else digest_of(df))
    again = keyed.groupBy(F.col(ROW_KEY).alias(_AGAIN)).agg(F.count(F.lit(1)).alias(_COPIES))
    again = again.where(F.col(_COPIES) > 1).select(_AGAIN)
    if again.isEmpty():
        return keyed
    same = F.col(ROW_KEY) == F.col(_AGAIN)
    rest = _numbered(keyed.join(again, same, "left_semi").drop(ROW_KEY))
    return keyed.join(again, same, "left_anti").unionByName(rest.withColumn(ROW_KEY, F.concat(F.lit("again|"), ROW_KEY)))


def _numbered(df: DataFrame) -> DataFrame:
    names = df.columns
    counted = df.groupBy(*[ref(c) for c in names]).agg(F.count(F.lit(1)).alias(_COPIES))
    last_chunk = F.expr(f"({_COPIES} - 1) div {COPIES_PER_CHUNK}")
    chunked = counted.withColumn(_CHUNK, F.explode(F.sequence(F.lit(0).cast("bigint"), last_chunk)))
    # A chunk is one small row that becomes a million: a fixed number of partitions,
    # because adaptive execution would merge partitions that look empty.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = chunked.repartition(tasks, F.xxhash64(*[_hashable(df, c) for c in names]), F.col(_CHUNK))
    start = F.col(_CHUNK) * COPIES_PER_CHUNK
    end = F.least(start + COPIES_PER_CHUNK, F.col(_COPIES)) - 1
    copies = spread.withColumn(_CHUNK, F.explode(F.sequence(start, end)))
    key = F.concat_ws("|", digest_of(df), F.col(_CHUNK))
    return copies.withColumn(ROW_KEY, key).drop(_COPIES, _CHUNK)

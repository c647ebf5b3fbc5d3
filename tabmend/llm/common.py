"""What the operators share: words, ids, and tables that cut lineage."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmend.session import shared_folder

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shipped(module: str) -> None:
    """Sends this module's functions to the tasks with the plan, so that executors need no copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def full(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(full(text), F.lit(WORD), F.lit(0))


def ordered(key: Column) -> Column:
    """A value that sorts like the id, null last, and is itself never null."""
    return F.struct(key.isNull().alias("none"), key.alias("id"))


class Workspace:
    """A fresh folder below ``spark.checkpoint.dir`` for one call's tables.

    A written table ends its lineage: a lost executor costs the tasks that read it,
    not the work that made it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0
        self.tables: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def discard(self, *gone: DataFrame) -> None:
        """Deletes stored tables that nothing reads any more, now or later."""
        for table, path in [x for x in self.tables if any(x[0] is g for g in gone)]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.tables = [x for x in self.tables if not any(x[0] is g for g in gone)]

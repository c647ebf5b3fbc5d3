"""Session helpers: a configured session, small driver tables, the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tabmend", **conf) -> SparkSession:
    """A session with the settings the engine is written for.  On a cluster the
    master and sizes come from spark-submit; nothing here fixes a partition count."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # a stack trace per column expression is the largest cost of building a plan
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Where that is unset, a session whose tasks run in this process gets one local folder
    as its ``spark.checkpoint.dir``; on a cluster, whose executors would not see such a
    folder, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tabmend-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tabmend-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one call, below ``spark.checkpoint.dir``.

    A written table ends its lineage: a lost executor costs the tasks that read it, and what
    later steps see doesn't change when tasks run again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, shared_folder(spark), 0

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        """Delete all tables of the call; only once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A driver-side table of a few rows (one per column, issue or decision).

    Arrow input becomes a LocalRelation, so projections and filters over it are
    folded by Catalyst without a job."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))

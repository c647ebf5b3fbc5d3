"""The audit ledger: one row per recorded step, (run_id, seq).

A run has a folder of its own.  Recording it again, after a retry or once it has got further, replaces its
rows and no others, so every run counts once."""

from __future__ import annotations

from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabmend.session import local_table

LEDGER_SCHEMA = pa.schema(
    [
        ("run_id", pa.string()),
        ("seq", pa.int64()),
        ("at", pa.string()),
        ("step", pa.string()),
        ("column", pa.string()),
        ("message", pa.string()),
        ("state", pa.string()),
        ("source", pa.string()),
        ("target", pa.string()),
        ("seed", pa.int64()),
    ]
)


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="milliseconds")


def ledger_table(
    spark: SparkSession,
    run_id: str,
    entries: list[dict],
    state: str,
    source: str | None = None,
    target: str | None = None,
    seed: int | None = None,
    first: int = 0,
) -> DataFrame:
    """``entries`` are dicts with step, column and message; ``at`` if known."""
    shared = {"run_id": run_id, "state": state, "source": source, "target": target, "seed": seed}
    rows = [
        {"seq": first + i, "at": e.get("at") or now(), **shared, **{k: e.get(k) for k in ("step", "column", "message")}}
        for i, e in enumerate(entries)
    ]
    return local_table(spark, rows, LEDGER_SCHEMA)


def append(ledger: DataFrame, path: str) -> None:
    """Records the runs of ``ledger`` below ``path``; other runs stay as they are."""
    # the prefix keeps Spark from reading an id of digits as a number
    runs = ledger.withColumn("run", F.concat(F.lit("run-"), "run_id")).coalesce(1)
    runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def status(ledger: DataFrame, run_id: str | None = None) -> DataFrame:
    """ledger_status: files, state, times, duration and seed of one run or of all."""
    rows = ledger if run_id is None else ledger.where(F.col("run_id") == run_id)
    # an entry that was recorded twice counts once, as it was recorded last
    steps = ["run_id", "seq"]
    rest = F.struct("at", *[c for c in LEDGER_SCHEMA.names if c not in ("at", *steps)])
    rows = rows.groupBy(*steps).agg(F.max_by(rest, F.col("at")).alias("entry")).select(*steps, "entry.*")
    started, ended = F.min("at"), F.max("at")
    seconds = F.unix_millis(ended.cast("timestamp")) - F.unix_millis(started.cast("timestamp"))
    state = F.max_by("state", "seq")
    return rows.groupBy("run_id").agg(
        F.max("source").alias("source"),
        F.max("target").alias("target"),
        (state == "completed").alias("is_completed"),
        (state == "waiting").alias("is_waiting"),
        started.alias("start_time"),
        F.when(state == "completed", ended).alias("end_time"),
        F.when(state == "completed", seconds / 1000).alias("duration_sec"),
        F.max("seed").alias("seed"),
        F.count(F.lit(1)).alias("entries"),
    )

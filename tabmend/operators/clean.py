"""Deterministic cleaning: whitespace and alias spellings, no decision needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from tabmend.functions import fixed
from tabmend.functions.kinds import kinds, ref
from tabmend.functions.text import strip
from tabmend.operators.infer import infer_rules
from tabmend.spec import TableSpec

# Up to this many pairs are a CASE inside the scan's generated code.
CASE_PAIRS = 32
# Dictionaries up to this many pairs and bytes are broadcast to the tasks; larger ones are joined by a shuffle.
BROADCAST_PAIRS = 100_000
BROADCAST_BYTES = 16 << 20
# Most frequent values that are looked up before that shuffle.
HOT_VALUES = 1_000
_BEFORE = "__tabmend_before"
_ALIAS, _CANONICAL = "__tabmend_alias", "__tabmend_canonical"
_HOT, _HOT_CANONICAL, _CELLS = "__tabmend_hot", "__tabmend_hot_canonical", "__tabmend_cells"


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in kinds(df).items() if kind == "string"]


def strip_strings(df: DataFrame) -> DataFrame:
    """cln_strip: both ends of every string column; blank becomes empty, not null."""
    changed = {name: strip(ref(name)) for name in string_columns(df)}
    return df.withColumns(changed) if changed else df


def replace_aliases(df: DataFrame, spec: TableSpec) -> DataFrame:
    """cln_alias: exact match, one pass, no chaining; other values unchanged."""
    for name in df.columns:
        column = spec.get(name)
        if not column or not column.aliases:
            continue
        if len(column.aliases) <= CASE_PAIRS:
            swap = ref(name)
            for alias, canonical in column.aliases.items():
                swap = F.when(ref(name) == alias, canonical).otherwise(swap)
            df = df.withColumn(name, swap)
            continue
        pairs = spec.alias_df(df.sparkSession).where(F.col("column") == name)
        known = pairs.select(F.col("alias").alias(_ALIAS), F.col("canonical").alias(_CANONICAL))
        if len(column.aliases) <= BROADCAST_PAIRS and _bytes(column.aliases) <= BROADCAST_BYTES:
            df = _swapped(df, name, F.broadcast(known))
        else:
            settled, rest = split_hot(df, name, known, column.aliases)
            df = settled.unionByName(_swapped(rest, name, known))
    return df


def _bytes(aliases: dict[str, str]) -> int:
    return sum(len(text.encode()) for pair in aliases.items() for text in pair)


def _swapped(df: DataFrame, name: str, known: DataFrame) -> DataFrame:
    joined = df.join(known, ref(name) == F.col(_ALIAS), "left")
    return joined.withColumn(name, F.coalesce(F.col(_CANONICAL), ref(name))).drop(_ALIAS, _CANONICAL)


def split_hot(df: DataFrame, name: str, known: DataFrame, aliases: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose cell is settled where they lie, already replaced, and the rest for a join with ``known``.

    Settled are nulls, cells longer than every alias, and the most frequent values, which are looked
    up once and broadcast: at most ``HOT_VALUES`` and at most ``BROADCAST_BYTES``, by the longest pair.  None of
    them is shuffled, so no key of the join is frequent: a value beyond the k most frequent
    holds at most one cell in k."""
    longest = max(map(len, aliases))
    widest = 4 * (longest + max(map(len, aliases.values())))  # a code point takes up to 4 bytes
    most = max(1, min(HOT_VALUES, BROADCAST_BYTES // widest))
    cell = ref(name)
    short = cell.isNotNull() & (F.char_length(cell) <= longest)
    counts = df.where(short).groupBy(cell.alias(_HOT)).agg(F.count(F.lit(1)).alias(_CELLS))
    hot = counts.orderBy(F.desc(_CELLS), _HOT).limit(most).select(_HOT)
    hot = known.join(F.broadcast(hot), F.col(_ALIAS) == F.col(_HOT), "right")
    hot = F.broadcast(hot.select(_HOT, F.coalesce(_CANONICAL, _HOT).alias(_HOT_CANONICAL)))
    marked = df.join(hot, cell == F.col(_HOT), "left")
    settled = marked.where(~F.coalesce(short, F.lit(False)) | F.col(_HOT).isNotNull())
    settled = settled.withColumn(name, F.coalesce(F.col(_HOT_CANONICAL), cell)).drop(_HOT, _HOT_CANONICAL)
    return settled, df.where(short).join(hot, cell == F.col(_HOT), "left_anti")


def clean_messages(df: DataFrame, spec: TableSpec) -> list[dict]:
    """What cleaning did, as ledger entries (step, column, message)."""
    strings = string_columns(df)
    entries = []
    if strings:
        entries.append(
            {
                "step": "clean",
                "column": None,
                "message": fixed.LOG_STRIP.format(n=len(strings)),
            }
        )
    for name in df.columns:
        column = spec.get(name)
        if column and column.aliases:
            canonicals = list(dict.fromkeys(column.aliases.values()))
            entries.append(
                {
                    "step": "clean",
                    "column": name,
                    "message": fixed.LOG_ALIAS.format(
                        n=len(column.aliases), column=name, canonicals=canonicals
                    ),
                }
            )
    return entries


def observe_clean(df: DataFrame, spec: TableSpec) -> tuple[DataFrame, Observation, dict[str, tuple[str, str]]]:
    """The cleaned frame with counts of the cells that each step changes, taken by the job that writes it.

    The counts are metrics of one node of the plan, so they cost no scan; ``changed_cells`` reads
    them once that job has run."""
    asked: dict[str, tuple[str, str]] = {}
    counts, before = [], {}
    for name in string_columns(df):
        i = len(before)
        before[f"{_BEFORE}{i}"] = ref(name)
        was, column = F.col(f"{_BEFORE}{i}"), spec.get(name)
        asked[f"strip{i}"] = ("strip", name)
        counts.append(F.count_if(strip(was) != was).alias(f"strip{i}"))
        if column and column.aliases:
            asked[f"alias{i}"] = ("alias", name)
            counts.append(F.count_if(ref(name) != strip(was)).alias(f"alias{i}"))
    observation = Observation()
    if not counts:
        return replace_aliases(df, spec), observation, asked
    cleaned = replace_aliases(_keep(df, before), spec)
    return cleaned.observe(observation, *counts).drop(*before), observation, asked


def _keep(df: DataFrame, before: dict) -> DataFrame:
    """Stripped strings beside what they were."""
    stripped = {name: strip(ref(name)) for name in string_columns(df)}
    return df.withColumns(before).withColumns(stripped)


def changed_cells(observation: Observation, asked: dict[str, tuple[str, str]]) -> list[dict]:
    """Ledger entries with the cells replaced, one for each column and step that changed any."""
    if not asked:
        return []
    found = observation.get
    templates = {"strip": fixed.LOG_STRIPPED_CELLS, "alias": fixed.LOG_ALIASED_CELLS}
    return [
        {"step": "clean", "column": name, "message": templates[what].format(n=found[key], column=name), "cells": found[key], "what": what}
        for key, (what, name) in asked.items()
        if found[key]
    ]


def clean(df: DataFrame, spec: TableSpec | None = None) -> tuple[DataFrame, list[dict]]:
    """cln_pipeline: strip, then aliases; the schema is inferred when not given."""
    spec = spec if spec is not None else infer_rules(df)
    return replace_aliases(strip_strings(df), spec), clean_messages(df, spec)

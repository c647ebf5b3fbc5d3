"""Inputs of the registered queries.

The given tables hold no nulls and few anomalies, so most queries read the
dirty view: one row per customer with missing, impossible and extreme values,
spelling variants and a rare class.  Its text runs on both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# column -> (kind, expression over customer); {s} is the engine's string type
DIRTY = {
    "customer_id": ("string", "concat('CUST_', cast(c_custkey + 1000 AS {s}))"),
    "name": ("string", "c_name"),
    "age": (
        "integer",
        "CASE WHEN c_custkey % 9 = 4 THEN NULL WHEN c_custkey % 20 = 3 THEN -1 - (c_custkey % 10) "
        "WHEN c_custkey % 33 = 7 THEN 150 + (c_custkey % 151) ELSE 18 + (c_custkey % 53) END",
    ),
    "balance": (
        "float",
        "CASE WHEN c_custkey % 4 = 1 THEN NULL "
        "WHEN c_custkey % 97 = 5 THEN c_acctbal * 10 + 5000000 ELSE c_acctbal END",
    ),
    "sparse": ("float", "CASE WHEN c_custkey % 10 < 6 THEN NULL ELSE c_acctbal END"),
    "country": (
        "string",
        "CASE c_custkey % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'USA' WHEN 2 THEN 'United States' "
        "WHEN 3 THEN 'united states ' WHEN 4 THEN 'U.S.' ELSE NULL END",
    ),
    "market": (
        "string",
        "CASE c_custkey % 5 WHEN 0 THEN 'UK' WHEN 1 THEN 'United Kingdom' WHEN 2 THEN 'SAR' "
        "WHEN 3 THEN 'South Africa' ELSE 'Peru' END",
    ),
    "segment": (
        "string",
        "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN concat('  ', lower(c_mktsegment)) "
        "ELSE concat(c_mktsegment, ' ') END",
    ),
    "nation_code": ("integer", "c_nationkey"),
    "churn": ("integer", "CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END"),
}

# the given tables the profile queries read as they are
TABLES = {
    "customer": {
        "c_custkey": "integer",
        "c_name": "string",
        "c_nationkey": "integer",
        "c_acctbal": "float",
        "c_mktsegment": "string",
    },
    "part": {
        "p_partkey": "integer",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "integer",
        "p_retailprice": "float",
    },
    "orders": {
        "o_orderkey": "integer",
        "o_custkey": "integer",
        "o_orderstatus": "string",
        "o_totalprice": "float",
        "o_orderdate": "other",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "integer",
        "l_partkey": "integer",
        "l_suppkey": "integer",
        "l_linenumber": "integer",
        "l_quantity": "float",
        "l_extendedprice": "float",
        "l_discount": "float",
        "l_tax": "float",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "other",
    },
    "events": {
        "event_id": "integer",
        "ts": "other",
        "user_id": "integer",
        "event_type": "string",
        "value": "float",
        "props": "string",
    },
    "documents": {
        "doc_id": "integer",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "integer",
    },
    "labels": {"doc_id": "integer", "quality": "integer", "toxic": "integer"},
    "conversations": {
        "conv_id": "integer",
        "turn": "integer",
        "role": "string",
        "text": "string",
    },
    "embeddings": {"vec_id": "integer", "embedding": "nested", "label": "integer"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [f"{e.format(s='string')} AS {c}" for c, (_, e) in DIRTY.items()]
    return table(spark, sf_dir, "customer").selectExpr(*exprs)


def dirty_sql() -> str:
    items = ", ".join(f"{e.format(s='varchar')} AS {c}" for c, (_, e) in DIRTY.items())
    return f"SELECT {items} FROM customer"


def dirty_kinds() -> dict[str, str]:
    return {c: kind for c, (kind, _) in DIRTY.items()}

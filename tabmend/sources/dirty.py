"""Dirty sample customers: missing, negative and huge ages, extreme salaries,
spelling variants, a rare positive class.  One row per key, reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabmend.functions import draws, fixed
from tabmend.operators.synthesize import FIRST_NAMES, LAST_NAMES


def dirty_customers(keys: DataFrame, key: str, seed: int = fixed.DEFAULT_SEED) -> DataFrame:
    """src_dirty_gen: a dirty customer for every row of ``keys``; for n rows pass
    ``spark.range(n)`` and key ``id``."""
    k = F.col(key)

    def u(column: str, tag: str = "u") -> Column:
        return draws.uniform(seed, column, tag, k)

    def whole(column: str, tag: str, low: int, high: int) -> Column:
        return draws.whole(seed, column, tag, k, low, high)

    negative, huge, no_age = fixed.DIRTY_AGE_CUTS
    age = (
        F.when(u("age") < negative, -whole("age", "negative", 1, 10))
        .when(u("age") < huge, whole("age", "huge", 150, 300))
        .when(u("age") >= no_age, whole("age", "plain", 18, 70))
    )
    extreme, no_salary = fixed.DIRTY_SALARY_CUTS
    salary = (
        F.when(u("salary") < extreme, whole("salary", "extreme", 5_000_000, 20_000_000))
        .when(u("salary") >= no_salary, whole("salary", "plain", 35_000, 180_000))
    )
    city = draws.pick(list(fixed.DIRTY_CITIES), seed, "city", "pick", k)
    name = F.concat_ws(
        " ",
        draws.pick(list(FIRST_NAMES), seed, "name", "first", k),
        draws.pick(list(LAST_NAMES), seed, "name", "last", k),
    )
    return keys.select(
        F.concat(F.lit("CUST_"), (k + 1000).cast("string")).alias("customer_id"),
        name.alias("name"),
        age.alias("age"),
        salary.alias("salary"),
        F.when(u("city") > fixed.DIRTY_CITY_MISSING, city).alias("city"),
        draws.pick(list(fixed.DIRTY_COUNTRIES), seed, "country", "pick", k).alias("country"),
        F.when(u("churn") < fixed.DIRTY_CHURN_RATE, 1).otherwise(0).alias("churn"),
    )

"""Reproducible draws.

A draw is a function of (seed, column, tag, row key), through md5.  It does not
depend on partitioning, task retries or the order of rows, so a lost executor
recomputes exactly the same values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def steady(statistic: float | None) -> float | None:
    """A statistic to 12 digits.  Sums of doubles differ in the last digits with
    the order in which partial sums arrive; draws must not."""
    return None if statistic is None else float(f"{statistic:.12g}")


def uniform(seed: int, column: str, tag: str, key: Column, digits: int = 8) -> Column:
    """Uniform double in the open interval (0, 1), from ``digits`` hex digits (at
    most 13, the precision of a double)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|{column}|{tag}|"), key.cast("string")))
    word = F.conv(F.substring(digest, 1, digits), 16, 10).cast("double")
    return (word + 1.0) / F.lit(float(16**digits + 1))


def normal(seed: int, column: str, key: Column) -> Column:
    """Standard normal deviate (Box-Muller over two uniforms)."""
    u1, u2 = uniform(seed, column, "n1", key), uniform(seed, column, "n2", key)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * F.pi() * u2)


def position(seed: int, column: str, tag: str, key: Column, size: int) -> Column:
    """Uniform 0-based position in a list of ``size`` entries."""
    return F.floor(uniform(seed, column, tag, key) * F.lit(float(size))).cast("long")


def pick(values: list, seed: int, column: str, tag: str, key: Column) -> Column:
    """Uniform choice from a short literal list (which may hold nulls)."""
    options = F.array(*[F.lit(v) for v in values])
    index = position(seed, column, tag, key, len(values)) + 1
    return F.try_element_at(options, index.cast("int"))


def whole(seed: int, column: str, tag: str, key: Column, low: int, high: int) -> Column:
    """Uniform integer in [low, high]."""
    return position(seed, column, tag, key, high - low + 1) + F.lit(low).cast("long")

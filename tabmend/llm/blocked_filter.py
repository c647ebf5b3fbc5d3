"""A blocked Bloom filter of a table's keys, built and probed with plain columns.

A hash picks one of at most ``max_blocks`` blocks of 256 bits, and a second hash one bit in each of its eight
words.  The filter is a bounded table, so it is broadcast: rows whose key is surely not in the
table are told apart without moving them.  The others have to be joined exactly.  A filter that is too small for
its keys passes more rows; that costs time, never a result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each key, and blocks it has at most (32 bytes of bits each).
BITS, MAX_BLOCKS = 12, 1 << 20
BLOCK_BITS, WORDS = 256, 4  # four longs of two words each


def _places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a key and the bits that it sets there, one in each half of each long."""
    bits = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("long")
    at = lambda i: F.shiftrightunsigned(bits, 5 * i).bitwiseAND(31).cast("int")
    shift = lambda n: F.call_function("shiftleft", one, n)
    longs = [shift(at(2 * j)).bitwiseOR(shift(at(2 * j + 1) + 32)) for j in range(WORDS)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), longs


class BlockedFilter:
    """The filter of ``keys``, a column of a stored table."""

    def __init__(self, keys: DataFrame, name: str, bits: int = BITS, max_blocks: int = MAX_BLOCKS):
        need = -(-keys.count() * bits // BLOCK_BITS)
        self.blocks = max(1, min(need, max_blocks))
        block, longs = _places(F.col(name), self.blocks)
        self.table = keys.groupBy(block.alias("block_")).agg(
            *[F.bit_or(w).alias(f"word{j}_") for j, w in enumerate(longs)]
        )

    def marked(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with ``possible_``: false where the key is null or surely not among the keys."""
        block, longs = _places(F.col(name), self.blocks)
        # at most max_blocks rows of 40 bytes
        met = df.withColumn("at_", block).join(F.broadcast(self.table), F.col("at_") == F.col("block_"), "left")
        there = F.lit(True)
        for j, word in enumerate(longs):
            there = there & (F.col(f"word{j}_").bitwiseAND(word) == word)
        met = met.withColumn("possible_", F.coalesce(there, F.lit(False)) & F.col(name).isNotNull())
        return met.drop("at_", "block_", *[f"word{j}_" for j in range(WORDS)])


def among(df: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``name`` is in the column ``key`` of the stored ``keys``; few others move."""
    some = BlockedFilter(keys, key).marked(df, name).filter("possible_").drop("possible_")
    return some.join(keys.select(F.col(key).alias("key_f")), F.col(name) == F.col("key_f"), "left_semi")


def not_among(df: DataFrame, name: str, keys: DataFrame, key: str) -> DataFrame:
    """The other rows of ``df``, those without a key included; those surely not among the keys don't move."""
    told = BlockedFilter(keys, key).marked(df, name)
    some = told.filter("possible_").drop("possible_")
    some = some.join(keys.select(F.col(key).alias("key_f")), F.col(name) == F.col("key_f"), "left_anti")
    return told.filter("NOT possible_").drop("possible_").unionByName(some)
